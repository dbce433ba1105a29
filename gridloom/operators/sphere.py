"""Regridding between cells of any shape: curvilinear grids, meshes, HEALPix cells, points of trajectories, on the sphere or a plane.

A grid is up to three tables: `cells` with the vertices of each cell (conservative methods), `points` with the place of each value (nearest
methods and destinations), and `elements`, triangles or quadrilaterals whose corners are places of values (linear and patch). Places are vectors:
unit vectors on the sphere, (x, y, 1) on a plane; lines are planes through the origin in both, so that one code clips and locates.

Cells and elements meet by tiles of caps around them. A tile is a row of latitude or y and a bin along it, on a level by the size of the
cap: a cell is listed on its own level, and on the coarser ones that the other side has, so that cells of any size meet within a few tiles and
small ones don't crowd one. Pairs that meet are clipped or located in batches. Weights are a table (dst, src, w), and applying them is a
join and a sum that is combined before the shuffle.

Both sides of these joins grow with the grids. They are merged and never broadcast: the planner takes a table for as small as the compressed file
that it comes from, whatever is listed or computed from its rows, and would pass it through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import overlap
from gridloom.operators.regrid import RegridOperator
from gridloom.sources.folders import written

METHODS = ("linear", "bilinear", "patch", "conservative", "conservative_1st", "nearest_stod", "nearest_dtos")
#: Tolerance of a place on the edge of an element; share of a cell below which an overlap is rounding; finest level of tiles.
EDGE, SLIVER, FINEST = 1e-9, 1e-14, 28
#: Places from which on those around a corner make a patch.
FEW = 7


@dataclass(frozen=True)
class CellGrid:
    """Tables of a grid: points (cell, p: vector), cells (cell, v: array of vectors x, y, z), elements (element, corners: array of cell, p)."""

    spherical: bool
    points: DataFrame
    cells: DataFrame | None = None
    elements: DataFrame | None = None


def vector(x: Column, y: Column, spherical: bool = True) -> Column:
    """Longitude and latitude in degrees, or x and y, as a vector."""
    if not spherical:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(1.0).alias("z"))
    lon, lat = F.radians(x.cast("double")), F.radians(y.cast("double"))
    return F.struct((F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))


def _collected(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """(key, order, values…) -> (key, found: array of struct values, in order)."""
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *values))).alias("found"))
    return lists.select(key, F.transform("found", lambda e: F.struct(*[e[v].alias(v) for v in values])).alias("found"))


def curvilinear(coords: DataFrame, j: str, i: str, width: int, x: str = "lon", y: str = "lat", bounds: DataFrame | None = None, corner: str = "k", bx: str = "lon", by: str = "lat", spherical: bool = True, cyclic: bool = False) -> CellGrid:
    """A grid with 2-d coordinates: coords (j, i, x, y) and, for conservative methods, bounds (j, i, corner 0 to 3 around the cell, bx, by).

    A cell's id is j x width + i. Elements are the quadrilaterals between four neighbouring places, across the end of i if cyclic.
    A place with a missing coordinate is no place; a cell with a missing bound is no cell.
    """
    cell = lambda: F.col(j).cast("long") * width + F.col(i).cast("long")
    points = coords.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(cell().alias("cell"), vector(F.col(x), F.col(y), spherical).alias("p"))
    cells = None
    if bounds is not None:
        rows = bounds.select(cell().alias("cell"), F.col(corner).alias("k"), F.when(F.col(bx).isNotNull() & F.col(by).isNotNull(), vector(F.col(bx), F.col(by), spherical)).alias("p"))
        whole = _collected(rows, "cell", "k", "p").where(~F.exists("found", lambda e: e["p"].isNull()))
        cells = whole.select("cell", F.transform("found", lambda e: e["p"]).alias("v"))
    # A place is corner k of four elements, an element being named by the place of its least j and i.
    places = points.withColumns({"j": F.floor(F.col("cell") / width), "i": F.col("cell") % width})
    corners = places.select("cell", "p", F.posexplode(F.array(*[F.struct((F.col("j") - dj).alias("j"), ((F.pmod(F.col("i") - di, F.lit(width))) if cyclic else F.col("i") - di).alias("i")) for dj, di in ((0, 0), (0, 1), (1, 1), (1, 0))])).alias("k", "e"))
    corners = corners.where("e.j >= 0 AND e.i >= 0").select((F.col("e.j") * width + F.col("e.i")).alias("element"), "k", "cell", "p")
    if not cyclic:
        corners = corners.where(F.col("element") % width < width - 1)
    elements = _collected(corners, "element", "k", "cell", "p").where(F.size("found") == 4).withColumnRenamed("found", "corners")
    return CellGrid(spherical, points, cells, elements)


def rectilinear(xs: DataFrame, ys: DataFrame, width: int, spherical: bool = True, cyclic: bool = False) -> CellGrid:
    """Axes (i, coord, lower, upper) as a grid of cells with straight edges: the longer axis is repeated along the shorter one, so both tables
    are small against the grid they make."""
    x, y = (t.select(F.col("i").cast("long").alias(k), *[F.col(c).cast("double").alias(f"{k}_{c}") for c in ("coord", "lower", "upper") if c in t.columns]) for t, k in ((xs, "i"), (ys, "j")))
    grid = y.crossJoin(x)
    bounds = None
    if "lower" in xs.columns and "lower" in ys.columns:
        ends = [("i_lower", "j_lower"), ("i_upper", "j_lower"), ("i_upper", "j_upper"), ("i_lower", "j_upper")]
        bounds = grid.select("j", "i", F.posexplode(F.array(*[F.struct(F.col(a).alias("lon"), F.col(b).alias("lat")) for a, b in ends])).alias("k", "e")).select("j", "i", "k", "e.*")
    return curvilinear(grid, "j", "i", width, "i_coord", "j_coord", bounds, spherical=spherical, cyclic=cyclic)


def mesh(faces: DataFrame, nodes: DataFrame, location: str = "face", x: str = "lon", y: str = "lat", face: str = "face", corner: str = "corner", node: str = "node", spherical: bool = True) -> CellGrid:
    """A mesh: faces (face, corner in order around it, node), nodes (node, x, y), with values at its faces or at its nodes.

    Values at nodes: elements are the faces, cut into triangles from their first corner if they have more than four. Values at faces: places
    are the means of the corners, and elements the triangles between a node's surrounding faces, in their order around it.
    """
    at = nodes.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(node).cast("long").alias("node"), vector(F.col(x), F.col(y), spherical).alias("p"))
    edges = faces.select(F.col(face).cast("long").alias("cell"), F.col(corner).alias("k"), F.col(node).cast("long").alias("node")).where("node IS NOT NULL").join(at.hint("merge"), "node")
    rings = _collected(edges, "cell", "k", "node", "p")
    if location == "node":
        corners = F.transform("found", lambda e: F.struct(e["node"].alias("cell"), e["p"].alias("p")))
        return CellGrid(spherical, at.select(F.col("node").alias("cell"), "p"), None, _cut(rings.select(F.col("cell").alias("element"), corners.alias("corners"))))
    cells = rings.where(F.size("found") > 2).select("cell", F.transform("found", lambda e: e["p"]).alias("v"))
    points = cells.select("cell", _middle(F.col("v"), spherical).alias("p"))
    around = edges.select("cell", "node", F.col("p").alias("n")).join(points.hint("merge"), "cell")
    # The angle around the node, in a plane across it.
    n, p = F.col("n"), F.col("p")
    east = (F.struct((-n["y"]).alias("x"), n["x"].alias("y"), F.lit(0.0).alias("z")), F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
    e = F.when(F.abs(n["x"]) + F.abs(n["y"]) > 1e-9, east[0]).otherwise(east[1]) if spherical else east[1]
    north = F.struct((n["y"] * e["z"] - n["z"] * e["y"]).alias("x"), (n["z"] * e["x"] - n["x"] * e["z"]).alias("y"), (n["x"] * e["y"] - n["y"] * e["x"]).alias("z")) if spherical else F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z"))
    dot = lambda a: sum(((p[c] - n[c]) * a[c] for c in "xyz"), F.lit(0.0))
    around = around.withColumn("turn", F.atan2(dot(north), dot(e)))
    duals = _collected(around, "node", "turn", "cell", "p").where(F.size("found") > 2)
    return CellGrid(spherical, points, cells, _cut(duals.select(F.col("node").alias("element"), F.col("found").alias("corners"))))


def healpix(df: DataFrame, index: str, level: int) -> CellGrid:
    """Nested HEALPix cells as cells with great-circle edges."""
    from gridloom.operators import healpix as hp

    rows = df.select(F.col(index).cast("long").alias("cell")).distinct()
    v = F.transform(hp.corners(F.col("cell"), level), lambda c: vector(c["lon"], c["lat"]))
    middle = hp.centre(F.col("cell"), level)
    return CellGrid(True, rows.select("cell", middle.alias("c")).select("cell", vector(F.col("c.lon"), F.col("c.lat")).alias("p")), rows.select("cell", v.alias("v")))


def places(df: DataFrame, cell: str, x: str = "lon", y: str = "lat", spherical: bool = True) -> CellGrid:
    """Points without cells, such as those of trajectories: a destination of linear, patch and nearest methods, a source of nearest ones."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(cell).cast("long").alias("cell"), vector(F.col(x), F.col(y), spherical).alias("p"))
    return CellGrid(spherical, rows)


def _middle(v: Column, spherical: bool) -> Column:
    summed = lambda c: F.aggregate(v, F.lit(0.0), lambda a, e: a + e[c])
    total = {c: summed(c) for c in "xyz"}
    scale = F.sqrt(sum((s * s for s in total.values()), F.lit(0.0))) if spherical else total["z"]
    return F.struct(*[(s / scale).alias(c) for c, s in total.items()])


def _cut(elements: DataFrame) -> DataFrame:
    """Elements with more than four corners as triangles from the first one; `element` names them all."""
    c = F.col("corners")
    triangles = F.transform(F.sequence(F.lit(1), F.size(c) - 2), lambda k: F.array(c[0], c[k], c[k + 1]))
    few = elements.where("size(corners) IN (3, 4)")
    return few.unionByName(elements.where("size(corners) > 4").select("element", F.explode(triangles).alias("corners")))


def _held(rows: DataFrame, **made: Column) -> DataFrame:
    """rows with columns that are computed once: the optimizer doesn't copy an expression through the explosion of its one value."""
    names = list(made)
    one = rows.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("__held"))
    return one.select(*rows.columns, *[F.col(f"__held.{n}").alias(n) for n in names])


def _spread(rows: DataFrame) -> DataFrame:
    """rows dealt out to all cores: a small file is one partition, however many rows it holds, and geometry takes long for each."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)


# --- meeting ----------------------------------------------------------------------------------------------------------


def _caps(rows: DataFrame, v: Column, spherical: bool, reach: Column | None = None) -> DataFrame:
    """Add row coordinate a, bin coordinate b and radius r (degrees, or a plane's units) of the cap around the vectors v, or of radius reach."""
    rows = _held(_held(rows, __v=v), m=_middle(F.col("__v"), spherical))
    m = F.col("m")
    chord = F.array_max(F.transform("__v", lambda e: F.sqrt(sum(((e[c] - m[c]) * (e[c] - m[c]) for c in "xyz"), F.lit(0.0)))))
    # From the chord to the angle; a little more, for rounding.
    r = reach if reach is not None else (F.degrees(2 * F.asin(F.least(F.lit(1.0), chord / 2))) if spherical else chord) * (1 + 1e-9) + 1e-12
    a = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m["z"])))) + 90 if spherical else m["y"]
    b = F.pmod(F.degrees(F.atan2(m["y"], m["x"])), F.lit(360.0)) if spherical else m["x"]
    return _held(rows, a=a, b=b, r=r).drop("m", "__v")


def _level(r: Column, unit: float) -> Column:
    """The level of tiles for a cap of radius r."""
    return F.when(r < unit * 2.0**-FINEST, FINEST).otherwise(F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(unit / r))))).cast("int")


def _tiles(level: Column, a: Column, b: Column, r: Column, spherical: bool, unit: float) -> Column:
    """Keys (level, row, bin) of the tiles of a level that a cap touches."""
    size = F.lit(unit) / F.pow(F.lit(2.0), level)
    rows = lambda low, high: F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))
    key = lambda row, bin_: F.struct(level.cast("int").alias("l"), row.alias("row"), bin_.alias("bin"))
    if not spherical:
        return F.flatten(F.transform(rows(a - r, a + r), lambda row: F.transform(rows(b - r, b + r), lambda k: key(row, k))))

    def in_row(row: Column) -> Column:
        # Bins of a row are as many as fit its longest parallel; a cap that comes near a pole touches all of them.
        low, high = row * size - 90, (row + 1) * size - 90
        widest = F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))
        many = F.greatest(F.lit(1), F.ceil(360 * F.cos(F.radians(widest)) / size)).cast("long")
        inside = F.least(F.lit(1.0), F.sin(F.radians(r)) / F.greatest(F.cos(F.radians(a - 90)), F.lit(1e-12)))
        half = F.when((F.abs(a - 90) + r >= 90) | (r >= 90), F.lit(180.0)).otherwise(F.degrees(F.asin(inside)) * (1 + 1e-9) + 1e-9)
        first, last = F.floor((b - half) / 360 * many).cast("long"), F.floor((b + half) / 360 * many).cast("long")
        bins = F.sequence(first, F.least(last, first + many - 1))
        return F.transform(bins, lambda k: key(row, F.pmod(k, many)))

    return F.flatten(F.transform(rows(F.greatest(a - r, F.lit(0.0)), F.least(a + r, F.lit(180.0 - 1e-9))), in_row))


def _unit(*sides: DataFrame) -> float:
    """Size of a plane's coarsest tile: twice the largest cap's radius."""
    most = max(float(s.agg(F.max("r")).first()[0] or 0) for s in sides)
    return most * 2 or 1.0


def met(left: DataFrame, right: DataFrame, left_v: Column, right_v: Column, spherical: bool, reach: Column | None = None) -> DataFrame:
    """Pairs of rows whose caps share a tile, each pair once, with the columns of both sides (which have no name in common).

    Caps are the least around the vectors; the left side's have the radius `reach` if it is given.
    Levels that occur are few (29 at most) and known from the data; a side is listed on its own level and on the other's coarser ones.
    The caps are written, as the largest, the levels and the listing read them.
    """
    capped = [written(_caps(_spread(side), v, spherical, over), "caps") for side, v, over in ((left, left_v, reach), (right, right_v, None))]
    unit = 90.0 if spherical else _unit(*capped)
    names = ("a", "b", "r", "level")
    sides = [(_spread(t.withColumn("level", _level(F.col("r"), unit))).withColumnsRenamed({c: f"__{n}_{c}" for c in names}), n) for t, n in zip(capped, "lr")]
    levels = [sorted(r[0] for r in s.select(f"__{n}_level").distinct().collect()) for s, n in sides]
    listed = []
    for (s, n), others in zip(sides, reversed(levels)):
        own = F.col(f"__{n}_level")
        coarser = F.filter(F.array(*[F.lit(k) for k in others]), lambda k: k < own)
        on = s.withColumn(f"__{n}_on", F.explode(F.concat(F.array(own), coarser)))
        tiles = _tiles(F.col(f"__{n}_on"), F.col(f"__{n}_a"), F.col(f"__{n}_b"), F.col(f"__{n}_r"), spherical, unit)
        listed.append(_held(on, **{f"__{n}_tiles": tiles}).withColumn("__tile", F.explode(f"__{n}_tiles")))
    both = listed[0].join(listed[1].hint("merge"), "__tile")
    # A pair with several tiles in common counts in the least of them.
    several = (F.size("__l_tiles") > 1) & (F.size("__r_tiles") > 1)
    once = ~several | (F.col("__tile") == F.array_min(F.array_intersect("__l_tiles", "__r_tiles")))
    kept = [c for c in both.columns if not c.startswith("__")]
    return both.where((F.col("__tile.l") == F.least("__l_level", "__r_level")) & once).select(*kept)


# --- geometry in batches ------------------------------------------------------------------------------------------------


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of arrays of vectors -> (n, most, 3), the last vector repeated, and how many each has."""
    lens = np.asarray(column.value_lengths())
    flat = column.flatten()
    xyz = np.stack([np.asarray(flat.field(k)) for k in range(3)], axis=1)
    starts = np.cumsum(lens) - lens
    at = starts[:, None] + np.minimum(np.arange(lens.max()), lens[:, None] - 1)
    return xyz[at], lens


def areas(v: np.ndarray, spherical: bool) -> np.ndarray:
    """Signed areas of polygons (n, k, 3), fans from the first vertex; repeated vertices add nothing."""
    a, p, q = v[:, :1], v[:, 1:-1], v[:, 2:]
    cross = np.cross(p - a, q - a)
    if not spherical:
        return cross[:, :, 2].sum(axis=1) / 2
    volume = (a * cross).sum(axis=2)
    return 2 * np.arctan2(volume, 1 + (a * p).sum(axis=2) + (p * q).sum(axis=2) + (q * a).sum(axis=2)).sum(axis=1)


def turned(v: np.ndarray, spherical: bool) -> np.ndarray:
    """Polygons with their vertices counter-clockwise."""
    return np.where((areas(v, spherical) < 0)[:, None, None], v[:, ::-1], v)


def clipped(v: np.ndarray, window: np.ndarray, spherical: bool) -> np.ndarray:
    """Parts of polygons v (n, k, 3) inside convex windows (n, m, 3), both counter-clockwise; an empty part is one repeated vertex.

    Side by side for all pairs: each edge of the windows cuts all polygons at once.
    """
    n = len(v)
    rows = np.arange(n)[:, None]
    for e in range(window.shape[1]):
        a, b = window[:, e], window[:, (e + 1) % window.shape[1]]
        # The plane through an edge, from the difference of its ends, so that short edges lose no digits.
        normal = np.cross(a, b - a)
        side = ((v - a[:, None]) * normal[:, None]).sum(axis=2)
        size = np.abs(normal).max(axis=1, keepdims=True)
        side[np.abs(side) <= 4e-16 * size] = 0
        after, side_after = np.roll(v, -1, axis=1), np.roll(side, -1, axis=1)
        keep, cross = side >= 0, side * side_after < 0
        share = np.where(cross, side / np.where(cross, side - side_after, 1), 0)[:, :, None]
        cut = v + (after - v) * share
        if spherical:
            cut = cut / np.linalg.norm(cut, axis=2, keepdims=True)
        flags = np.stack([keep, cross], axis=2).reshape(n, -1)
        found = np.stack([v, cut], axis=2).reshape(n, -1, 3)
        count = flags.sum(axis=1)
        width = max(3, int(count.max(initial=0)))
        # Each polygon's vertices move to the front, and its last one fills what is left.
        order = np.argsort(~flags, axis=1, kind="stable")[:, :width]
        at = np.minimum(np.arange(min(width, order.shape[1]))[None, :], np.maximum(count, 1)[:, None] - 1)
        v = found[rows, np.take_along_axis(order, at, axis=1)]
        v[count == 0] = a[count == 0][:, None]
    return v


def apart(v: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Whether polygon v (n, k, 3) lies outside one edge of its convex window (n, m, 3), so that clipping would leave no area of it."""
    out = np.zeros(len(v), bool)
    for e in range(window.shape[1]):
        a, b = window[:, e], window[:, (e + 1) % window.shape[1]]
        normal = np.cross(a, b - a)
        side = np.einsum("nkc,nc->nk", v - a[:, None], normal)
        # A repeated vertex is no edge.
        out |= (side <= 0).all(axis=1) & (normal != 0).any(axis=1)
    return out


def _overlaps(spherical: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("dst", pa.int64()), ("src", pa.int64()), ("w", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (dv, _), (sv, _) = (_vectors(batch.column(k)) for k in (2, 3))
            window, subject = turned(dv, spherical), turned(sv, spherical)
            whole, part = areas(window, spherical), np.zeros(len(dv))
            near = np.flatnonzero(~apart(subject, window))
            step = 20_000
            for k in range(0, len(near), step):
                some = near[k : k + step]
                part[some] = areas(clipped(subject[some], window[some], spherical), spherical)
            good = np.flatnonzero((whole > 0) & (part > SLIVER * whole))
            cols = [batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(part[good] / whole[good])]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _with_bounds(src: CellGrid, dst: CellGrid) -> None:
    if src.spherical != dst.spherical:
        raise ValueError("one grid is on the sphere and the other on a plane")
    if src.cells is None or dst.cells is None:
        raise ValueError("conservative regridding needs the bounds of both grids")


def conservative_weights(src: CellGrid, dst: CellGrid) -> DataFrame:
    """(dst, src, w): the share of each destination cell that a source cell covers. Destination cells are convex, edges are great
    circles or straight lines; a cell is smaller than a hemisphere. Cells without area have no weights."""
    _with_bounds(src, dst)
    left, right = src.cells.select(F.col("cell").alias("src"), F.col("v").alias("sv")), dst.cells.select(F.col("cell").alias("dst"), F.col("v").alias("dv"))
    pairs = met(left, right, F.col("sv"), F.col("dv"), src.spherical)
    return pairs.select("dst", "src", "dv", "sv").mapInArrow(_overlaps(src.spherical), "dst long, src long, w double")


def shares(p: np.ndarray, corners: np.ndarray, four: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (n, 4) of the corners (n, 4, 3) of triangles, or quadrilaterals where `four`, at places p (n, 3), and whether p is inside.

    In a triangle the place's direction meets its plane; in a quadrilateral, the bilinear surface through its corners, found by Newton's steps.
    """
    w = np.zeros((len(p), 4))
    with np.errstate(all="ignore"):
        t = ~four
        if t.any():
            a, b, c = (corners[t, k] for k in range(3))
            vol = lambda x, y, z: (x * np.cross(y, z)).sum(axis=1)
            # Differences from the place keep the digits of small triangles.
            q = p[t]
            x, y, z = a - q, b - q, c - q
            parts = np.stack([vol(q, y, z), vol(q, z, x), vol(q, x, y)], axis=1)
            w[t, :3] = parts / parts.sum(axis=1, keepdims=True)
        if four.any():
            a, b, c, d = (corners[four, k] for k in range(4))
            q = p[four]
            s, u = np.full(len(q), 0.5), np.full(len(q), 0.5)
            a, b, c, d = a - q, b - q, c - q, d - q
            # Two directions across the place, in which the surface has to be at it.
            far = np.abs(q).argmin(axis=1)
            e1 = np.cross(q, np.eye(3)[far])
            e1 /= np.linalg.norm(e1, axis=1, keepdims=True)
            e2 = np.cross(q, e1)
            e2 /= np.linalg.norm(e2, axis=1, keepdims=True)
            for _ in range(12):
                at = (1 - s)[:, None] * ((1 - u)[:, None] * a + u[:, None] * d) + s[:, None] * ((1 - u)[:, None] * b + u[:, None] * c)
                ds = (1 - u)[:, None] * (b - a) + u[:, None] * (c - d)
                du = (1 - s)[:, None] * (d - a) + s[:, None] * (c - b)
                f, g = (at * e1).sum(1), (at * e2).sum(1)
                fs, fu, gs, gu = (ds * e1).sum(1), (du * e1).sum(1), (ds * e2).sum(1), (du * e2).sum(1)
                det = fs * gu - fu * gs
                step_s, step_u = (f * gu - fu * g) / det, (fs * g - f * gs) / det
                s, u = s - step_s, u - step_u
            w[four] = np.stack([(1 - s) * (1 - u), s * (1 - u), s * u, (1 - s) * u], axis=1)
            # The other solution, and one that hasn't settled, are far outside.
            near = np.abs((at * e1).sum(1)) + np.abs((at * e2).sum(1)) < 1e-6 * (np.abs(a) + np.abs(c)).sum(1)
            inside = (s > -EDGE) & (s < 1 + EDGE) & (u > -EDGE) & (u < 1 + EDGE) & near & (((at + q) * q).sum(1) > 0)
        ok = np.isfinite(w).all(axis=1) & (w > -EDGE).all(axis=1)
        middle = corners.sum(axis=1)
        ok &= (middle * p).sum(axis=1) > 0
        if four.any():
            ok[four] &= inside
    return np.where(ok[:, None], np.clip(w, 0, 1), 0), ok


def _corner_batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of three or four corners (cell, p) -> ids (n, 4), vectors (n, 4, 3), whether there are four; a triangle's third is repeated."""
    lens = np.asarray(column.value_lengths())
    flat = column.flatten()
    p = flat.field(1)
    xyz = np.stack([np.asarray(p.field(k)) for k in range(3)], axis=1)
    starts = np.cumsum(lens) - lens
    at = starts[:, None] + np.minimum(np.arange(4), lens[:, None] - 1)
    return np.asarray(flat.field(0))[at], xyz[at], lens == 4


def located(elements: DataFrame, dst: CellGrid) -> DataFrame:
    """(dst, p, element, corners, w: array): the element that each destination place lies in, with the weights of its corners.

    A place on an edge takes the least of its elements; a place outside all has no row.
    """
    left = elements.select("element", "corners")
    right = dst.points.select(F.col("cell").alias("dst"), "p")
    pairs = met(left, right, F.transform("corners", lambda c: c["p"]), F.array("p"), dst.spherical)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, corners, four = _corner_batch(batch.column("corners"))
            p = batch.column("p")
            w, ok = shares(np.stack([np.asarray(p.field(k)) for k in range(3)], axis=1), corners, four)
            good = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([*(c.take(good) for c in batch.columns), pa.array(list(w[ok]), pa.list_(pa.float64()))], names=[*batch.schema.names, "w"])

    rows = pairs.select("element", "corners", "dst", "p")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = rows.mapInArrow(run, f"element long, corners {kinds['corners']}, dst long, p {kinds['p']}, w array<double>")
    first = F.min(F.struct("element", "corners", "w", "p")).alias("e")
    return found.groupBy("dst").agg(first).select("dst", "e.p", "e.element", "e.corners", "e.w")


def linear_weights(src: CellGrid, dst: CellGrid) -> DataFrame:
    """(dst, src, w): weights of the corners of the element around each destination place."""
    if src.elements is None:
        raise ValueError("linear regridding needs a source whose values have neighbours")
    rows = located(src.elements, dst).select("dst", F.explode(F.zip_with("corners", F.slice("w", F.lit(1), F.size("corners")), lambda c, w: F.struct(c["cell"].alias("src"), w.alias("w")))).alias("e"))
    return rows.select("dst", "e.src", "e.w").where("w <> 0").groupBy("dst", "src").agg(F.sum("w").alias("w"))


def _fitted(spherical: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (dst, p, w, n: a corner's place, patch: (cell, p) around it) -> (dst, src, w): the corner's share times the weights with which
    the patch's values make the least-squares polynomial's value at p.

    The polynomial is of the second degree in the plane that touches the corner, of the first or none where a patch has too few places for it.
    """
    def terms(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([np.ones_like(x), x, y, x * x, x * y, y * y], axis=2)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            xyz_of = lambda a: np.stack([np.asarray(a.field(k)) for k in range(3)], axis=1)
            p, own, share, dst = xyz_of(batch.column("p")), xyz_of(batch.column("n")), np.asarray(batch.column("w")), np.asarray(batch.column("dst"))
            patch = batch.column("patch")
            lens, flat = np.asarray(patch.value_lengths()), patch.flatten()
            ids, xyz, starts = np.asarray(flat.field(0)), xyz_of(flat.field(1)), np.cumsum(lens) - lens
            out: dict[str, list] = {"dst": [], "src": [], "w": []}
            for size in np.unique(lens):
                rows = np.flatnonzero(lens == size)
                where = starts[rows][:, None] + np.arange(size)
                (u, v), (pu, pv) = _plane(xyz[where], own[rows], spherical), _plane(p[rows][:, None], own[rows], spherical)
                scale = np.maximum(np.abs(u), np.abs(v)).max(axis=1, keepdims=True) + 1e-300
                a, b = terms(u / scale, v / scale), terms(pu / scale, pv / scale)[:, 0]
                w, settled = np.zeros((len(rows), size)), np.zeros(len(rows), bool)
                for many in (6, 3, 1):
                    left = np.flatnonzero(~settled)
                    if size < many or not len(left):
                        continue
                    s = np.linalg.svd(a[left][:, :, :many], compute_uv=False)
                    good = left[s[:, -1] > 1e-7 * s[:, 0]]
                    w[good] = (np.linalg.pinv(a[good][:, :, :many]) * b[good][:, :many, None]).sum(axis=1)
                    settled[good] = True
                for k, x in (("dst", np.repeat(dst[rows], size)), ("src", ids[where].ravel()), ("w", (w * share[rows][:, None]).ravel())):
                    out[k].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out.values()], names=list(out))

    return run


def _plane(p: np.ndarray, n: np.ndarray, spherical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of p (k, m, 3) about n (k, 3) in the plane that touches the sphere there, along lines from the centre; in a plane, x and y."""
    if not spherical:
        return p[:, :, 0] - n[:, :1], p[:, :, 1] - n[:, 1:2]
    e1 = np.cross(n, np.eye(3)[np.abs(n).argmin(axis=1)])
    e1 /= np.linalg.norm(e1, axis=1, keepdims=True)
    e2 = np.cross(n, e1)
    d = (p * n[:, None]).sum(axis=2)
    return (p * e1[:, None]).sum(axis=2) / d, (p * e2[:, None]).sum(axis=2) / d


def patch_weights(src: CellGrid, dst: CellGrid) -> DataFrame:
    """(dst, src, w): patch recovery. Around each corner of the element that a destination place lies in, a polynomial of the second degree is
    fitted to the values of all elements of that corner, and of its neighbours' where these have fewer than FEW places; their values at the place
    are mixed by the corners' linear weights."""
    if src.elements is None:
        raise ValueError("patch regridding needs a source whose values have neighbours")
    found = located(src.elements, dst)
    pairs = src.elements.select(F.explode("corners").alias("c"), F.col("corners").alias("all")).select("c.cell", F.explode("all").alias("near")).distinct()
    # Corners at an edge of the grid have too few places around them for six coefficients; they take their neighbours' places too.
    few = pairs.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") < FEW).select("cell")
    further = pairs.join(few.hint("merge"), "cell", "left_semi").select("cell", F.col("near.cell").alias("via")).join(pairs.select(F.col("cell").alias("via"), "near").hint("merge"), "via").select("cell", "near")
    patches = pairs.unionByName(further).distinct().groupBy("cell").agg(F.sort_array(F.collect_list("near")).alias("patch"))
    zipped = F.zip_with("corners", F.slice("w", F.lit(1), F.size("corners")), lambda c, w: F.struct(c["cell"].alias("cell"), c["p"].alias("n"), w.alias("w")))
    corners = found.select("dst", "p", F.explode(zipped).alias("e")).select("dst", "p", "e.cell", "e.n", "e.w").where("w <> 0")
    rows = corners.join(patches.hint("merge"), "cell").select("dst", "p", "w", "n", "patch")
    return rows.mapInArrow(_fitted(src.spherical), "dst long, src long, w double").groupBy("dst", "src").agg(F.sum("w").alias("w")).where("w <> 0")


def nearest(points: DataFrame, targets: DataFrame, spherical: bool = True) -> DataFrame:
    """points (cell, p), targets (cell, p) -> (cell, other): the nearest target of each point, of equally near ones the least id.

    One target stands for each tile of each level, down to tiles that hold one or so. What stands in the tiles around a point, on all levels,
    gives a bound of its distance; all targets within this bound are then compared. Without targets there are no rows.
    """
    many = targets.count()
    if not many:
        return points.select("cell", F.lit(None).cast("long").alias("other")).where("false")
    unit = 90.0
    if not spherical:
        ends = points.select("p").unionByName(targets.select("p")).agg(*[f(f"p.{c}").alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).first()
        unit = max(ends["hix"] - ends["lox"], ends["hiy"] - ends["loy"], 1e-9) * (1 + 1e-9)
    depth = min(FINEST, math.ceil(math.log(many, 4)) + 2)
    left = _caps(_spread(points.select("cell", "p")), F.array("p"), spherical).drop("r")
    right = _caps(_spread(targets.select(F.col("cell").alias("other"), F.col("p").alias("q"))), F.array("q"), spherical)
    levels = F.sequence(F.lit(0), F.lit(depth))
    around = lambda k: F.when(k == 0, F.lit(180.0 if spherical else unit)).otherwise(F.lit(unit) / F.pow(F.lit(2.0), k))
    listed = lambda rows, r: rows.withColumn("tile", F.explode(F.flatten(F.transform(levels, lambda k: _tiles(k, F.col("a"), F.col("b"), r(k), spherical, unit)))))
    standing = listed(right, lambda k: F.col("r")).groupBy("tile").agg(F.min(F.struct("other", "q")).alias("t"))
    chord = F.sqrt(sum(((F.col(f"p.{c}") - F.col(f"q.{c}")) * (F.col(f"p.{c}") - F.col(f"q.{c}")) for c in "xyz"), F.lit(0.0)))
    bounds = listed(left, around).select("tile", "cell", "p").join(standing.hint("merge"), "tile").select("cell", "p", "t.q").groupBy("cell").agg(F.first("p").alias("p"), F.min(chord).alias("bound"))
    reach = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.col("bound") / 2))) if spherical else F.col("bound")
    wide = _held(bounds, reach=reach * (1 + 1e-9) + 1e-12)
    pairs = met(wide, targets.select(F.col("cell").alias("other"), F.col("p").alias("q")), F.array("p"), F.array("q"), spherical, F.col("reach"))
    return pairs.groupBy("cell").agg(F.min(F.struct(chord.alias("d"), "other")).alias("e")).select("cell", "e.other")


def operator(src: CellGrid, dst: CellGrid, method: str, index: str = "cell") -> RegridOperator:
    """Weights between two grids of one kind of coordinates, to be applied to rows with the source's ids in column `index`."""
    if method not in METHODS:
        raise ValueError(f"unknown regridding method {method!r}")
    if src.spherical != dst.spherical:
        raise ValueError("one grid is on the sphere and the other on a plane")
    if method.startswith("conservative"):
        table = conservative_weights(src, dst)
    elif method == "patch":
        table = patch_weights(src, dst)
    elif method == "nearest_stod":
        table = nearest(dst.points, src.points, src.spherical).select(F.col("cell").alias("dst"), F.col("other").alias("src"), F.lit(1.0).alias("w"))
    elif method == "nearest_dtos":
        table = nearest(src.points, dst.points, src.spherical).select(F.col("other").alias("dst"), F.col("cell").alias("src"), F.lit(1.0).alias("w"))
    else:
        table = linear_weights(src, dst)
    return RegridOperator(method, {index: table}, parameters={"spherical": src.spherical})


def regrid(df: DataFrame, by: Sequence[str], value: str, src: CellGrid, dst: CellGrid, method: str, index: str = "cell", full: bool = True, min_weight: float | None = None) -> DataFrame:
    """Rows (by…, index, value) on the source grid -> rows on the destination; with `full` one for each destination cell and each `by` that
    occurs, missing where no source reaches. Missing values as in `regrid.RegridOperator`: conservative methods leave them out, of the others a
    result is missing if any source with a weight is. Destination cells that should stay missing are left out of the destination's tables.
    """
    got = operator(src, dst, method, index).apply(df, by, value, min_weight)
    if not full:
        return got
    cells = (dst.cells if method.startswith("conservative") and dst.cells is not None else dst.points).select(F.col("cell").alias(index))
    if by:
        cells = df.select(*by).distinct().crossJoin(cells)
    return cells.join(got.hint("merge"), [*by, index], "left")


def regrid_sparse(df: DataFrame, by: Sequence[str], value: str, src: CellGrid, dst: CellGrid, method: str = "conservative", index: str = "cell") -> DataFrame:
    """`regrid` of rows (by…, index, value) where a source cell without a row, or with a missing value, counts as 0 for every `by`: the zeros
    needn't be rows. Rows where a destination cell is reached by a row of its `by`; the others are 0, or missing if no source reaches them.

    Sums of weights are the same for every `by`, and are taken in the pass over the weights that takes the values' sums. Conservative weights are
    no table: they are added up where the cells meet.
    """
    there = df.select(F.col(index).alias("src"), F.struct(*by, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("__v")).alias("__e"))
    there = there.groupBy("src").agg(F.collect_list("__e").alias("__es"))
    if isinstance(src, CellGrid) and method.startswith("conservative"):
        _with_bounds(src, dst)
        cells = src.cells.select("cell", "v").join(there.withColumnRenamed("src", "cell").hint("merge"), "cell", "left")
        rows = overlap.sums(cells, dst.cells.select("cell", "v"), src.spherical, SLIVER, by)
    else:
        both = operator(src, dst, method, index).weights[index].join(there.hint("merge"), "src", "left")
        kinds = {f.name: f.dataType for f in df.select(*by).schema.fields}
        whole = F.struct(F.lit(True).alias("__whole"), *[F.lit(None).cast(kinds[c]).alias(c) for c in by], F.col("w").alias("__s"))
        each = F.transform("__es", lambda e: F.struct(F.lit(False).alias("__whole"), *[e[c].alias(c) for c in by], (e["__v"] * F.col("w")).alias("__s")))
        rows = both.select("dst", F.explode(F.when(F.col("__es").isNull(), F.array(whole)).otherwise(F.concat(F.array(whole), each))).alias("__r")).select("dst", "__r.*")
    sums = written(rows.groupBy("dst", "__whole", *by).agg(F.sum("__s").alias("__s")), "sums")
    d = sums.where("__whole AND __s > 1e-12").select("dst", F.col("__s").alias("__d"))
    return sums.where("NOT __whole").join(d.hint("merge"), "dst").select(*by, F.col("dst").alias(index), (F.col("__s") / F.col("__d")).alias(value))


def level_weights(flat: DataFrame, levels: DataFrame, heights: DataFrame, ln_z: bool = False) -> DataFrame:
    """(dst, src, w) between cells, levels (k, z), or (cell, k, z) where they differ by cell, heights (cell, z) of the destination's places ->
    (dst, src, k, w): each weight dealt out to the two levels around the place's height, one if it is on a level.

    Between two neighbours in z weights are linear in z, or with ln_z in its logarithm (of pressures). A place above or below the levels of a cell gets
    no weight from it, nor does one without a height. Levels come as one sorted list, in all or for each cell.
    """
    scaled = (lambda z: F.log(z)) if ln_z else (lambda z: z)
    both = heights.where(F.col("z").isNotNull()).select(F.col("cell").alias("dst"), scaled(F.col("z").cast("double")).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct(scaled(F.col("z").cast("double")).alias("z"), "k"))).alias("levels")
    there = levels.where(F.col("z").isNotNull())
    rows = flat.join(both.hint("merge"), "dst")
    if "cell" in levels.columns:
        rows = rows.join(there.groupBy(F.col("cell").alias("src")).agg(listed).hint("merge"), "src")
    else:
        rows = rows.crossJoin(F.broadcast(there.agg(listed)))  # one row
    n = F.size("levels")
    spans = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.col("levels")[i].alias("a"), F.col("levels")[i + 1].alias("b")))
    around = F.when(n > 1, F.get(F.filter(spans, lambda s: (s["a"]["z"] <= F.col("at")) & (F.col("at") <= s["b"]["z"])), F.lit(0)))
    share = (F.col("at") - F.col("s.a.z")) / (F.col("s.b.z") - F.col("s.a.z"))
    rows = _held(rows, s=around).where("s IS NOT NULL AND s.a.z < s.b.z").withColumn("share", share)
    ends = F.array(F.struct(F.col("s.a.k").alias("k"), (F.col("w") * (1 - F.col("share"))).alias("w")), F.struct(F.col("s.b.k").alias("k"), (F.col("w") * F.col("share")).alias("w")))
    return rows.select("dst", "src", F.explode(ends).alias("e")).select("dst", "src", "e.k", "e.w").where("w <> 0")


def regrid_levels(df: DataFrame, by: Sequence[str], value: str, src: CellGrid, dst: CellGrid, levels: DataFrame, heights: DataFrame, method: str = "linear", ln_z: bool = False, index: str = "cell", level: str = "k") -> DataFrame:
    """Rows (by…, index, level, value) of a grid with levels -> a value at each destination place's height (trajectories, profiles, soundings).

    Horizontal weights are those of `method` (linear, patch or nearest_stod), vertical ones linear in the height or its logarithm. A result is missing if
    any value with a weight is, or if a corner's levels don't reach the place's height. Weights meet the values by cell and level; partial sums
    are combined before they are shuffled by place.
    """
    if method not in ("linear", "bilinear", "patch", "nearest_stod"):
        raise ValueError(f"method {method!r} can't be used between levels")
    flat = operator(src, dst, method, index).weights[index]
    table = level_weights(flat, levels, heights, ln_z).select("dst", F.col("src").alias(index), F.col("k").alias(level), "w")
    values = df.select(*by, index, level, F.col(value).cast("double").alias("__v"))
    sums = values.join(table.hint("merge"), [index, level]).groupBy(*by, F.col("dst").alias(index)).agg(F.sum(F.col("__v") * F.col("w")).alias("__n"), F.sum(F.when(F.col("__v").isNotNull(), F.col("w"))).alias("__d"))
    # All weights of a place add up to 1: less is a value, a level or a corner that isn't there.
    got = sums.select(*by, index, F.when(F.abs(F.col("__d") - 1) < 1e-9, F.col("__n")).alias(value))
    cells = dst.points.select(F.col("cell").alias(index))
    if by:
        cells = df.select(*by).distinct().crossJoin(cells)
    return cells.join(got.hint("merge"), [*by, index], "left")
