"""Regridding by a sparse matrix of weights, a table (dst, src, w) for each axis of a rectilinear grid.

Source and destination cells of an axis meet by tiles of the coordinate's range, so that building weights is an
equi-join. Applying them is a join and a sum along one axis at a time: sums of weighted values and of the weights of
values that are there go through all axes, and are divided at the end. Partial sums are combined before the shuffle.

Second-order conservative weights add the source cells' gradient along each axis, one axis after another, taken at the
middle of the part of a source cell that lies in the destination cell.

Missing values: conservative methods leave them out and renormalise; linear ones make a result missing if any
source with a weight is missing; nearest takes the source as it is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("linear", "bilinear", "conservative", "conservative_1st", "conservative_2nd", "nearest_dtos", "nearest_stod", "patch")


def _sine(c: Column) -> Column:
    return F.sin(F.radians(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), c))))


def _tiles(low: Column, high: Column, tile: float) -> Column:
    return F.explode(F.sequence(F.floor(low / tile).cast("long"), F.floor(high / tile).cast("long")))


def overlap_weights(src: DataFrame, dst: DataFrame, latitude: bool = False, period: float | None = None, tile: float | None = None) -> DataFrame:
    """Conservative weights of axes (i, lower, upper): w, the share of a destination cell that each source covers, and m, the same times
    the distance of the covered part's middle from the source cell's."""
    side = lambda t, n: t.select(F.col("i").cast("int").alias(n), F.least("lower", "upper").cast("double").alias(f"{n}_lo"), F.greatest("lower", "upper").cast("double").alias(f"{n}_hi"))
    s, d = side(src, "src"), side(dst, "dst")
    if tile is None:
        width = d.agg(F.avg(F.col("dst_hi") - F.col("dst_lo"))).first()[0]
        tile = float(width or 1.0)
    if period is not None:
        # A source cell also stands one period up and down.
        s = s.withColumn("__k", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).select("src", (F.col("src_lo") + F.col("__k") * period).alias("src_lo"), (F.col("src_hi") + F.col("__k") * period).alias("src_hi"))
    st = s.withColumn("tile", _tiles(F.col("src_lo"), F.col("src_hi"), tile))
    dt = d.withColumn("tile", _tiles(F.col("dst_lo"), F.col("dst_hi"), tile))
    both = st.join(dt, "tile")
    low, high = F.greatest("src_lo", "dst_lo"), F.least("src_hi", "dst_hi")
    met = both.where((low < high) & (F.col("tile") == F.floor(low / tile)))  # a pair counts in the tile where it begins
    at = _sine if latitude else (lambda c: c)
    w = (at(high) - at(low)) / (at(F.col("dst_hi")) - at(F.col("dst_lo")))
    off = (at(high) + at(low)) / 2 - (at(F.col("src_hi")) + at(F.col("src_lo"))) / 2
    return met.groupBy("dst", "src").agg(F.sum(w).alias("w"), F.sum(w * off).alias("m"))


def _spans(src: DataFrame, period: float | None) -> DataFrame:
    """Neighbouring source points in order: (i0, c0, i1, c1); across the seam too if cyclic."""
    order = Window.orderBy("coord")
    rows = src.select(F.col("i").cast("int").alias("i0"), F.col("coord").cast("double").alias("c0"), F.lead(F.col("i").cast("int")).over(order).alias("i1"), F.lead(F.col("coord").cast("double")).over(order).alias("c1"), F.first(F.col("i").cast("int")).over(order).alias("fi"), F.first(F.col("coord").cast("double")).over(order).alias("fc"))
    if period is not None:
        last = F.col("i1").isNull()
        rows = rows.withColumns({"i1": F.when(last, F.col("fi")).otherwise(F.col("i1")), "c1": F.when(last, F.col("fc") + period).otherwise(F.col("c1"))})
        rows = rows.withColumn("__k", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumns({"c0": F.col("c0") + F.col("__k") * period, "c1": F.col("c1") + F.col("__k") * period})
    return rows.where("i1 IS NOT NULL").select("i0", "c0", "i1", "c1")


def _clipped(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex one, whose vertices go round to the left."""
    out = subject
    for a, b in zip(window, np.roll(window, -1, axis=0)):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept = []
        for p, q, s, t in zip(out, np.roll(out, -1, axis=0), side, np.roll(side, -1)):
            if s >= 0:
                kept.append(p)
            if (s > 0) != (t > 0) and s != t and s * t < 0:
                kept.append(p + (q - p) * (s / (s - t)))
        out = np.array(kept).reshape(-1, 2)
    return out


def _area(v: np.ndarray) -> float:
    if len(v) < 3:
        return 0.0
    x, y = v[:, 0], v[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _overlaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dst, src, dv, sv) -> (dst, src, w): the share of each destination polygon that a source polygon covers."""
    for batch in batches:
        found = {"dst": [], "src": [], "w": []}
        for d, s, dv, sv in zip(*(c.to_pylist() for c in batch.columns)):
            window, subject = (np.array([(p["x"], p["y"]) for p in v]) for v in (dv, sv))
            whole = _area(window)
            part = abs(_area(_clipped(subject, window if whole > 0 else window[::-1])))
            if whole and part > 1e-15 * abs(whole):
                for k, v in (("dst", d), ("src", s), ("w", part / abs(whole))):
                    found[k].append(v)
        yield pa.RecordBatch.from_pydict(found, schema=pa.schema([("dst", pa.int64()), ("src", pa.int64()), ("w", pa.float64())]))


def polygon_weights(src: DataFrame, dst: DataFrame, tile: float, spherical: bool = False) -> DataFrame:
    """First-order conservative weights of cells of any shape: tables (i, vertices: array of struct x, y); destination cells are convex.

    Cells meet by tiles of their bounding boxes and a pair counts in the first tile that both touch. spherical: x and y are
    longitude and latitude in degrees and areas those of the projection (longitude, sine of latitude), exact for cells along
    the graticule; cells don't cross the seam.
    """
    def side(t: DataFrame, n: str) -> DataFrame:
        v = F.col("vertices")
        if spherical:
            v = F.transform(v, lambda p: F.struct(F.radians(p["x"]).alias("x"), F.sin(F.radians(p["y"])).alias("y")))
        rows = t.select(F.col("i").cast("long").alias(n), F.transform(v, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias(f"{n}_v"))
        at = lambda end, c: F.floor(end(F.transform(f"{n}_v", lambda p: p[c])) / tile).cast("long")
        low, high = ({c: at(end, c) for c in "xy"} for end in (F.array_min, F.array_max))
        rows = rows.withColumns({f"{n}_x0": low["x"], f"{n}_y0": low["y"], "__x1": high["x"], "__y1": high["y"]})
        return rows.withColumn("tx", F.explode(F.sequence(f"{n}_x0", "__x1"))).withColumn("ty", F.explode(F.sequence(f"{n}_y0", "__y1"))).drop("__x1", "__y1")

    both = side(src, "src").join(side(dst, "dst"), ["tx", "ty"])
    once = both.where((F.col("tx") == F.greatest("src_x0", "dst_x0")) & (F.col("ty") == F.greatest("src_y0", "dst_y0")))
    return once.select("dst", "src", F.col("dst_v").alias("dv"), F.col("src_v").alias("sv")).mapInArrow(_overlaps, "dst long, src long, w double")


def linear_weights(src: DataFrame, dst: DataFrame, period: float | None = None, tile: float | None = None) -> DataFrame:
    """Two weights for each destination point between source points; points outside have none."""
    spans = _spans(src, period)
    if tile is None:
        tile = float(spans.agg(F.avg(F.col("c1") - F.col("c0"))).first()[0] or 1.0)
    st = spans.withColumn("tile", _tiles(F.col("c0"), F.col("c1"), tile))
    dt = dst.select(F.col("i").cast("int").alias("dst"), F.col("coord").cast("double").alias("c")).withColumn("tile", F.floor(F.col("c") / tile).cast("long"))
    met = dt.join(st, "tile").where((F.col("c0") <= F.col("c")) & (F.col("c") <= F.col("c1")))
    one = met.groupBy("dst").agg(F.min(F.struct("c0", "i0", "c1", "i1", "c")).alias("s")).select("dst", "s.*")
    f = (F.col("c") - F.col("c0")) / (F.col("c1") - F.col("c0"))
    pairs = F.array(F.struct(F.col("i0").alias("src"), (1 - f).alias("w")), F.struct(F.col("i1").alias("src"), f.alias("w")))
    return one.select("dst", F.explode(pairs).alias("p")).select("dst", "p.src", "p.w").where("w <> 0")


def nearest_weights(src: DataFrame, dst: DataFrame, period: float | None = None) -> DataFrame:
    """One source for each destination point: the nearest, the lower one of two."""
    order = Window.orderBy("coord")
    c = F.col("coord").cast("double")
    before, after = F.lag(c).over(order), F.lead(c).over(order)
    if period is not None:
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = F.coalesce(before, F.last(c).over(whole) - period)
        after = F.coalesce(after, F.first(c).over(whole) + period)
    cells_ = src.select(F.col("i").cast("int").alias("src"), F.coalesce((c + before) / 2, F.lit(float("-inf"))).alias("lo"), F.coalesce((c + after) / 2, F.lit(float("inf"))).alias("hi"), c.alias("at"))
    points = dst.select(F.col("i").cast("int").alias("dst"), F.col("coord").cast("double").alias("c"))
    if period is not None:
        start = cells_.agg(F.min("lo").alias("__start"))
        points = points.crossJoin(F.broadcast(start)).withColumn("c", F.pmod(F.col("c") - F.col("__start"), F.lit(float(period))) + F.col("__start")).drop("__start")
    # Points and cell edges in one order: a point takes the last cell that begins before it.
    both = cells_.select(F.col("lo").alias("c"), F.lit(1).alias("kind"), "src", F.lit(None).cast("int").alias("dst")).unionByName(points.select("c", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("src"), "dst"))
    running = Window.orderBy("c", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("src", F.last("src", ignorenulls=True).over(running)).where("dst IS NOT NULL").select("dst", "src", F.lit(1.0).alias("w"))


@dataclass
class RegridOperator:
    """A method and its weights for each axis: {data index: (dst, src, w) table}, with the destination's sizes."""

    method: str
    weights: Mapping[str, DataFrame]
    sizes: Mapping[str, int] = field(default_factory=dict)
    parameters: Mapping[str, object] = field(default_factory=dict)
    middles: Mapping[str, DataFrame] = field(default_factory=dict)  # of the source cells (i, c), for second order

    def get_parameter(self, name: str, *default):
        if name not in self.parameters and not default:
            raise ValueError(f"no parameter {name!r}")
        return self.parameters.get(name, *default)

    def save(self, path: str) -> None:
        for index, table in self.weights.items():
            table.write.mode("overwrite").parquet(f"{path}/{index}")

    def equal_weights(self, other: RegridOperator, rtol: float = 1e-12, atol: float = 1e-12) -> bool:
        if set(self.weights) != set(other.weights):
            return False
        for index, table in self.weights.items():
            both = table.join(other.weights[index].withColumnRenamed("w", "__w"), ["dst", "src"], "full_outer")
            same = F.abs(F.col("w") - F.col("__w")) <= atol + rtol * F.abs(F.col("__w"))
            if not both.where(~F.coalesce(same, F.lit(False))).isEmpty():
                return False
        return True

    def apply(self, df: DataFrame, by: Sequence[str], value: str, min_weight: float | None = None) -> DataFrame:
        """Regridded rows: by…, the axes' indices, value. Destination cells that no source reaches have no row."""
        if self.method == "conservative_2nd":
            return self._second_order(df, by, value, min_weight)
        conservative, rows = self.method.startswith("conservative"), df
        rows = rows.select(*by, *self.weights, F.col(value).cast("double").alias("__n"), F.col(value).isNotNull().cast("double").alias("__d")).withColumn("__all", F.lit(1.0))
        rows = rows.withColumn("__n", F.coalesce("__n", F.lit(0.0)))
        done: list[str] = []
        for index, table in self.weights.items():
            rest = [i for i in self.weights if i != index and i not in done]
            joined = rows.join(table.withColumnRenamed("src", index).hint("merge"), index).drop(index)
            w = F.col("w")
            rows = joined.groupBy(*by, *done, *rest, F.col("dst").alias(index)).agg(*[F.sum(F.col(c) * w).alias(c) for c in ("__n", "__d", "__all")])
            done.append(index)
        if conservative:
            least = 1e-12 if min_weight is None else min_weight
            out = F.when(F.col("__d") > least, F.col("__n") / F.col("__d"))
        else:
            least = 1 - 1e-9 if min_weight is None else min_weight
            out = F.when(F.col("__d") >= F.col("__all") * least, F.try_divide(F.col("__n"), F.col("__d")) if min_weight is not None else F.col("__n"))
        return rows.select(*by, *self.weights, out.alias(value))


    def _second_order(self, df: DataFrame, by: Sequence[str], value: str, min_weight: float | None) -> DataFrame:
        rows = df.select(*by, *self.weights, F.col(value).cast("double").alias("__x"))
        for index, table in self.weights.items():
            others = [*by, *[i for i in self.weights if i != index]]
            rows = rows.join(self.middles[index].select(F.col("i").alias(index), "c"), index)
            line = Window.partitionBy(*others).orderBy(index)
            gradient = F.coalesce(F.try_divide(F.lead("__x").over(line) - F.lag("__x").over(line), F.lead("c").over(line) - F.lag("c").over(line)), F.lit(0.0))
            rows = rows.withColumn("__g", gradient).join(table.withColumnRenamed("src", index), index).drop(index)
            there = F.col("__x").isNotNull()
            rows = rows.groupBy(*others, F.col("dst").alias(index)).agg(F.sum(F.col("w") * F.col("__x") + F.col("m") * F.col("__g")).alias("__n"), F.sum(F.when(there, F.col("w"))).alias("__d"))
            least = 1e-12 if min_weight is None else min_weight
            rows = rows.select(*others, index, F.when(F.col("__d") > least, F.col("__n") / F.col("__d")).alias("__x"))
        return rows.select(*by, *self.weights, F.col("__x").alias(value))


def operator(method: str, axes: Mapping[str, tuple[DataFrame, DataFrame]], spherical: bool = False, latitude: str | None = None, periods: Mapping[str, float] | None = None) -> RegridOperator:
    """Build the weights: axes is {data index: (source axis, destination axis)}, axes having i, coord and for conservative methods
    lower and upper. spherical with the latitude's index weighs that axis by the sine of its bounds."""
    if method not in METHODS:
        raise ValueError(f"unknown regridding method {method!r}")
    if method == "patch":
        raise NotImplementedError("patch recovery is not there; use linear or conservative_2nd")
    periods, tables, middles = periods or {}, {}, {}
    for index, (src, dst) in axes.items():
        period = periods.get(index)
        if method.startswith("conservative"):
            by_sine = spherical and index == latitude
            tables[index] = overlap_weights(src, dst, by_sine, period)
            at = _sine if by_sine else (lambda c: c)
            middles[index] = src.select("i", ((at(F.col("lower")) + at(F.col("upper"))) / 2).alias("c"))
        elif method in ("linear", "bilinear"):
            tables[index] = linear_weights(src, dst, period)
        elif method == "nearest_stod":
            tables[index] = nearest_weights(src, dst, period)
        else:  # each source goes to its nearest destination
            tables[index] = nearest_weights(dst, src, period).select(F.col("src").alias("dst"), F.col("dst").alias("src"), "w")
    return RegridOperator(method, tables, parameters={"spherical": spherical, "periods": dict(periods)}, middles=middles)


def regrid(df: DataFrame, by: Sequence[str], value: str, method: str, axes: Mapping[str, tuple[DataFrame, DataFrame]], full: bool = True, **options) -> DataFrame:
    """Regrid and, with full, give every destination cell a row (missing where no source reaches it)."""
    min_weight = options.pop("min_weight", None)
    got = operator(method, axes, **options).apply(df, by, value, min_weight)
    if not full:
        return got
    cells_ = df.select(*by).distinct() if by else None
    for index, (_, dst) in axes.items():
        axis = dst.select(F.col("i").cast("int").alias(index))
        cells_ = axis if cells_ is None else cells_.crossJoin(axis)
    return cells_.join(got, [*by, *axes], "left")
