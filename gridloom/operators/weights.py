"""Weights for collapses: cell sizes, areas, lengths and volumes, as columns of axis or cell tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH = 6371229.0


def cellsize(lower: Column, upper: Column) -> Column:
    return F.abs(upper - lower)


def linear(lower: Column, upper: Column) -> Column:
    """Weight along one axis."""
    return cellsize(lower, upper)


def longitude(lower: Column, upper: Column, measure: bool = False, radius: float = EARTH) -> Column:
    """Width in radians of cells given in degrees; times the radius as a measure."""
    return F.radians(F.abs(upper - lower)) * (radius if measure else 1.0)


def latitude(lower: Column, upper: Column, measure: bool = False, radius: float = EARTH) -> Column:
    """Difference of the sines of bounds in degrees, which are held to the poles."""
    sine = lambda c: F.sin(F.radians(F.when(c > 90, 90.0).when(c < -90, -90.0).otherwise(c)))
    return F.abs(sine(upper) - sine(lower)) * (radius if measure else 1.0)


def area(lon_lower: Column, lon_upper: Column, lat_lower: Column, lat_upper: Column, measure: bool = False, radius: float = EARTH) -> Column:
    return longitude(lon_lower, lon_upper, measure, radius) * latitude(lat_lower, lat_upper, measure, radius)


def healpix_area(refinement_level: Column, measure: bool = False, radius: float = EARTH) -> Column:
    """Areas of cells of a refinement level: pi r^2 / (3 4^level), or relative to the coarsest cell."""
    relative = F.pow(F.lit(0.25), refinement_level)
    return relative * (math.pi * radius**2 / 3) if measure else relative


def _edges(x: Column, y: Column) -> Column:
    """Array of (x0, y0, x1, y1) around a ring given by arrays; a repeated first vertex at the end does no harm."""
    nxt = lambda a: F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1))
    return F.arrays_zip(x.alias("x0"), y.alias("y0"), nxt(x).alias("x1"), nxt(y).alias("y1"))


def _total(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + term(e))


def plane_polygon_area(x: Column, y: Column) -> Column:
    """Shoelace formula."""
    return F.abs(_total(_edges(x, y), lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"])) / 2


def spherical_polygon_area(lon: Column, lat: Column, radius: float = 1.0) -> Column:
    """Area of a polygon with great-circle edges, vertices in degrees.

    Each edge adds the signed excess of the figure between it and the equator, 2 atan(tan(dlon/2) sin(mean lat) / cos(dlat/2)).
    A ring around a pole closes over it.
    """
    def term(e: Column) -> Column:
        d = F.radians(F.pmod(e["x1"] - e["x0"] + 180.0, F.lit(360.0)) - 180.0)
        mean, half = F.radians((e["y0"] + e["y1"]) / 2), F.radians((e["y1"] - e["y0"]) / 2)
        return 2 * F.atan2(F.tan(d / 2) * F.sin(mean), F.cos(half))

    def turn(e: Column) -> Column:
        return F.pmod(e["x1"] - e["x0"] + 180.0, F.lit(360.0)) - 180.0

    edges = _edges(lon, lat)
    excess, around = F.abs(_total(edges, term)), F.abs(_total(edges, turn))
    return F.when(around > 180.0, 2 * math.pi - excess).otherwise(excess) * radius**2


def plane_line_length(x: Column, y: Column) -> Column:
    return _total(_open_edges(x, y), lambda e: F.sqrt((e["x1"] - e["x0"]) ** 2 + (e["y1"] - e["y0"]) ** 2))


def _open_edges(x: Column, y: Column) -> Column:
    n = F.greatest(F.size(x) - 1, F.lit(0))
    return F.arrays_zip(F.slice(x, 1, n).alias("x0"), F.slice(y, 1, n).alias("y0"), F.slice(x, 2, n).alias("x1"), F.slice(y, 2, n).alias("y1"))


def great_circle_length(lon: Column, lat: Column, radius: float = 1.0) -> Column:
    """Length of a line of great-circle arcs, vertices in degrees; exact for short and for nearly opposite points."""
    def arc(e: Column) -> Column:
        a, b, d = F.radians(e["y0"]), F.radians(e["y1"]), F.radians(e["x1"] - e["x0"])
        across = F.sqrt((F.cos(b) * F.sin(d)) ** 2 + (F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)) ** 2)
        return F.atan2(across, F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d))

    return _total(_open_edges(lon, lat), arc) * radius


def geometry_area(nodes: DataFrame, cell: str, part: str, node: str, x: str, y: str, interior: str | None = None, spherical: bool = True, radius: float = 1.0) -> DataFrame:
    """Areas of polygon cells from one row per node: parts add up, interior rings are taken off."""
    rings = nodes.groupBy(cell, part).agg(F.sort_array(F.collect_list(F.struct(node, F.col(x).alias("x"), F.col(y).alias("y")))).alias("v"), *([F.bool_or(interior).alias("hole")] if interior else [F.lit(False).alias("hole")]))
    size = (lambda a, b: spherical_polygon_area(a, b, radius)) if spherical else plane_polygon_area
    return rings.groupBy(cell).agg(F.sum(F.when(F.col("hole"), -1).otherwise(1) * size(F.col("v.x"), F.col("v.y"))).alias("area"))


def geometry_length(nodes: DataFrame, cell: str, part: str, node: str, x: str, y: str, spherical: bool = True, radius: float = 1.0) -> DataFrame:
    lines = nodes.groupBy(cell, part).agg(F.sort_array(F.collect_list(F.struct(node, F.col(x).alias("x"), F.col(y).alias("y")))).alias("v"))
    size = (lambda a, b: great_circle_length(a, b, radius)) if spherical else plane_line_length
    return lines.groupBy(cell).agg(F.sum(size(F.col("v.x"), F.col("v.y"))).alias("length"))


def volume(area_: Column, z_lower: Column, z_upper: Column) -> Column:
    return area_ * F.abs(z_upper - z_lower)


def scaled(df: DataFrame, weights: str, scale: float = 1.0) -> DataFrame:
    """Weights times scale over their greatest."""
    if scale <= 0:
        raise ValueError("the scale is positive")
    greatest = df.agg(F.max(weights).alias("__max"))
    return df.crossJoin(F.broadcast(greatest)).withColumn(weights, F.col(weights) * scale / F.col("__max")).drop("__max")


def positive(df: DataFrame, weights: str) -> DataFrame:
    """The same rows; fails where a weight is not positive when it is read."""
    bad = F.raise_error(F.concat(F.lit("a weight is not positive: "), F.col(weights).cast("string")))
    return df.withColumn(weights, F.when(F.col(weights) > 0, F.col(weights)).when(F.col(weights).isNull(), F.lit(None)).otherwise(bad.cast("double")))


def contiguous(axis: DataFrame, index: str = "i", lower: str = "lower", upper: str = "upper", overlap: bool = True) -> bool:
    """Whether an axis' cells leave no gaps (and with overlap False, don't overlap)."""
    w, low, high = Window.orderBy(index), F.least(lower, upper), F.greatest(lower, upper)  # an axis' rows
    rising = F.last(low + high).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) >= F.first(low + high).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gap = F.when(rising, low - F.lag(high).over(w)).otherwise(F.lag(low).over(w) - high)
    least, most = axis.select(gap.alias("gap")).agg(F.min("gap"), F.max("gap")).first()
    return most is None or (most <= 0 and (overlap or least == 0))


def create_bounds(axis: DataFrame, index: str = "i", coord: str = "coord", cellsize: float | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Adds lower and upper: half-way to the neighbours, or cellsize around each coordinate; held to low and high."""
    w = Window.orderBy(index)
    if cellsize is not None:
        a, b = F.col(coord) - cellsize / 2, F.col(coord) + cellsize / 2
    else:
        before, after = (F.col(coord) + F.lag(coord).over(w)) / 2, (F.col(coord) + F.lead(coord).over(w)) / 2
        a, b = F.coalesce(before, 2 * F.col(coord) - after), F.coalesce(after, 2 * F.col(coord) - before)
    hold = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), c)) if low is not None or high is not None else c
    return axis.withColumns({"lower": hold(a), "upper": hold(b)})


def regular_axis(spark, start: float, stop: float, size: float) -> DataFrame:
    """Cells of equal size from start to stop: i, coord, lower, upper."""
    n = round((stop - start) / size)
    if n < 1 or abs(start + n * size - stop) > 1e-9 * max(abs(stop), 1):
        raise ValueError("the range is no whole number of cells")
    i = F.col("id")
    return spark.range(n).select(i.cast("int").alias("i"), (F.lit(start) + (i + 0.5) * size).alias("coord"), (F.lit(start) + i * size).alias("lower"), (F.lit(start) + (i + 1) * size).alias("upper"))


def mesh_area(faces: DataFrame, nodes: DataFrame, spherical: bool = True, radius: float = 1.0, x: str = "lon", y: str = "lat") -> DataFrame:
    """(face, area) of a mesh: faces (face, corner in order, node), nodes (node, x, y). Edges are great circles, or straight on a plane."""
    rings = _rings(faces, nodes, x, y)
    area_ = spherical_polygon_area(F.col("xs"), F.col("ys"), radius) if spherical else plane_polygon_area(F.col("xs"), F.col("ys"))
    return rings.select("face", F.abs(area_).alias("area"))


def mesh_edge_length(edges: DataFrame, nodes: DataFrame, spherical: bool = True, radius: float = 1.0, x: str = "lon", y: str = "lat") -> DataFrame:
    """(edge, length) of a mesh: edges (edge, corner 0 and 1 or more, node)."""
    lines = _rings(edges.withColumnRenamed("edge", "face"), nodes, x, y)
    length = great_circle_length(F.col("xs"), F.col("ys"), radius) if spherical else plane_line_length(F.col("xs"), F.col("ys"))
    return lines.select(F.col("face").alias("edge"), length.alias("length"))


def _rings(faces: DataFrame, nodes: DataFrame, x: str, y: str) -> DataFrame:
    at = faces.join(nodes.select("node", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "node")
    found = at.groupBy("face").agg(F.sort_array(F.collect_list(F.struct("corner", "x", "y"))).alias("v"))
    return found.select("face", F.transform("v", lambda e: e["x"]).alias("xs"), F.transform("v", lambda e: e["y"]).alias("ys"))


def mesh_edges(faces: DataFrame) -> DataFrame:
    """(a, b, faces): the edges of a mesh by their nodes a < b, and how many faces have each."""
    corners = F.sort_array(F.collect_list(F.struct("corner", "node")))
    rings = faces.groupBy("face").agg(F.transform(corners, lambda e: e["node"]).alias("n"))
    pairs = rings.select(F.explode(F.zip_with("n", F.concat(F.slice("n", F.lit(2), F.size("n") - 1), F.slice("n", 1, 1)), lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")))).alias("e"))
    return pairs.where("e.a <> e.b").groupBy("e.a", "e.b").agg(F.count("*").alias("faces"))
