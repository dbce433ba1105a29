"""Arrays compressed by convention and their plain form: ragged, gathered and subsampled data, meshes and fragments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.reshape import flat_index, grid, unflatten
from gridloom.operators.windows import BLOCK, cumsum

#: Pairs of nodes that a task tells apart, about.
PAIRS = 2_000_000


def ragged_contiguous(obs: DataFrame, counts: DataFrame, instance: str = "i_station", count: str = "row_size", index: str = "i_obs", element: str = "i_element") -> DataFrame:
    """obs in order of index, counts rows per instance: adds each observation's instance and its place in it.

    Starts are running sums over the instances; observations join by position, each instance's positions listed.
    """
    spans = _starts(counts, instance, count).where(F.col(count) > 0)
    # The places of a long instance come from runs of bounded length.
    runs = spans.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / BLOCK)))).repartition(instance, "__run")
    first, last = F.col("__run") * BLOCK, F.least((F.col("__run") + 1) * BLOCK, F.col(count)) - 1
    places = runs.withColumn(element, F.explode(F.sequence(first, last))).select(instance, F.col(element).cast("int").alias(element), (F.col("__start") + F.col(element)).alias("__at"))
    return obs.join(places, obs[index] == places["__at"]).drop("__at")


def _starts(counts: DataFrame, instance: str, count: str) -> DataFrame:
    """counts with __start, the sum of the counts of the instances before, block by block."""
    rows = counts.select(instance, count, F.coalesce(F.col(count).cast("long"), F.lit(0)).alias("__start"))
    return cumsum(rows, [], instance, "__start").withColumn("__start", F.col("__start") - F.coalesce(F.col(count).cast("long"), F.lit(0)))


def ragged_indexed(obs: DataFrame, instance: str = "i_station", index: str = "i_obs", element: str = "i_element") -> DataFrame:
    """obs with its instance in a column: adds its place among the instance's observations."""
    return obs.withColumn(element, (F.row_number().over(Window.partitionBy(instance).orderBy(index)) - 1).cast("int"))


def ragged_indexed_contiguous(obs: DataFrame, profiles: DataFrame, instance: str = "i_station", profile: str = "i_profile", count: str = "row_size", index: str = "i_obs") -> DataFrame:
    """Profiles of varying length that belong to instances: adds instance, the profile's place in it and the element's in that."""
    named = ragged_indexed(profiles, instance, profile, "i_profile_element")
    with_profile = ragged_contiguous(obs, profiles.select(profile, count), profile, count, index)
    return with_profile.join(named.select(profile, instance, "i_profile_element"), profile)


def to_ragged_contiguous(cells: DataFrame, instance: str, element: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Dense cells -> (obs with i_obs, counts): missing cells after an instance's last value go."""
    there = cells.where(F.col(value).isNotNull())
    counts = there.groupBy(instance).agg((F.max(element) + 1).alias("row_size"))
    kept = cells.join(counts, instance).where(F.col(element) < F.col("row_size"))
    starts = _starts(counts, instance, "row_size").select(instance, "__start")
    return kept.join(starts, instance).select((F.col("__start") + F.col(element)).alias("i_obs"), value), counts


def gathered(data: DataFrame, listing: DataFrame, shape: Mapping[str, int], position: str = "i_list", full: bool = True, others: Mapping[str, int] | None = None, value: str = "value") -> DataFrame:
    """Uncompress data at listed flat positions of a shape: listing has (i_list, flat). full: all other cells are there, missing."""
    out = unflatten(data.join(listing.select(position, F.col("flat").alias("__flat")), position).drop(position), "__flat", shape)
    if not full:
        return out
    keys = {**(others or {}), **shape}
    return grid(data.sparkSession, keys).join(out, list(keys), "left")


def gather(data: DataFrame, shape: Mapping[str, int], value: str = "value") -> DataFrame:
    """The flat positions of a shape that hold any value: (i_list, flat) in order."""
    flat = data.where(F.col(value).isNotNull()).select(flat_index(shape).alias("flat")).distinct()
    from gridloom.operators.reshape import numbered

    return numbered(flat, "flat", "i_list")


def _areas(ties: DataFrame, axis: str, by: Sequence[str], value: str) -> DataFrame:
    """Neighbouring tie points: from axis to __hi, with the values at both."""
    w = Window.partitionBy(*by).orderBy(axis)
    rows = ties.withColumns({"__hi": F.lead(axis).over(w), "__v1": F.lead(value).over(w)})
    return rows.where("__hi IS NOT NULL")


def subsampled_linear(ties: DataFrame, axis: str, by: Sequence[str], value: str) -> DataFrame:
    """Tie points (axis position, value) of one axis -> every position between them, by linear interpolation. Two adjacent tie points
    bound two areas, between which nothing is to be filled."""
    spans = _areas(ties, axis, by, value)
    s = F.col("__at") - F.col(axis)
    n = F.col("__hi") - F.col(axis)
    first = ties.groupBy(*by).agg(F.min(axis).alias("__first")) if by else ties.agg(F.min(axis).alias("__first"))
    filled = spans.withColumn("__at", F.explode(F.sequence(F.col(axis) + 1, F.col("__hi")))).select(*by, F.col("__at").alias(axis), (F.col(value) + (F.col("__v1") - F.col(value)) * s / n).alias(value))
    start = ties.join(first, list(by)) if by else ties.crossJoin(F.broadcast(first))
    return filled.unionByName(start.where(F.col(axis) == F.col("__first")).select(*by, axis, value))


def subsampled_bilinear(ties: DataFrame, x: str, y: str, by: Sequence[str], value: str) -> DataFrame:
    """Both axes, one after the other."""
    return subsampled_linear(subsampled_linear(ties, x, [*by, y], value), y, [*by, x], value)


def subsampled_quadratic(ties: DataFrame, axis: str, by: Sequence[str], value: str, w: str) -> DataFrame:
    """Linear interpolation plus 4 w s (1 - s), w being the area's coefficient at its first tie point."""
    plain = subsampled_linear(ties, axis, by, value)
    spans = _areas(ties, axis, by, value)
    s = (F.col("__at") - F.col(axis)) / (F.col("__hi") - F.col(axis))
    extra = spans.withColumn("__at", F.explode(F.sequence(F.col(axis) + 1, F.col("__hi")))).select(*by, F.col("__at").alias(axis), (4 * F.coalesce(F.col(w), F.lit(0.0)) * s * (1 - s)).alias("__extra"))
    return plain.join(extra, [*by, axis], "left").select(*by, axis, (F.col(value) + F.coalesce("__extra", F.lit(0.0))).alias(value))


def bounds_from_nodes(connectivity: DataFrame, nodes: DataFrame, cell: str = "cell", place: str = "k", node: str = "node") -> DataFrame:
    """Cells' vertices: connectivity (cell, place, node) and nodes (node, x, y) -> cell, vertices."""
    return connectivity.join(nodes, node).groupBy(cell).agg(F.transform(F.sort_array(F.collect_list(F.struct(place, "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("vertices"))


def cell_connectivity(connectivity: DataFrame, cell: str = "cell", place: str = "k", node: str = "node") -> DataFrame:
    """Pairs of cells that share an edge, in both directions."""
    w = Window.partitionBy(cell).orderBy(place)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = F.coalesce(F.lead(node).over(w), F.first(node).over(whole))
    edges = connectivity.select(F.col(cell).alias("cell"), F.least(F.col(node), nxt).alias("a"), F.greatest(F.col(node), nxt).alias("b"))
    both = edges.join(edges.withColumnRenamed("cell", "neighbour"), ["a", "b"])
    return both.where("cell <> neighbour").select("cell", "neighbour").distinct()


def point_topology(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of nodes joined by an edge, in both directions, dealt out by node.

    Edges are counted first: as many partitions as keep each to PAIRS rows or so, as a task tells the pairs of a partition apart in memory.
    Pairs are dealt once, and counts by node need no further exchange.
    """
    spark = edges.sparkSession
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * edges.count() // PAIRS))
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("neighbour")))
    return both.repartition(many, "node").distinct()


def aggregated(spark: SparkSession, manifest: Sequence[Mapping], value: str = "value") -> DataFrame:
    """A variable made of fragments in files of any readable format: manifest rows have path, format (parquet, netcdf3, zarr), variable,
    start ({index: offset}) and, for a constant fragment, value and size ({index: n})."""
    from gridloom.sources import netcdf3, zarr

    out = None
    for m in manifest:
        if "value" in m and "path" not in m:
            part = grid(spark, m["size"]).withColumn(value, F.lit(m["value"]))
        elif m["format"] == "parquet":
            part = spark.read.parquet(m["path"]).withColumnRenamed(m.get("variable", value), value)
        else:
            reader = {"netcdf3": netcdf3.read, "zarr": zarr.read}[m["format"]]
            part = reader(spark, m["path"], m.get("variable", value)).withColumnRenamed(m.get("variable", value), value)
        for index, offset in m["start"].items():
            part = part.withColumn(index, (F.col(index) + offset).cast("int"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fragments")
    return out


def constant(column: str, value) -> Column:
    """A constant array: one literal for all cells."""
    return F.lit(value).alias(column)
