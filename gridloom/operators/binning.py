"""Digitising, histograms and statistics by bins. Bin edges are one sorted literal array, shared by neighbouring bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.collapse import statistic


def edges_of(df: DataFrame, value: str, n: int) -> list[float]:
    """n equal bins from the least to the greatest value, the outer edges included."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        raise ValueError("no values to put into bins")
    return [float(low + (high - low) * k / n) for k in range(n)] + [float(high)]


def digitize(x: Column, edges: Sequence[float], upper: bool = False, open_ends: bool = False, closed_ends: bool = False) -> Column:
    """Zero-based bin of a value: bins are [a, b), or (a, b] with upper; missing outside all bins.

    open_ends adds a bin below the first edge (0) and one above the last. closed_ends takes both outer edges in.
    """
    e = [float(v) for v in edges]
    if len(e) < 2 or any(b <= a for a, b in zip(e, e[1:])):
        raise ValueError("bin edges must increase")
    if open_ends and closed_ends:
        raise ValueError("ends are open or closed, not both")
    last = len(e) - 1
    found = lambda k: F.lit(k if open_ends else k - 1 if 1 <= k <= last else None).cast("int")
    if len(e) <= 64:
        # One chain, in which every edge is tested once: repeated tests made a method too large to be compiled.
        x = x.cast("double")
        out = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("int"))
        if closed_ends:
            out = out.when(x == e[0], found(1)).when(x == e[-1], found(last))
        for k, edge in enumerate(e):
            out = out.when(x <= edge if upper else x < edge, found(k))
        return out.otherwise(found(len(e)))
    edges = F.array(*[F.lit(v) for v in e])

    def bin_of(v: Column) -> Column:
        k = F.size(F.filter(edges, (lambda b: b < v) if upper else (lambda b: b <= v)))
        if closed_ends:
            k = F.when(v == e[0], 1).when(v == e[-1], last).otherwise(k)
        k = F.when(v.isNotNull() & ~F.isnan(v), k)
        return k if open_ends else F.transform(F.array(k), lambda n: F.when((n >= 1) & (n <= last), n - 1))[0]

    return F.transform(F.array(x.cast("double")), bin_of)[0].cast("int")


def bin_bounds(edges: Sequence[float]) -> list[tuple[float, float]]:
    return list(zip(edges[:-1], edges[1:]))


def _grid(df: DataFrame, bins: dict[str, Sequence[float]]) -> DataFrame:
    """All bins of all digitised variables: a product of axes, not of data."""
    spark, out = df.sparkSession, None
    for name, edges in bins.items():
        axis = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias(name))
        out = axis if out is None else out.crossJoin(axis)
    return out


def histogram(df: DataFrame, bins: dict[str, Sequence[float]], upper: bool = False, closed_ends: bool = True, density: bool = False) -> DataFrame:
    """One row per bin of the product of {column: edges}: the columns as bin numbers, and count, or density (whose integral is 1)."""
    keyed = df.select(*[digitize(F.col(c), e, upper, closed_ends=closed_ends).alias(c) for c, e in bins.items()])
    counts = keyed.dropna().groupBy(*bins).agg(F.count(F.lit(1)).alias("count"))
    full = _grid(df, bins).join(counts, list(bins), "left").withColumn("count", F.coalesce("count", F.lit(0)))
    if not density:
        return full
    volume = F.lit(1.0)
    for c, e in bins.items():
        volume = volume * F.element_at(F.array(*[F.lit(float(b - a)) for a, b in bin_bounds(e)]), F.col(c) + 1)
    total = full.agg(F.sum("count").alias("__all"))
    return full.crossJoin(F.broadcast(total)).select(*bins, (F.col("count") / (F.col("__all") * volume)).alias("density"))


def bin_collapse(df: DataFrame, bins: dict[str, Sequence[float]], value: str, method: str, weights: str | None = None, upper: bool = False, closed_ends: bool = True, ddof: int = 1, mtol: float = 1.0) -> DataFrame:
    """A statistic of value in every bin of the product of {column: edges}; bins without values are missing."""
    keyed = df.withColumns({f"__b{i}": digitize(F.col(c), e, upper, closed_ends=closed_ends) for i, (c, e) in enumerate(bins.items())})
    keys = [f"__b{i}" for i in range(len(bins))]
    stat = statistic(method, F.col(value), F.col(weights) if weights else None, ddof, mtol).alias(value)
    got = keyed.dropna(subset=keys).groupBy(*[F.col(k).alias(c) for k, c in zip(keys, bins)]).agg(stat)
    return _grid(df, bins).join(got, list(bins), "left")
