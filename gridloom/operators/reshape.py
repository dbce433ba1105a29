"""Reshaping: cells keep their values, only their positions change. Positions are dense zero-based columns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, shape: Mapping[str, int]) -> DataFrame:
    """All cells of a shape {index: size}, made from one range by division, without a join."""
    total = 1
    for n in shape.values():
        total *= n
    return unflatten(spark.range(total).withColumnRenamed("id", "__flat"), "__flat", shape)


def full(spark: SparkSession, shape: Mapping[str, int], value, value_col: str = "value", kind: str | None = None) -> DataFrame:
    v = F.lit(value)
    return grid(spark, shape).withColumn(value_col, v.cast(kind) if kind else v)


def zeros(spark: SparkSession, shape: Mapping[str, int], value_col: str = "value") -> DataFrame:
    return full(spark, shape, 0.0, value_col)


def ones(spark: SparkSession, shape: Mapping[str, int], value_col: str = "value") -> DataFrame:
    return full(spark, shape, 1.0, value_col)


def masked_all(spark: SparkSession, shape: Mapping[str, int], value_col: str = "value", kind: str = "double") -> DataFrame:
    return full(spark, shape, None, value_col, kind)


def empty(spark: SparkSession, shape: Mapping[str, int], value_col: str = "value") -> DataFrame:
    return zeros(spark, shape, value_col)


def flat_index(shape: Mapping[str, int]) -> Column:
    """Row-major position of a cell."""
    out = F.lit(0).cast("long")
    for c, n in shape.items():
        out = out * n + F.col(c)
    return out


def unflatten(df: DataFrame, flat: str, shape: Mapping[str, int]) -> DataFrame:
    rest, made = F.col(flat), {}
    for c, n in reversed(list(shape.items())):
        made[c] = F.pmod(rest, F.lit(n)).cast("int")
        rest = F.floor(rest / n).cast("long")
    others = [c for c in df.columns if c != flat]
    return df.select(*[made[c].alias(c) for c in shape], *others)


def reshape(df: DataFrame, old: Mapping[str, int], new: Mapping[str, int]) -> DataFrame:
    a = b = 1
    for n in old.values():
        a *= n
    for n in new.values():
        b *= n
    if a != b:
        raise ValueError(f"{a} cells can't be {b}")
    return unflatten(df.withColumn("__flat", flat_index(old)).drop(*old), "__flat", new)


def flatten(df: DataFrame, axes: Mapping[str, int], into: str) -> DataFrame:
    return df.withColumn(into, flat_index(axes)).drop(*[a for a in axes if a != into])


def transpose(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.select(*order, *[c for c in df.columns if c not in order])


def swapaxes(df: DataFrame, a: str, b: str) -> DataFrame:
    swap = {a: b, b: a}
    return df.select(*[swap.get(c, c) for c in df.columns])


def insert_dimension(df: DataFrame, index: str) -> DataFrame:
    return df.withColumn(index, F.lit(0))


def squeeze(df: DataFrame, index: str) -> DataFrame:
    return df.drop(index)


def pad_missing(df: DataFrame, index: str, size: int, others: Mapping[str, int], value: str, before: int = 0, after: int = 0, to_size: int | None = None) -> DataFrame:
    """Missing cells before and after the axis' own."""
    if to_size is not None:
        before, after = 0, to_size - size
    if before < 0 or after < 0:
        raise ValueError("padding is not negative")
    pad = grid(df.sparkSession, {index: before + after, **others}) if before + after else None
    moved = df.withColumn(index, (F.col(index) + before).cast("int"))
    if pad is None:
        return moved
    at = F.col(index)
    pad = pad.withColumn(index, F.when(at < before, at).otherwise(at + size).cast("int"))
    return moved.select(*others, index, value).unionByName(pad.withColumn(value, F.lit(None).cast(df.schema[value].dataType)))


def compressed(df: DataFrame, shape: Mapping[str, int], value: str) -> DataFrame:
    """The values that are there, with `position`, their place in row-major order among them.

    Counted range by range: values are range-partitioned by position, and each range starts after the counts before it.
    """
    rows = df.where(F.col(value).isNotNull()).select(flat_index(shape).alias("__flat"), value)
    return numbered(rows, "__flat", "position").select("position", value)


def numbered(rows: DataFrame, order: str, name: str, ranges: int = 64) -> DataFrame:
    """A dense zero-based number in order of a column of distinct long values, without one window over all rows.

    The order's range is cut into equal widths; a width's start is the count of what lies before it.
    """
    from pyspark.sql import Window

    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return rows.withColumn(name, F.lit(0).cast("long"))
    width = max(1, -(-(high - low + 1) // ranges))
    part = F.floor((F.col(order) - low) / width).cast("int")
    parts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    starts = parts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    keyed = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")  # at most `ranges` rows
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return keyed.withColumn(name, (F.col("__start") + place).cast("long")).drop("__part", "__start")


def take(df: DataFrame, index: str, picked: Sequence[int] | slice, size: int) -> DataFrame:
    """Orthogonal subspace along one axis by positions, which may be negative, reversed or wrap around a cyclic axis (a list).

    The axis stays, renumbered in the order asked. A slice is arithmetic; a list is a literal look-up.
    """
    if isinstance(picked, slice):
        start, stop, step = picked.indices(size)
        n = len(range(start, stop, step))
        at = F.col(index) - start
        ok = (at % step == 0) & (at / step >= 0) & (at / step < n)
        return df.where(ok).withColumn(index, F.floor((F.col(index) - start) / step).cast("int"))
    places = [p % size if -size <= p < 0 else p for p in picked]
    if any(not 0 <= p < size for p in places):
        raise IndexError(f"a position is out of range for {size} cells")
    lookup = F.create_map(*[F.lit(x) for p in dict.fromkeys(places) for x in (p, [i for i, q in enumerate(places) if q == p])]) if places else None
    if lookup is None:
        return df.limit(0)
    return df.where(F.col(index).isin(*dict.fromkeys(places))).withColumn(index, F.explode(F.element_at(lookup, F.col(index))))


def sections(df: DataFrame, index: str, size: int) -> Iterator[tuple[int, DataFrame]]:
    """The slices along an axis, each a lazy filter."""
    for i in range(size):
        yield i, df.where(F.col(index) == i).drop(index)


def element(df: DataFrame, shape: Mapping[str, int], value: str, position: int):
    """One cell's value by its row-major position, negative from the end."""
    total = 1
    for n in shape.values():
        total *= n
    at = position % total if -total <= position < total else None
    if at is None:
        raise IndexError(position)
    row = df.where(flat_index(shape) == at).select(value).first()
    return None if row is None else row[0]
