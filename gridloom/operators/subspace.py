"""Subspaces by conditions on coordinates.

A condition on a one-dimensional coordinate selects positions of its axis; the cells of the data follow by a semi-join
on the axis' position. Mode compress keeps the cells; envelope keeps the span from the first to the last selected
position and makes the rest in it missing; full keeps every cell and makes what isn't selected missing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.calendars import timestamp_parts
from gridloom.functions.query import Query
from gridloom.functions.units import NONE, Units


def axis_columns(axis: DataFrame, coord: str = "coord", lower: str = "lower", upper: str = "upper") -> dict[str, Column]:
    """The columns that conditions look at, with the date parts of a timestamp coordinate."""
    out = {"coord": F.col(coord)}
    if lower in axis.columns and upper in axis.columns:
        out |= {"lower": F.col(lower), "upper": F.col(upper), "cellsize": F.abs(F.col(upper) - F.col(lower)), "lower_bounds": F.least(lower, upper), "upper_bounds": F.greatest(lower, upper)}
    kind = axis.schema[coord].dataType.typeName() if coord in axis.columns else ""
    if kind.startswith("timestamp") or kind == "date":
        out |= timestamp_parts(F.col(coord))
    return out


def select_positions(axis: DataFrame, index: str, condition: Query | Column, units: Units = NONE, coord: str = "coord", period: float | None = None) -> DataFrame:
    """The axis' rows that satisfy the condition. On a cyclic axis, `within` a range holds modulo the period."""
    if isinstance(condition, Query):
        if period is not None and condition.op in ("wi", "wo") and not condition.attr:
            return axis.where(cyclic_within(F.col(coord), condition, units, period))
        condition = condition.column(axis_columns(axis, coord), units)
    return axis.where(condition)


def cyclic_within(x: Column, q: Query, units: Units, period: float) -> Column:
    """wi: x lies in the range going up from its first to its second value, modulo the period; wo: the complement."""
    low, high = (float(v) for v in q._in(units))
    span = high - low if high >= low else (high - low) % period
    if span >= period:
        if q.op == "wo":
            raise ValueError("the range covers the whole cyclic axis")
        return x.isNotNull()
    at = F.pmod(x - low, F.lit(float(period)))
    inside = at <= span
    if q.op == "wi":
        if q.options.get("open_lower"):
            inside = inside & (at > 0)
        if q.options.get("open_upper"):
            inside = inside & (at < span)
        return inside
    return ~inside


def rebased(x: Column, start: float, period: float) -> Column:
    """A cyclic coordinate within one period from start on."""
    return F.pmod(x - start, F.lit(float(period))) + start


def subspace(data: DataFrame, selected: Mapping[str, DataFrame], value: str, mode: str = "compress", halo: int = 0, sizes: Mapping[str, int] | None = None) -> DataFrame:
    """data restricted to the selected axis rows {index: axis rows}; halo widens each selection by so many positions."""
    if mode not in ("compress", "envelope", "full"):
        raise ValueError(f"mode {mode!r} is not one of compress, envelope, full")
    out = data
    for index, rows in selected.items():
        keep = rows.select(index).distinct()
        if halo:
            widened = F.explode(F.sequence(F.col(index) - halo, F.col(index) + halo).cast("array<int>")).alias(index)
            keep = keep.select(widened).distinct().where(F.col(index) >= 0)
            if sizes and index in sizes:
                keep = keep.where(F.col(index) < sizes[index])
        if mode == "compress":
            out = out.join(keep, index, "left_semi")
            continue
        if mode == "envelope":
            # One row with the first and last selected position.
            span = keep.agg(F.min(index).alias("__lo"), F.max(index).alias("__hi"))
            out = out.crossJoin(F.broadcast(span)).where(F.col(index).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
        out = out.join(keep.withColumn("__in", F.lit(True)), index, "left").withColumn(value, F.when(F.col("__in"), F.col(value))).drop("__in")
    return out


def domain_mask(data: DataFrame, selected: Mapping[str, DataFrame]) -> DataFrame:
    """data's positions with `mask`: true where a cell isn't selected."""
    out = data
    for k, (index, rows) in enumerate(selected.items()):
        out = out.join(rows.select(index).distinct().withColumn(f"__in{k}", F.lit(True)), index, "left")
    inside = F.lit(True)
    for k in range(len(selected)):
        inside = inside & F.coalesce(f"__in{k}", F.lit(False))
    return out.withColumn("mask", ~inside).drop(*[f"__in{k}" for k in range(len(selected))])


def point_in_polygon(points: DataFrame, cells: DataFrame, x: str, y: str, vertices: str = "vertices", cell: str = "cell", tile: float = 1.0) -> DataFrame:
    """Pairs of a point and a cell whose polygon holds it; cells have an array of (x, y) structs.

    Points and cells meet by square tiles of a bounding box, so that this is an equi-join and not a test of all pairs; then a
    ray is cast.
    """
    v = F.col(vertices)
    lo = lambda c: F.floor(F.array_min(F.transform(v, lambda p: p[c])) / tile).cast("long")
    hi = lambda c: F.floor(F.array_max(F.transform(v, lambda p: p[c])) / tile).cast("long")
    tiled = cells.withColumn("__tx", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("__ty", F.explode(F.sequence(lo("y"), hi("y"))))
    tiled = tiled.withColumn("__next", F.concat(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, 1)))
    keyed = points.withColumns({"__tx": F.floor(F.col(x) / tile).cast("long"), "__ty": F.floor(F.col(y) / tile).cast("long")})
    both = keyed.join(tiled, ["__tx", "__ty"])

    def crosses(e: Column) -> Column:
        a, b = e[vertices], e["__next"]
        straddles = (a["y"] > F.col(y)) != (b["y"] > F.col(y))
        at = F.try_divide((b["x"] - a["x"]) * (F.col(y) - a["y"]), b["y"] - a["y"]) + a["x"]
        return straddles & (F.col(x) < at)

    inside = F.size(F.filter(F.arrays_zip(vertices, "__next"), crosses)) % 2 == 1
    return both.where(inside).select(*points.columns, cell)
