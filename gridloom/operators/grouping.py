"""Groups along an axis for collapses: by number, width, period, runs of a condition, and climatological stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.calendars import TimeDuration, decode, epoch_seconds
from gridloom.functions.query import Query
from gridloom.functions.units import Units
from gridloom.operators.collapse import statistic


def by_number(index: Column, n: int) -> Column:
    """Runs of n cells by a zero-based position."""
    return F.floor(index / n).cast("int")


def by_width(coord: Column, width: float, origin: float = 0.0) -> Column:
    return F.floor((coord - origin) / width).cast("long")


def by_period(t: Column, duration: TimeDuration) -> Column:
    return duration.bucket(t)


def by_calendar(coord: Column, units: Units, duration: TimeDuration) -> Column:
    """A number for the period that a reference time of any calendar lies in."""
    shift = (duration.day - 1) * 86400 * (duration.months is not None) + duration.hour * 3600 + duration.minute * 60 + duration.second
    if duration.months is None:
        return F.floor((coord * units.scale + epoch_seconds(units.epoch, units.calendar) - shift) / duration.seconds).cast("long")
    parts = decode(coord - shift / units.scale, units)
    n = parts["year"] * 12 + parts["month"] - 1 - (duration.month - 1 if duration.unit == "year" else 0)
    return F.floor(n / duration.months).cast("long")


def first_match(conditions: Sequence[Column]) -> Column:
    """Number of the first condition that holds; null if none does."""
    out = F.lit(None).cast("int")
    for k, c in reversed(list(enumerate(conditions))):
        out = F.when(c, k).otherwise(out)
    return out


def runs(axis: DataFrame, index: str, conditions: Sequence[Column]) -> DataFrame:
    """axis (one row per cell of an axis, in order of index) with `group`: a number for each run of consecutive cells that match the
    same condition; cells that match none are left out.

    The running count goes over one axis' cells, not over the data.
    """
    w = Window.orderBy(index)
    labelled = axis.withColumn("__c", first_match(conditions))
    changed = F.coalesce((~F.col("__c").eqNullSafe(F.lag("__c").over(w))).cast("int"), F.lit(1))
    labelled = labelled.withColumn("group", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return labelled.where("__c IS NOT NULL").drop("__c")


def complete_groups(axis: DataFrame, index: str, group: str = "group", lower: str | None = None, upper: str | None = None, span: float | Column | None = None, contiguous: int = 0, size: int | None = None) -> DataFrame:
    """The groups that are whole: their bounds span exactly `span`, they have `size` cells, and by `contiguous` 1 their cells leave no
    gaps, by 2 don't overlap either."""
    w = Window.partitionBy(group).orderBy(index)
    rows = axis
    ok = F.lit(True)
    if contiguous and lower:
        step = F.col(lower) - F.lag(upper).over(w)
        rows = rows.withColumn("__gap", step)
        zero = F.col("__gap") * 0 if contiguous else None
        ok = ok & F.coalesce(F.bool_and((F.col("__gap") <= zero) if contiguous == 1 else (F.col("__gap") == zero)), F.lit(True))
    if size is not None:
        ok = ok & (F.count(F.lit(1)) == size)
    if span is not None:
        ok = ok & (F.max(upper) - F.min(lower) == span)
    return rows.groupBy(group).agg(ok.alias("__ok")).where("__ok").select(group)


def grouped_collapse(df: DataFrame, group: Column, by: Sequence[str], value: str, method: str, weights: str | None = None, mtol: float = 1.0, ddof: int = 1) -> DataFrame:
    return df.groupBy(*by, group.alias("group")).agg(statistic(method, F.col(value), F.col(weights) if weights else None, ddof, mtol).alias(value))


def season_of(conditions: Sequence[Query], parts: dict[str, Column]) -> Column:
    return first_match([q.column(parts) for q in conditions])


def climatology(df: DataFrame, t: Column, by: Sequence[str], value: str, within: Column, within_method: str, over: Column | None, over_method: str, year: Column | None = None, mtol: float = 1.0, ddof: int = 1) -> DataFrame:
    """Two stages: a statistic within each year (or day) for each portion `within`, then one across the years (days) of each portion.

    year: what the first stage keeps apart (default: the calendar year); over: groups of the second stage, such as decades.
    """
    first = df.groupBy(*by, within.alias("within"), (F.year(t) if year is None else year).alias("__unit"), *([over.alias("over")] if over is not None else [])).agg(statistic(within_method, F.col(value), None, ddof, mtol).alias("__first"))
    first = first.where("within IS NOT NULL")
    keys = [*by, "within", *(["over"] if over is not None else [])]
    return first.groupBy(*keys).agg(statistic(over_method, F.col("__first"), None, ddof, mtol).alias(value))


def season_year(t: Column, first_month: int = 12) -> Column:
    """The year that a season which starts in first_month and crosses the year's end belongs to: that of its last month."""
    return F.year(t) + F.when(F.month(t) >= first_month, 1).otherwise(0)
