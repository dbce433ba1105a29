"""Aggregation of many fields by rules, as jobs over a table of signatures: the number of jobs depends on the axes, not on the fields.

Fields are rows of three tables. Each field and axis gets a signature (a hash of its coordinates and bounds, size, ends, outer bounds, and which
cell condition all its cells fit). Axis after axis, fields that agree in all but that axis make a line; a line is put in order by its first
coordinates, and if no interval meets the next one wrongly, its fields become one, whose signature is the line's. Only then are the cells moved,
in one join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.calendars import TimeDuration, decode
from gridloom.functions.units import Units
from gridloom.sources.folders import written


@dataclass(frozen=True)
class CellCondition:
    """What all cells of an axis have to be for two fields to be joined along it: a size, a fixed or a calendar one, and a spacing if given."""

    size: TimeDuration
    spacing: TimeDuration | None = None

    @property
    def label(self) -> str:
        return self.size.iso if self.spacing is None else f"{self.size.iso} every {self.spacing.iso}"


def climatology_cells(years: bool = True, months: bool = True, days: Sequence[float] = (1,), hours: Sequence[float] = (1, 3, 6), minutes: Sequence[float] = (), seconds: Sequence[float] = (), days_instantaneous: bool = False, hours_instantaneous: bool = True, minutes_instantaneous: bool = True, seconds_instantaneous: bool = True) -> list[CellCondition]:
    """Conditions for the usual frequencies of a time axis, shortest first: cells of so many seconds to days, for instantaneous ones cells of no size
    so far apart, cells of a calendar month and of a calendar year."""
    out = []
    for unit, lengths, instantaneous in (("second", seconds, seconds_instantaneous), ("minute", minutes, minutes_instantaneous), ("hour", hours, hours_instantaneous), ("day", days, days_instantaneous)):
        for n in sorted(lengths):
            out.append(CellCondition(TimeDuration(n, unit)))
            if instantaneous:
                out.append(CellCondition(TimeDuration(0, unit), TimeDuration(n, unit)))
    return out + [CellCondition(TimeDuration(1, "month"))] * months + [CellCondition(TimeDuration(1, "year"))] * years


def _lasts(a: Column, b: Column, d: TimeDuration, units: Units) -> Column:
    """Whether the time from a to b, in the axis' units, is a duration; calendar months are counted in the units' calendar."""
    if d.months is None:
        return F.abs((b - a) * units.scale - d.seconds) <= 1e-6 * F.greatest(F.lit(1.0), F.lit(float(d.seconds)))
    x, y = (decode(c.cast("double"), units) for c in (a, b))
    rest = [F.abs(x[k].cast("double") - y[k].cast("double")) < 1e-3 for k in ("day", "hour", "minute", "second")]
    same = (y["year"] - x["year"]) * 12 + y["month"] - x["month"] == d.months
    for r in rest:
        same = same & r
    return same


@dataclass(frozen=True)
class Aggregated:
    """fields (field: the least id of those joined, the columns of fields, parts: how many), axes and cells with fields and positions renumbered,
    members (field, into, offset_<axis>…) and ancillaries (field, axis, i, name, text): values of properties that differed along the axis."""

    fields: DataFrame
    axes: DataFrame
    cells: DataFrame
    members: DataFrame
    ancillaries: DataFrame | None = None


def aggregate_table(fields: DataFrame, axes: DataFrame, cells: DataFrame, value: str = "value", same: Sequence[str] = (), order: Sequence[str] | None = None, contiguous: bool = False, overlap: bool = True, relaxed_units: bool = False, conditions: Mapping[str, Sequence[CellCondition]] | None = None, axis_units: Mapping[str, Units] | None = None, dimension: Sequence[str] = (), ancillaries: Sequence[str] = ()) -> Aggregated:
    """fields (field, name, units, …), axes (field, axis, i, coord[, lower, upper]), cells (field, i_<axis>…, value) -> as few fields as possible.

    Fields join if their name, equivalent units (undefined ones are like each other only with relaxed_units), axes and the columns `same` agree and they differ along one axis
    at a time, taken in `order` (default: by name). Coordinates must not meet; bounds must not overlap unless `overlap`, nor leave a gap if `contiguous`.
    conditions: {axis: conditions, the first that all cells fit counts}; fields of different ones aren't joined, and axis_units tells the axis' units.
    dimension: numeric columns of fields that become axes of one cell first; ancillaries: columns that may differ and are kept by position of the axis joined.
    Values are converted to the units of the joined field's first part. A line that breaks a rule stays as it was, whole. Null ids take no part.
    """
    fields, axes = fields.where("field IS NOT NULL"), axes.where("field IS NOT NULL")
    plain = [c for c in ("lower", "upper") if c not in axes.columns]
    axes = axes.withColumns({c: F.lit(None).cast("double") for c in plain}).select("field", "axis", F.col("i").cast("int").alias("i"), F.col("coord").cast("double").alias("coord"), F.col("lower").cast("double").alias("lower"), F.col("upper").cast("double").alias("upper"))
    for c in dimension:
        axes = axes.unionByName(fields.select("field", F.lit(c).alias("axis"), F.lit(0).alias("i"), F.col(f"`{c}`").cast("double").alias("coord"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper")))
        cells = cells.withColumn(f"i_{c}", F.lit(0))
    state = written(_signatures(fields, axes, same, relaxed_units, conditions or {}, axis_units or {}, ancillaries), "signatures")
    names = [r[0] for r in axes.select("axis").distinct().orderBy("axis").collect()]  # few, whatever the number of fields
    names = [*(n for n in order or () if n in names), *(n for n in names if n not in (order or ()))]
    members = written(fields.select("field", F.col("field").alias("into"), *[F.lit(0).cast("long").alias(f"offset_{n}") for n in names], *[F.lit(None).cast("string").alias("along")]), "members")
    for axis in names:
        step = written(_line_up(state, axis, contiguous, overlap), "step")
        state = written(_joined_state(step, axis), "signatures")
        moved = members.join(step.select(F.col("field").alias("into"), F.col("out").alias("__out"), F.col("start").alias("__start"), "many"), "into")
        members = written(moved.select("field", F.col("__out").alias("into"), *[(F.col(f"offset_{n}") + (F.col("__start") if n == axis else 0)).alias(f"offset_{n}") for n in names], F.when(F.col("many") > 1, F.lit(axis)).otherwise(F.col("along")).alias("along")), "members")
    return _moved(fields, axes, cells, members, names, value, ancillaries)


def _signatures(fields, axes, same, relaxed_units, conditions, axis_units, ancillaries) -> DataFrame:
    """(field, key, sig: map of axis -> struct hash, n, first, last, lo, hi, kind)."""
    digests = axes.withColumns({"digest": F.xxhash64("i", F.xxhash64("coord", "lower", "upper")), "low": F.least("lower", "upper"), "high": F.greatest("lower", "upper")})
    kinds, made = F.lit(None).cast("string"), {}
    if conditions:
        # A cell's distance from the one before it, for the spacing of instantaneous cells.
        before = F.lag("coord").over(Window.partitionBy("field", "axis").orderBy("i"))
        digests = digests.withColumn("before", before)
        for axis, some in conditions.items():
            units = axis_units.get(axis, Units.of("s"))
            for k, c in enumerate(some):
                fits = _lasts(F.coalesce("low", "coord"), F.coalesce("high", "coord"), c.size, units)
                if c.spacing is not None:
                    fits = fits & (F.col("before").isNull() | _lasts(F.col("before"), F.col("coord"), c.spacing, units))
                made[axis, k] = F.bool_and(F.when(F.col("axis") == axis, fits)).alias(f"fits_{len(made)}")
    grouped = digests.groupBy("field", "axis").agg(
        F.sum(F.col("digest").cast("decimal(38,0)")).cast("string").alias("hash"), F.count("*").alias("n"), F.min("coord").alias("first"), F.max("coord").alias("last"), F.min("low").alias("lo"), F.max("high").alias("hi"), *made.values()
    )
    for (axis, k), _ in reversed(list(zip(made, range(len(made))))):
        label = conditions[axis][k].label
        kinds = F.when((F.col("axis") == axis) & F.col(f"fits_{list(made).index((axis, k))}"), F.lit(label)).otherwise(kinds)
    sig = F.struct(F.concat_ws(":", F.col("n").cast("string"), "hash").alias("hash"), "n", "first", "last", "lo", "hi", kinds.alias("kind"))
    maps = grouped.select("field", F.struct("axis", sig.alias("s")).alias("e")).groupBy("field").agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("sig"))
    # Units of one dimension are one; they are few, whatever the number of fields.
    texts = [r[0] for r in fields.select("units").distinct().collect()]
    dims = {t: str((u.dims, u.epoch, u.calendar)) for t in texts if t is not None for u in [Units.of(t)]}
    kind = F.lit("undefined") if relaxed_units else F.concat(F.lit("undefined "), F.col("field"))
    for t, d in dims.items():
        kind = F.when(F.col("units") == t, F.lit(d)).otherwise(kind)
    key = F.to_json(F.struct(F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name"), kind.alias("units"), *[F.col(f"`{c}`").cast("string").alias(f"same_{k}") for k, c in enumerate(same)]))
    return fields.select("field", key.alias("key")).join(maps, "field", "left").select("field", "key", F.coalesce("sig", F.map_from_entries(F.expr("array()").cast("array<struct<axis:string,s:struct<hash:string,n:bigint,first:double,last:double,lo:double,hi:double,kind:string>>>"))).alias("sig"))


def _line_up(state: DataFrame, axis: str, contiguous: bool, overlap: bool) -> DataFrame:
    """state with the line of each field along an axis: out (the field that it becomes), start (its first position in it), many."""
    own = F.col("sig")[axis]
    others = F.transform_values(F.map_filter("sig", lambda k, v: k != axis), lambda k, v: F.concat_ws("/", v["hash"], v["kind"]))
    line = F.xxhash64("key", F.to_json(others), own["kind"], own.isNotNull())
    rows = state.withColumns({"line": F.when(own.isNotNull(), line), "own": own})
    alone = rows.where("own IS NULL").select("field", "key", "sig", F.col("field").alias("out"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("many"))
    rows = rows.where("own IS NOT NULL")
    w = Window.partitionBy("line", "key").orderBy("own.first", "own.last", "field")
    last, hi = F.lag("own.last").over(w), F.lag("own.hi").over(w)
    wrong = (last >= F.col("own.first")) | ((hi > F.col("own.lo")) & F.lit(not overlap)) | ((hi < F.col("own.lo")) & F.lit(contiguous))
    rows = rows.withColumns({"wrong": F.coalesce(wrong, F.lit(False)), "before": F.coalesce(F.sum("own.n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    whole = Window.partitionBy("line", "key")
    rows = rows.withColumns({"bad": F.max("wrong").over(whole), "least": F.min("field").over(whole), "size": F.count("*").over(whole)})
    joined = rows.select("field", "key", "sig", F.when(F.col("bad"), F.col("field")).otherwise(F.col("least")).alias("out"), F.when(F.col("bad"), F.lit(0)).otherwise(F.col("before")).cast("long").alias("start"), F.when(F.col("bad"), F.lit(1)).otherwise(F.col("size")).cast("long").alias("many"))
    return joined.unionByName(alone)


def _joined_state(step: DataFrame, axis: str) -> DataFrame:
    """One row for each field that is left; the signature of the joined axis comes from its parts in order."""
    s = F.col("sig")[axis]
    parts = F.sort_array(F.collect_list(F.struct("start", s["hash"].alias("hash"))))
    groups = step.groupBy("out", "key").agg(
        F.max("many").alias("many"), F.first("sig").alias("sig"), F.sha2(F.concat_ws(",", F.transform(parts, lambda p: p["hash"])), 256).alias("hash"), F.sum(s["n"]).alias("n"), F.min(s["first"]).alias("first"),
        F.max(s["last"]).alias("last"), F.min(s["lo"]).alias("lo"), F.max(s["hi"]).alias("hi"), F.max(s["kind"]).alias("kind"),
    )
    new = F.struct("hash", "n", "first", "last", "lo", "hi", "kind")
    return groups.select(F.col("out").alias("field"), "key", F.when(F.col("many") > 1, F.transform_values("sig", lambda k, v: F.when(k == axis, new).otherwise(v))).otherwise(F.col("sig")).alias("sig"))


def _moved(fields, axes, cells, members, names, value, ancillaries) -> Aggregated:
    offsets = [f"offset_{n}" for n in names]
    # The first part of a joined field gives its columns and the units of its values.
    first = members.groupBy("into").agg(F.min(F.struct(*offsets, "field")).alias("f"), F.count("*").alias("parts")).select(F.col("into").alias("__into"), F.col("f.field").alias("__first"), "parts")
    out = fields.join(first, F.col("field") == F.col("__first")).withColumn("field", F.col("__into")).drop("__into", "__first")
    units = members.join(fields.select("field", F.col("units").alias("__from")), "field").join(out.select(F.col("field").alias("into"), F.col("units").alias("__to")), "into")
    pairs = [(r[0], r[1]) for r in units.where("__from <> __to").select("__from", "__to").distinct().collect()]
    x = F.col(value)
    for a, b in pairs:
        x = F.when((F.col("__from") == a) & (F.col("__to") == b), Units.of(a).convert(F.col(value), Units.of(b))).otherwise(x)
    index = [c for c in cells.columns if c.startswith("i_") and c[2:] in names]
    moved = cells.join(units, "field").select(F.col("into").alias("field"), *[(F.col(c) + F.col(f"offset_{c[2:]}")).cast("int").alias(c) for c in index], x.alias(value))
    shift = F.element_at(F.create_map(*[c for n in names for c in (F.lit(n), F.col(f"offset_{n}"))]), F.col("axis"))
    table = axes.join(members, "field").select(F.col("into").alias("field"), "axis", (F.col("i") + shift).cast("int").alias("i"), "coord", "lower", "upper")
    # Parts of a line repeat the axes that they have in common.
    table = table.dropDuplicates(["field", "axis", "i"])
    kept = None
    if ancillaries:
        spans = axes.groupBy("field", "axis").agg(F.max("i").alias("__n")).join(members, "field").where(F.col("axis") == F.col("along"))
        rows = spans.join(fields.select("field", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("text")) for c in ancillaries])).alias("a")), "field")
        kept = rows.select(F.col("into").alias("field"), "axis", F.explode(F.sequence(shift.cast("int"), (shift + F.col("__n")).cast("int"))).alias("i"), "a.name", "a.text").distinct()
    return Aggregated(out, table, moved, members.select("field", "into", *offsets), kept)
