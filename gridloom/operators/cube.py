"""Cubes: a fact table of cells with coordinate tables, units, cell methods and cyclic axes.

A cube's data has an integer column i_<axis> for each axis and a value column, missing values null. Each axis has a
table (i, coord[, lower, upper, …]) and units; measures are tables of weights over some axes. Operators return new
cubes and only build plans; nothing runs until the data are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions import elementwise
from gridloom.functions.calendars import TimeDuration, days_from_date, decode
from gridloom.functions.cellmethods import CellMethod
from gridloom.functions.query import Query
from gridloom.functions.units import NONE, Units
from gridloom.operators import binning, collapse as collapses, combine, grouping, regrid, reshape, sphere, subspace as subspaces, vertical, weights, windows

EARTH = weights.EARTH


@dataclass(frozen=True, eq=False)
class Axis:
    name: str
    size: int
    table: DataFrame | None = None  # i, coord[, lower, upper, …]
    units: Units = NONE
    period: float | None = None
    standard_name: str | None = None
    kind: str | None = None  # X, Y, Z or T

    @property
    def index(self) -> str:
        return f"i_{self.name}"

    @property
    def has_bounds(self) -> bool:
        return self.table is not None and {"lower", "upper"} <= set(self.table.columns)

    def keyed(self) -> DataFrame:
        return self.table.withColumnRenamed("i", self.index)


def catalog_plain(condition: Query, number: float) -> bool:
    """A condition on one number."""
    from gridloom.operators.catalog import _plain

    return _plain(condition, number)


class WeightTables(dict):
    """Weight tables by index, and the units of their product."""

    units: Units = NONE


@dataclass(frozen=True)
class Cube:
    df: DataFrame
    axes: Mapping[str, Axis]
    value: str = "value"
    units: Units = NONE
    name: str | None = None
    properties: Mapping[str, object] = field(default_factory=dict)
    cell_methods: tuple[CellMethod, ...] = ()
    measures: Mapping[str, DataFrame] = field(default_factory=dict)
    ncvar: str | None = None
    measure_units: Mapping[str, str] = field(default_factory=dict)
    hardmask: bool = True

    # --- making -----------------------------------------------------------------------------------------------------

    @staticmethod
    def from_table(df: DataFrame, axes: Mapping[str, str], value: str, units: str | None = None, name: str | None = None, axis_units: Mapping[str, str] | None = None) -> Cube:
        """From a flat table with a coordinate column per axis: {axis: column}. Coordinates get positions in their order; a cell may
        have several rows, which collapses take one by one."""
        from pyspark.sql import Window

        out, made = df, {}
        for a, column in axes.items():
            # One row per distinct coordinate: the size of an axis.
            table = df.select(F.col(column).alias("coord")).distinct().withColumn("i", (F.row_number().over(Window.orderBy("coord")) - 1).cast("int"))
            made[a] = Axis(a, table.count(), table.select("i", "coord"), Units.of((axis_units or {}).get(a)))
            out = out.join(table.select(F.col("i").alias(f"i_{a}"), F.col("coord").alias(f"__{a}")), F.col(column).eqNullSafe(F.col(f"__{a}"))).drop(f"__{a}")
        keys = [made[a].index for a in made]
        return Cube(out.select(*keys, F.col(value).alias("value")), made, "value", Units.of(units), name)

    @staticmethod
    def full(spark: SparkSession, axes: Sequence[Axis], value: float | None, units: str | None = None) -> Cube:
        return Cube(reshape.full(spark, {a.index: a.size for a in axes}, value, "value", "double"), {a.name: a for a in axes}, "value", Units.of(units))

    @staticmethod
    def regular_lonlat(spark: SparkSession, lon: tuple[float, float, float], lat: tuple[float, float, float]) -> dict[str, Axis]:
        """Longitude and latitude axes of equal cells: (from, to, cell size) each."""
        x, y = weights.regular_axis(spark, *lon), weights.regular_axis(spark, *lat)
        round_ = abs(lon[1] - lon[0] - 360) < 1e-9
        size = lambda t: round((t[1] - t[0]) / t[2])
        return {"lat": Axis("lat", size(lat), y, Units.of("degrees_north"), None, "latitude", "Y"), "lon": Axis("lon", size(lon), x, Units.of("degrees_east"), 360.0 if round_ else None, "longitude", "X")}

    # --- what it is -------------------------------------------------------------------------------------------------

    @property
    def shape(self) -> dict[str, int]:
        return {a.index: a.size for a in self.axes.values()}

    @property
    def keys(self) -> list[str]:
        return [a.index for a in self.axes.values()]

    @property
    def x(self) -> Column:
        return F.col(self.value)

    def axis(self, identity: str) -> Axis:
        """An axis by its name, standard name or kind; unique or an error."""
        found = [a for a in self.axes.values() if identity in (a.name, a.standard_name, a.kind)]
        if len(found) != 1:
            raise ValueError(f"{len(found)} axes are called {identity!r}")
        return found[0]

    def _with(self, df: DataFrame, **changes) -> Cube:
        return replace(self, df=df, **changes)

    def _others(self, *axes: Axis) -> list[str]:
        return [a.index for a in self.axes.values() if a not in axes]

    def iscyclic(self, identity: str) -> bool:
        return self.axis(identity).period is not None

    def cyclic(self, identity: str, period: float | None) -> Cube:
        a = self.axis(identity)
        return replace(self, axes={**self.axes, a.name: replace(a, period=period)})

    def autocyclic(self, identity: str = "longitude") -> Cube:
        """Make a longitude axis cyclic if its cells' bounds go once round."""
        a = self.axis(identity)
        if not a.has_bounds or a.period is not None or "degree" not in a.units.text:
            return self
        low, high = a.table.agg(F.min(F.least("lower", "upper")), F.max(F.greatest("lower", "upper"))).first()
        return self.cyclic(identity, 360.0) if abs(high - low - 360.0) < 1e-9 else self

    def directions(self) -> dict[str, bool]:
        return {n: self.direction(n) for n, a in self.axes.items() if a.table is not None}

    def lower_bounds(self, identity: str) -> DataFrame:
        a = self.axis(identity)
        return a.table.select("i", F.least("lower", "upper").alias("bound"))

    def upper_bounds(self, identity: str) -> DataFrame:
        a = self.axis(identity)
        return a.table.select("i", F.greatest("lower", "upper").alias("bound"))

    def filter_axes(self, *identities: str, units: str | None = None, size: int | Query | None = None, cyclic: bool | None = None, todict: bool = False):
        """Axes by name, standard name or kind (any of them), by equivalent units, size and whether they are cyclic (all that are given)."""
        def fits(a: Axis) -> bool:
            return (
                (not identities or any(i in (a.name, a.standard_name, a.kind) for i in identities)) and (units is None or (a.units.defined and a.units.equivalent(Units.of(units))))
                and (size is None or (catalog_plain(size, a.size) if isinstance(size, Query) else a.size == size)) and (cyclic is None or (a.period is not None) == cyclic)
            )

        found = {n: a for n, a in self.axes.items() if fits(a)}
        return found if todict else list(found.values())

    # --- execution --------------------------------------------------------------------------------------------------

    def persist(self) -> Cube:
        """Keep the cells in the executors' memory and on their disks once they are computed; lost ones are computed again."""
        return self._with(self.df.persist())

    def rechunk(self, partitions: int | None = None, along: Sequence[str] = ()) -> Cube:
        """Deal the cells out anew: by range of positions along axes, or evenly."""
        n = partitions or int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keys = [self.axis(a).index for a in along]
        return self._with(self.df.repartitionByRange(n, *keys) if keys else self.df.repartition(n))

    def digest(self) -> tuple[int, int]:
        """Number of cells, and a hash that doesn't depend on their order or partitions."""
        r = self.df.agg(F.count("*"), F.sum(F.xxhash64(*self.keys, self.value).cast("decimal(38,0)"))).first()
        return r[0], int(r[1] or 0)

    def direction(self, identity: str) -> bool:
        """Whether an axis' coordinates increase."""
        ends = self.axis(identity).table.agg(F.min_by("coord", "i"), F.max_by("coord", "i")).first()
        return ends[0] <= ends[1]

    def identities(self) -> list[str]:
        long = self.properties.get("long_name")
        return [i for i in (self.name, f"id%{self.properties['id']}" if "id" in self.properties else None, f"long_name={long}" if long else None, f"ncvar%{self.ncvar}" if self.ncvar else None) if i]

    # --- units and functions ----------------------------------------------------------------------------------------

    def to_units(self, units: str) -> Cube:
        new = Units.of(units)
        return self._with(self.df.withColumn(self.value, self.units.convert(self.x, new)), units=new)

    def override_units(self, units: str | None) -> Cube:
        return replace(self, units=Units.of(units))

    def apply(self, function: str) -> Cube:
        """An element-wise function by name (see elementwise.UNARY)."""
        out, units = elementwise.UNARY[function](self.x, self.units)
        return self._with(self.df.withColumn(self.value, out), units=units, name=self.name if units == self.units else None)

    def func(self, f: Callable, units: str | None = None) -> Cube:
        return self._with(self.df.withColumn(self.value, elementwise.func(f)(self.x)), units=Units.of(units) if units else self.units)

    def _binary(self, op: str, other, reflected: bool = False) -> Cube:
        if isinstance(other, Cube):
            left, axes = self.df, {**self.axes, **other.axes}
            right = other.df.withColumnRenamed(other.value, self.value)
            for a, b in self._shared(other):
                if a.size != b.size:  # the side with one cell goes with every cell of the other
                    axes[a.name] = a if b.size == 1 else b
                    left, right = (left, right.drop(b.index)) if b.size == 1 else (left.drop(a.index), right)
            df, units = combine.binary_operation(left, right, list(dict.fromkeys([*self.keys, *other.keys])), op, self.value, self.units, other.units)
            return replace(self, df=df, units=units, axes=axes, name=self.name if units == self.units else None)
        a, b, ua, ub = (F.lit(other), self.x, NONE, self.units) if reflected else (self.x, F.lit(other), self.units, NONE)
        if op in ("mul", "truediv", "floordiv"):
            ua, ub = (Units.of("1"), self.units) if reflected and self.units.defined else (ua, ub)
        out, units = elementwise.binary(op, a, ua, b, ub)
        return self._with(self.df.withColumn(self.value, out), units=units)

    def _shared(self, other: Cube) -> list[tuple[Axis, Axis]]:
        """Axes of both cubes; fails where they have different sizes (but 1) or different coordinates at the same positions."""
        found = [(a, other.axes[n]) for n, a in self.axes.items() if n in other.axes]
        for a, b in found:
            if a.size != b.size and 1 not in (a.size, b.size):
                raise ValueError(f"the axis {a.name!r} has {a.size} cells in one cube and {b.size} in the other")
            if a.size == b.size and a.table is not None and b.table is not None and a.table is not b.table:
                table = b.table.withColumn("coord", b.units.convert(F.col("coord"), a.units)) if a.units.defined and b.units.defined else b.table
                if not combine.misaligned(a.table, table, "i", rtol=config.get("rtol"), atol=config.get("atol")).isEmpty():
                    raise ValueError(f"the axis {a.name!r} has other coordinates in one cube than in the other")
        return found

    def __pow__(self, exponent: float) -> Cube:
        out, units = elementwise.power(self.x, exponent, self.units)
        return self._with(self.df.withColumn(self.value, out), units=units)

    def __neg__(self) -> Cube:
        return self.apply("neg")

    def __abs__(self) -> Cube:
        return self.apply("abs")

    # --- masks ------------------------------------------------------------------------------------------------------

    def where(self, condition: Query | Column, a, b=None, hardmask: bool | None = None) -> Cube:
        """a where a condition holds, b (default: the value) elsewhere. With a hard mask (default: the cube's) missing values stay missing."""
        if isinstance(condition, Query):
            condition = condition(self.x, self.units)
        return self._with(self.df.withColumn(self.value, elementwise.where(self.x, condition, a, b, self.hardmask if hardmask is None else hardmask)))

    def harden_mask(self) -> Cube:
        return replace(self, hardmask=True)

    def soften_mask(self) -> Cube:
        return replace(self, hardmask=False)

    def get_fill_value(self):
        """The value that stands for missing ones in files: the property _FillValue or missing_value, else the value type's usual one."""
        usual = {"double": 9.969209968386869e36, "float": 9.969209968386869e36, "int": -2147483647, "bigint": -9223372036854775806, "smallint": -32767, "tinyint": -127, "string": ""}
        return self.properties.get("_FillValue", self.properties.get("missing_value", usual.get(dict(self.df.dtypes)[self.value])))

    def masked_where(self, condition: Query | Column) -> Cube:
        if isinstance(condition, Query):
            condition = condition(self.x, self.units)
        return self._with(self.df.withColumn(self.value, elementwise.masked_where(self.x, condition)))

    def clip(self, low=None, high=None) -> Cube:
        return self._with(self.df.withColumn(self.value, elementwise.clip(self.x, low, high)))

    def filled(self, value) -> Cube:
        return self._with(self.df.withColumn(self.value, elementwise.filled(self.x, value)))

    def mask(self) -> Cube:
        return self._with(self.df.withColumn(self.value, self.x.isNull()), units=NONE)

    def is_masked(self) -> bool:
        return not self.df.where(self.x.isNull()).isEmpty()

    def contains(self, value) -> bool:
        return not self.df.where(self.x == value).isEmpty()

    # --- subspaces --------------------------------------------------------------------------------------------------

    def subspace(self, mode: str = "compress", halo: int = 0, **conditions: Query | Column | slice | Sequence[int]) -> Cube:
        """By conditions on axes (stored ones, columns, or functions of the coordinate's column); slices and lists are positions. Only
        compress renumbers the axes."""
        out, selected, axes = self.df, {}, dict(self.axes)
        for identity, c in conditions.items():
            a = self.axis(identity)
            if isinstance(c, (slice, list, tuple, range)):
                out = reshape.take(out, a.index, c if isinstance(c, slice) else list(c), a.size)
                table = reshape.take(a.table, "i", c if isinstance(c, slice) else list(c), a.size) if a.table is not None else None
                axes[a.name] = replace(a, size=len(range(*c.indices(a.size))) if isinstance(c, slice) else len(c), table=table, period=None)
                continue
            if callable(c) and not isinstance(c, (Query, Column)):
                c = c(F.col("coord"))
            if isinstance(c, Query) and a.units.is_reference_time:
                c = c.column(self._axis_columns(a), a.units)
            rows = subspaces.select_positions(a.table, "i", c, a.units, period=a.period)
            selected[a.index] = rows.withColumnRenamed("i", a.index)
        out = subspaces.subspace(out, selected, self.value, mode, halo, self.shape)
        if mode == "compress":
            from pyspark.sql import Window

            for index, rows in selected.items():
                a = next(x for x in self.axes.values() if x.index == index)
                keep = rows.select(index).distinct()
                if halo:
                    keep = keep.select(F.explode(F.sequence(F.col(index) - halo, F.col(index) + halo).cast("array<int>")).alias(index)).distinct().where(F.col(index).between(0, a.size - 1))
                numbered = keep.withColumn("__new", (F.row_number().over(Window.orderBy(index)) - 1).cast("int"))  # an axis' rows
                out = out.join(numbered, index).drop(index).withColumnRenamed("__new", index)
                table = a.table.join(numbered.withColumnRenamed(index, "i"), "i").drop("i").withColumnRenamed("__new", "i")
                axes[a.name] = replace(a, size=numbered.count(), table=table, period=None)
            out = out.select(*self.keys, self.value)
        return self._with(out, axes=axes)

    # --- weights and collapses --------------------------------------------------------------------------------------

    def weights(self, *identities: str, measure: bool = False, radius: float = weights.EARTH) -> dict[str, DataFrame]:
        """Weight tables (index, w) of axes: by the sine of latitude, longitude in radians, or the cells' sizes. Kept per axis, with
        the units of their product."""
        out = WeightTables()
        for identity in identities:
            a = self.axis(identity)
            if a.size == 1 and not measure:
                continue
            if not a.has_bounds:
                raise ValueError(f"the axis {a.name!r} has no bounds to weigh its cells by")
            lo, up = F.col("lower"), F.col("upper")
            w = weights.latitude(lo, up, measure, radius) if a.standard_name == "latitude" else weights.longitude(lo, up, measure, radius) if a.standard_name == "longitude" else weights.linear(lo, up)
            out[a.index] = a.table.select(F.col("i").alias(a.index), w.alias("w"))
            own = (Units.of("m") if measure else Units.of("1")) if a.standard_name in ("latitude", "longitude") else Units.of(a.units.text.split(" since ")[0]) if a.units.defined else NONE
            out.units = own if not out.units.defined else out.units * own
        return out

    def collapse(self, method: str, axes: Sequence[str] | None = None, weights: Mapping[str, DataFrame] | str | None = None, mtol: float = 1.0, ddof: int = 1) -> Cube:
        """A statistic over axes (default: all). weights: tables from weights(), or the name of a measure."""
        method = collapses.canonical(method)
        gone = [self.axis(a) for a in axes] if axes is not None else list(self.axes.values())
        rows, w, weight_units = self.df, None, getattr(weights, "units", NONE)
        if isinstance(weights, str):
            m, weight_units = self.measures[weights], Units.of(self.measure_units.get(weights))
            rows, w = rows.join(m, [k for k in self.keys if k in m.columns]), F.col("measure")
        elif weights:
            for k, (index, table) in enumerate(weights.items()):
                rows = rows.join(table.withColumnRenamed("w", f"__w{k}"), index)
                w = F.col(f"__w{k}") if w is None else w * F.col(f"__w{k}")
        if method == "integral" and w is None:
            raise ValueError("an integral needs weights")
        kept = self._others(*gone)
        out = collapses.collapse(rows, kept, self.x, {self.value: method}, w, ddof, mtol)
        done = CellMethod(tuple(a.name for a in gone), method)
        return replace(self, df=out, axes={n: a for n, a in self.axes.items() if a not in gone}, units=collapses.result_units(method, self.units, weight_units), cell_methods=(*self.cell_methods, done))

    def percentile(self, ranks: Sequence[float], axes: Sequence[str] | None = None, method: str = "linear", mtol: float = 1.0) -> DataFrame:
        gone = [self.axis(a) for a in axes] if axes is not None else list(self.axes.values())
        return collapses.percentile(self.df, self._others(*gone), self.value, ranks, method, mtol)

    def _groups(self, a: Axis, group: Column | int | TimeDuration | Query | Sequence[Query]) -> DataFrame:
        """An axis' positions with the group each belongs to; those of no group are left out."""
        if isinstance(group, (Query, list, tuple)):
            columns = self._axis_columns(a)
            conditions = [q.column(columns, a.units) for q in ([group] if isinstance(group, Query) else group)]
            return grouping.runs(a.table, "i", conditions).select(F.col("i").alias(a.index), F.col("group").alias("__g"))
        if isinstance(group, int):
            group = grouping.by_number(F.col("i"), group)
        elif isinstance(group, TimeDuration):
            group = grouping.by_calendar(F.col("coord"), a.units, group) if a.units.is_reference_time else grouping.by_period(F.col("coord"), group)
        return a.table.select(F.col("i").alias(a.index), group.alias("__g")).where("__g IS NOT NULL")

    @staticmethod
    def _axis_columns(a: Axis) -> dict[str, Column]:
        columns = subspaces.axis_columns(a.table)
        return columns | decode(F.col("coord"), a.units) if a.units.is_reference_time else columns

    def grouped(self, method: str, identity: str, group: Column | int | TimeDuration | Query | Sequence[Query], weights: str | None = None, mtol: float = 1.0, ddof: int = 1, group_span: float | None = None, group_contiguous: int = 0, group_size: int | None = None) -> Cube:
        """A statistic of each group along an axis: runs of n cells, periods, runs of cells that satisfy a condition or one of
        several, or an expression on the axis' table. group_span, group_contiguous and group_size drop groups that aren't whole."""
        from pyspark.sql import Window

        a = self.axis(identity)
        labels = self._groups(a, group)
        if group_span is not None or group_contiguous or group_size is not None:
            rows = a.table.withColumnRenamed("i", a.index).join(labels, a.index)
            bounds = ("lower", "upper") if a.has_bounds else (None, None)
            labels = labels.join(grouping.complete_groups(rows, a.index, "__g", *bounds, group_span, group_contiguous, group_size), "__g", "left_semi")
        order = labels.groupBy("__g").agg(F.min(a.index).alias("__first")).withColumn("__new", (F.row_number().over(Window.orderBy("__first")) - 1).cast("int"))
        rows = self.df.join(labels.join(order, "__g").select(a.index, "__new"), a.index)
        others = self._others(a)
        out = collapses.collapse(rows, [*others, "__new"], self.x, {self.value: method}, F.col(weights) if weights else None, ddof, mtol).withColumnRenamed("__new", a.index)
        low, high = (F.min(F.least("lower", "upper")), F.max(F.greatest("lower", "upper"))) if a.has_bounds else (F.min("coord"), F.max("coord"))
        table = a.table.withColumnRenamed("i", a.index).join(labels.join(order, "__g").select(a.index, "__new"), a.index).groupBy(F.col("__new").alias("i")).agg(F.min("coord").alias("coord"), low.alias("lower"), high.alias("upper"))
        done = CellMethod((a.name,), collapses.canonical(method))
        return replace(self, df=out, axes={**self.axes, a.name: replace(a, size=order.count(), table=table, period=None)}, units=collapses.result_units(method, self.units), cell_methods=(*self.cell_methods, done))

    def climatology(self, within_method: str, over_method: str, identity: str, portion: Sequence[Query] | None = None, unit: str = "year", mtol: float = 1.0, ddof: int = 1) -> DataFrame:
        """A statistic within each year (or day) for each portion of it (conditions; default: every month, or hour), then one across
        the years (days) of each portion: rows of the other axes, `within` (the portion's number) and the value."""
        a = self.axis(identity)
        c = self._axis_columns(a)
        if unit == "day":
            within = c["hour"] if portion is None else grouping.season_of(portion, c)
            whole = F.floor(days_from_date(c["year"], c["month"], c["day"], a.units.calendar or "proleptic_gregorian"))
        else:
            within = c["month"] if portion is None else grouping.season_of(portion, c)
            whole = c["year"]
        labels = a.table.select(F.col("i").alias(a.index), within.alias("__within"), whole.alias("__whole"))
        rows = self.df.join(labels, a.index)
        return grouping.climatology(rows, F.lit(None), self._others(a), self.value, F.col("__within"), within_method, None, over_method, F.col("__whole"), mtol, ddof)

    def digitize(self, edges: Sequence[float], **options) -> Cube:
        return self._with(self.df.withColumn(self.value, binning.digitize(self.x, edges, **options)), units=NONE, name=None)

    @staticmethod
    def _joined(variables: Mapping[str, tuple[Cube, Sequence[float]]]) -> tuple[DataFrame, dict[str, Sequence[float]], list[str]]:
        """One row per cell with a column per variable; variables share their axes or some of them."""
        rows, keys = None, []
        for name, (cube, _) in variables.items():
            part = cube.df.select(*cube.keys, cube.x.alias(name))
            rows = part if rows is None else rows.join(part, [k for k in cube.keys if k in keys])
            keys += [k for k in cube.keys if k not in keys]
        return rows, {n: e for n, (_, e) in variables.items()}, keys

    @staticmethod
    def histogram(variables: Mapping[str, tuple[Cube, Sequence[float]]], density: bool = False, **options) -> DataFrame:
        """Counts or density over the product of bins: {name: (cube, bin edges)}."""
        rows, edges, _ = Cube._joined(variables)
        return binning.histogram(rows, edges, density=density, **options)

    def bin(self, method: str, variables: Mapping[str, tuple[Cube, Sequence[float]]], **options) -> DataFrame:
        """A statistic of this cube in every bin of the product of other variables' bins."""
        rows, edges, keys = Cube._joined(variables)
        both = self.df.select(*self.keys, self.x.alias("__value")).join(rows, [k for k in self.keys if k in keys])
        return binning.bin_collapse(both, edges, "__value", method, **options).withColumnRenamed("__value", self.value)

    def cell_area(self, radius: float = EARTH) -> Cube:
        """Areas of the cells of the latitude and longitude axes, on the sphere."""
        tables = self.weights("latitude", "longitude", measure=True, radius=radius)
        out, axes = None, [self.axis("latitude"), self.axis("longitude")]
        for a in axes:
            t = tables[a.index].withColumnRenamed("w", f"__{a.name}")
            out = t if out is None else out.crossJoin(t)  # the product of two axes
        area = F.col(f"__{axes[0].name}") * F.col(f"__{axes[1].name}")
        return Cube(out.select(*[a.index for a in axes], area.alias("value")), {a.name: a for a in axes}, units=Units.of("m2"), name="cell_area")

    def extreme_positions(self, axes: Sequence[str] | None = None, largest: bool = True) -> DataFrame:
        """Positions of the largest (smallest) value over axes, the first of equal ones."""
        gone = [self.axis(a) for a in axes] if axes is not None else list(self.axes.values())
        return collapses.arg_extreme(self.df, self._others(*gone), self.value, [a.index for a in gone], largest)

    def unique(self, counts: bool = False) -> DataFrame:
        return collapses.unique(self.df, self.value, counts)

    def coarsen(self, method: str | Callable[[Column], Column], trim_excess: bool = False, **factors: int) -> Cube:
        """Collapse blocks of cells: a number of cells per axis."""
        found = {self.axis(n): k for n, k in factors.items()}
        rows = collapses.coarsen(self.df, {a.index: k for a, k in found.items()}, self._others(*found), self.value, method, self.shape, trim_excess)
        axes = {n: replace(a, size=a.size // found[a], table=None, period=None) if a in found else a for n, a in self.axes.items()}
        return self._with(rows.select(*self.keys, self.value), axes=axes)

    def with_vertical(self, parametric: str, terms: Mapping[str, Cube | float]) -> Cube:
        """The vertical coordinate that a parametric one stands for, on this cube's axes: terms are cubes on some of them, or numbers."""
        rows, columns = self.df.select(*self.keys), {}
        for n, t in terms.items():
            if isinstance(t, Cube):
                rows = rows.join(t.df.select(*t.keys, t.x.alias(f"__{n}")), t.keys) if t.keys else rows.crossJoin(F.broadcast(t.df.select(t.x.alias(f"__{n}"))))
                columns[n] = F.col(f"__{n}")
            else:
                columns[n] = F.lit(float(t))
        name, out = vertical.compute(parametric, columns)
        return replace(self, df=rows.select(*self.keys, out.alias("value")), value="value", units=NONE, name=name, cell_methods=())

    # --- along an axis ----------------------------------------------------------------------------------------------

    def cumsum(self, identity: str, masked_as_zero: bool = False) -> Cube:
        a = self.axis(identity)
        return self._with(windows.cumsum(self.df, self._others(a), a.index, self.value, masked_as_zero), cell_methods=(*self.cell_methods, CellMethod((a.name,), "sum")))

    def diff(self, identity: str, n: int = 1) -> Cube:
        a = self.axis(identity)
        table = a.table.where(F.col("i") < a.size - n) if a.table is not None else None
        units = Units.of(self.units.text.split(" since ")[0]) if self.units.is_reference_time and n else self.units
        return self._with(windows.diff(self.df, self._others(a), a.index, self.value, n), units=units, axes={**self.axes, a.name: replace(a, size=a.size - n, table=table)})

    def moving_window(self, method: str, size: int, identity: str, mode: str | None = None, **options) -> Cube:
        a = self.axis(identity)
        mode = mode or ("wrap" if a.period is not None else "constant")
        return self._with(windows.moving_window(self.df, self._others(a), a.index, self.value, method, size, mode=mode, **options))

    def convolution_filter(self, window: Sequence[float], identity: str, mode: str | None = None, **options) -> Cube:
        a = self.axis(identity)
        mode = mode or ("wrap" if a.period is not None else "constant")
        return self._with(windows.convolution_filter(self.df, self._others(a), a.index, self.value, window, mode, **options))

    def derivative(self, identity: str, wrap: bool | None = None, one_sided_at_boundary: bool = False) -> Cube:
        a = self.axis(identity)
        rows = self.df.join(a.table.select(F.col("i").alias(a.index), F.col("coord").cast("double").alias("__c")), a.index)
        out = windows.derivative(rows, self._others(a), a.index, self.value, "__c", a.period is not None if wrap is None else wrap, a.period, one_sided_at_boundary).drop("__c")
        return self._with(out.select(*self.keys, self.value), units=self.units / a.units if self.units.defined and a.units.defined and not a.units.is_reference_time else self.units)

    def roll(self, identity: str, shift: int) -> Cube:
        a = self.axis(identity)
        if a.period is None and a.table is not None:
            raise ValueError(f"the axis {a.name!r} is not cyclic")
        coords = [c for c in ("coord", "lower", "upper") if a.table is not None and c in a.table.columns]
        table = windows.roll_coords(a.table, "i", shift, a.size, a.period, coords) if a.table is not None else None
        return self._with(windows.roll(self.df, a.index, shift, a.size), axes={**self.axes, a.name: replace(a, table=table)})

    def flip(self, identity: str) -> Cube:
        a = self.axis(identity)
        return self._with(windows.flip(self.df, a.index, a.size), axes={**self.axes, a.name: replace(a, table=windows.flip(a.table, "i", a.size) if a.table is not None else None)})

    def anchor(self, identity: str, value: float) -> Cube:
        """Roll a cyclic axis so that its first coordinate is the first at or after value."""
        a = self.axis(identity)
        coords = [c for c in ("lower", "upper") if c in a.table.columns]
        new = windows.anchor(a.table.withColumn("__old", F.col("i")), "i", a.size, value, a.period, "coord", coords)
        move = new.select(F.col("__old").alias(a.index), F.col("i").alias("__new"))
        return self._with(self.df.join(move, a.index).drop(a.index).withColumnRenamed("__new", a.index).select(*self.keys, self.value), axes={**self.axes, a.name: replace(a, table=new.drop("__old"))})

    def halo(self, identity: str, depth: int) -> Cube:
        a = self.axis(identity)
        out = windows.halo(self.df, self._others(a), a.index, depth, cyclic=a.period is not None, size=a.size).drop("__own").withColumn(a.index, (F.col(a.index) + depth).cast("int"))
        return self._with(out, axes={**self.axes, a.name: replace(a, size=a.size + 2 * depth, table=None, period=None)})

    # --- shapes -----------------------------------------------------------------------------------------------------

    def transpose(self, order: Sequence[str]) -> Cube:
        axes = [self.axis(a) for a in order]
        return self._with(self.df.select(*[a.index for a in axes], self.value), axes={a.name: a for a in axes})

    def squeeze(self) -> Cube:
        gone = [a for a in self.axes.values() if a.size == 1]
        return self._with(self.df.drop(*[a.index for a in gone]), axes={n: a for n, a in self.axes.items() if a not in gone})

    def insert_dimension(self, axis: Axis) -> Cube:
        if axis.size != 1:
            raise ValueError("a new axis has one cell")
        return self._with(reshape.insert_dimension(self.df, axis.index), axes={axis.name: axis, **self.axes})

    def pad_missing(self, identity: str, before: int = 0, after: int = 0, to_size: int | None = None) -> Cube:
        a = self.axis(identity)
        size = to_size if to_size is not None else a.size + before + after
        others = {b.index: b.size for b in self.axes.values() if b is not a}
        return self._with(reshape.pad_missing(self.df, a.index, a.size, others, self.value, before, after, to_size).select(*self.keys, self.value), axes={**self.axes, a.name: replace(a, size=size, table=None)})

    @staticmethod
    def concatenate(cubes: Sequence[Cube], identity: str) -> Cube:
        first, a = cubes[0], cubes[0].axis(identity)
        df, size = combine.concatenate([(c.df.withColumnRenamed(c.value, first.value), c.axis(identity).size) for c in cubes], a.index, [c.units for c in cubes], first.value)
        tables = [(c.axis(identity).table, c.axis(identity).size) for c in cubes]
        table = combine.concatenate(tables, "i", [c.axis(identity).units for c in cubes], "coord")[0] if all(t is not None for t, _ in tables) else None
        return replace(first, df=df, axes={**first.axes, a.name: replace(a, size=size, table=table)})

    # --- other grids ------------------------------------------------------------------------------------------------

    def regrids(self, axes: Mapping[str, Axis], method: str = "linear", **options) -> Cube:
        """To other latitudes and longitudes (a mapping of axis name to new axis), on the sphere."""
        return self._regrid(axes, method, True, **options)

    def regridc(self, axes: Mapping[str, Axis], method: str = "linear", **options) -> Cube:
        return self._regrid(axes, method, False, **options)

    def _regrid(self, axes: Mapping[str, Axis], method: str, spherical: bool, **options) -> Cube:
        old = {n: self.axis(n) for n in axes}
        pairs = {old[n].index: (old[n].table, new.table) for n, new in axes.items()}
        latitude = next((a.index for a in old.values() if a.standard_name == "latitude"), None)
        periods = {a.index: a.period for a in old.values() if a.period is not None}
        out = regrid.regrid(self.df, self._others(*old.values()), self.value, method, pairs, spherical=spherical, latitude=latitude, periods=periods, **options)
        new = {n: (replace(axes[n], name=n) if n in axes else a) for n, a in self.axes.items()}
        return self._with(out.select(*self.keys, self.value), axes=new)

    # --- out --------------------------------------------------------------------------------------------------------

    def regrid_cells(self, identities: Sequence[str], src: sphere.CellGrid, dst: sphere.CellGrid, method: str = "linear", **options) -> DataFrame:
        """Values whose place is given by 2-d coordinates (two axes, j before i) or by a mesh (one axis), on another such grid: rows (other axes,
        cell, value). src names its cells by their place along the axes, j x size of i + i."""
        axes = [self.axis(i) for i in identities]
        by, cell = self._others(*axes), F.lit(0).cast("long")
        for a in axes:
            cell = cell * a.size + F.col(a.index)
        rows = self.df.select(*by, cell.alias("cell"), self.value)
        return sphere.regrid(rows, by, self.value, src, dst, method, **options)

    def with_coords(self) -> DataFrame:
        """The data with a column for each axis' coordinate."""
        out = self.df
        for a in self.axes.values():
            if a.table is not None:
                out = out.join(a.table.select(F.col("i").alias(a.index), F.col("coord").alias(a.name)), a.index)
        return out

    def equals(self, other: Cube, rtol: float = 1e-12, atol: float = 1e-12) -> bool:
        return self.shape == other.shape and self.units == other.units and combine.allclose(self.df, other.df.withColumnRenamed(other.value, self.value), self.keys, self.value, rtol, atol)


def _operator(op: str):
    def forward(self: Cube, other):
        return self._binary(op, other)

    def reflected(self: Cube, other):
        return self._binary(op, other, True)

    return forward, reflected


for _op, _dunder in {"add": "add", "sub": "sub", "mul": "mul", "truediv": "truediv", "floordiv": "floordiv", "mod": "mod"}.items():
    _f, _r = _operator(_op)
    setattr(Cube, f"__{_dunder}__", _f)
    setattr(Cube, f"__r{_dunder}__", _r)
for _op in ("lt", "le", "gt", "ge"):
    setattr(Cube, f"__{_op}__", _operator(_op)[0])
