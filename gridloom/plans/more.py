"""More queries, one for each family that the registry's first part leaves out, with equivalent SQL."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions import calendars, elementwise, flags, query as q
from gridloom.functions.units import NONE, Units
from gridloom.operators import catalog, collapse as c, combine, healpix, regrid as rg, reshape, subspace, vertical, weights, windows
from gridloom.operators.cube import Axis, Cube
from gridloom.plans.registry import _DAILY, _daily, _dealt, _rounded, _size, _t, query
from gridloom.sources import compressed, netcdf3, zarr
from gridloom.sources.folders import as_file, new_folder
from gridloom.streaming import windows as streaming


# --- conditions -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, minute(ts) BETWEEN 10 AND 20 AS some_minutes, second(ts) < 30 AS first_half, hour(ts) IN (3, 4) AS night, ts >= TIMESTAMP '2024-01-10 12:30:00' AS late, ts < TIMESTAMP '2024-01-05' AS early FROM events")
def date_part_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = calendars.timestamp_parts(F.col("ts"))
    made = {"some_minutes": q.minute(q.wi(10, 20)), "first_half": q.second(q.lt(30)), "night": q.hour(q.set_([3, 4])), "late": q.dtge("2024-01-10 12:30:00"), "early": q.dtlt("2024-01-05")}
    return _t(spark, sf_dir, "events").select("event_id", *[x.column(parts).alias(n) for n, x in made.items()])


@query("SELECT o_orderkey, month(o_orderdate) IN (3, 4, 5) AS mam, month(o_orderdate) IN (6, 7, 8) AS jja, month(o_orderdate) IN (9, 10, 11) AS son, month(o_orderdate) IN (12, 1, 2) AS djf FROM orders")
def season_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = calendars.timestamp_parts(F.col("o_orderdate"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", *[getattr(q, n)().column(parts).alias(n) for n in ("mam", "jja", "son", "djf")])


@query("""
WITH a AS (SELECT p_partkey, p_size AS lo, p_size + p_partkey % 5 AS up FROM part)
SELECT p_partkey, lo >= 20 AS cellge, lo > 20 AS cellgt, up < 30 AS celllt, up <= 30 AS cellle, lo >= 10 AND up <= 40 AS cellwi, lo < 25 AND up > 26 AS cellwo, lo <= 25 AND up >= 25 AS contains, up - lo = 3 AS cellsize FROM a""")
def cell_bound_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the cells have their bounds the wrong way round."""
    low, high, odd = F.col("p_size"), F.col("p_size") + F.col("p_partkey") % 5, F.col("p_partkey") % 2 == 1
    columns = {"coord": low, "lower": F.when(odd, high).otherwise(low), "upper": F.when(odd, low).otherwise(high)}
    made = {"cellge": q.cellge(20), "cellgt": q.cellgt(20), "celllt": q.celllt(30), "cellle": q.cellle(30), "cellwi": q.cellwi(10, 40), "cellwo": q.cellwo(25, 26), "contains": q.contains(25), "cellsize": q.cellsize(3)}
    return _t(spark, sf_dir, "part").select("p_partkey", *[x.column(columns).alias(n) for n, x in made.items()])


@query("""
SELECT s_suppkey, s_acctbal > 2000 AS far, s_acctbal > 2000 AS same, abs(s_acctbal - 5000) <= 100 AS near, s_nationkey BETWEEN 3 AND 9 AS part, true AS equal, true AS holds, false AS holds_not FROM supplier""")
def conditions_with_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, metres = F.col("s_acctbal"), Units.of("m")
    far, near = q.gt(2, "km"), q.isclose(5000.0).setdefault(rtol=0.0, atol=100.0)
    part = q.wi(3, 9).addattr("nation")
    equal = far.equals(q.gt(2, "km")) and not far.equals(q.gt(3, "km"))
    return _t(spark, sf_dir, "supplier").select(
        "s_suppkey", far(x, metres).alias("far"), far.set_condition_units("m")(x, metres).alias("same"), near(x).alias("near"), part.column({"coord": x, "nation": F.col("s_nationkey")}).alias("part"),
        F.lit(equal).alias("equal"), F.lit((q.contains(4) & q.lt(5)).iscontains()).alias("holds"), F.lit(q.lt(5).iscontains()).alias("holds_not"),
    )


@query("SELECT p_partkey, abs(p_retailprice - 1000) <= 50 AS near, abs(p_retailprice - 1000) <= 1e-9 AS nearer, CASE WHEN p_size % 4 <> 0 THEN p_size END AS kept, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END AS mask, CASE WHEN abs(p_retailprice - 900) > 100 THEN p_retailprice END AS others, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS valid FROM part")
def masks_and_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, n = F.col("p_retailprice"), F.col("p_size")
    with config.configuration(atol=50.0, rtol=0.0):
        near = q.isclose(1000.0)(x)
    kept = elementwise.masked_where(n, n % 4 == 0)
    odd = F.when(n % 3 != 0, x).when(n % 2 == 0, float("nan")).otherwise(float("inf"))
    with config.configuration(atol=1e-9, rtol=0.0):
        nearer = q.isclose(1000.0)(x)
    return _t(spark, sf_dir, "part").select("p_partkey", near.alias("near"), nearer.alias("nearer"), kept.alias("kept"), elementwise.binary_mask(kept).alias("mask"), elementwise.masked_values(x, 900.0, 0.0, 100.0).alias("others"), elementwise.masked_invalid(odd).alias("valid"))


@query("SELECT n_nationkey, n_name LIKE 'A%' AS starts, n_name IN ('BRAZIL', 'CHINA') OR n_name LIKE '%IA' AS listed FROM nation")
def text_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    return _t(spark, sf_dir, "nation").select("n_nationkey", q.eq(re.compile("^A"))(name).alias("starts"), q.set_(["BRAZIL", "CHINA", re.compile("IA$")])(name).alias("listed"))


# --- making and reshaping -------------------------------------------------------------------------------------------


@query("SELECT kind, n, total, there FROM (SELECT count(*) AS n FROM part), (VALUES ('full', 2.5), ('masked_all', NULL), ('ones', 1.0), ('zeros', 0.0)) v(kind, x), LATERAL (SELECT (x * n)::DOUBLE AS total, CASE WHEN x IS NULL THEN 0 ELSE n END AS there)")
def filled_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = {"i": _size(_t(spark, sf_dir, "part"), "p_partkey")}
    made = {"full": reshape.full(spark, shape, 2.5), "ones": reshape.ones(spark, shape), "zeros": reshape.zeros(spark, shape), "masked_all": reshape.masked_all(spark, shape)}
    out = None
    for kind, df in made.items():
        one = df.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count("value").alias("there")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int]]:
    """part as rows of 20: y, x and the price; and the shape."""
    p, t = F.col("p_partkey"), _t(spark, sf_dir, "part")
    return t.select(F.floor(p / 20).cast("int").alias("y"), (p % 20).cast("int").alias("x"), F.col("p_retailprice").alias("v")), {"y": -(-_size(t, "p_partkey") // 20), "x": 20}


@query("SELECT p_partkey::BIGINT AS flat, (p_partkey // 20)::INT AS y, (p_partkey % 20)::INT AS x, 0 AS t, p_retailprice AS v FROM part")
def flat_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transposed, with an axis put in and taken out, flattened and given its shape again."""
    df, shape = _grid(spark, sf_dir)
    df = reshape.transpose(reshape.insert_dimension(df, "t"), ["x", "t", "y"])
    df = reshape.insert_dimension(reshape.squeeze(df, "t"), "t")
    flat = reshape.flatten(df, {"t": 1, **shape}, "flat")
    back = reshape.unflatten(flat.withColumn("k", F.col("flat")), "k", shape)
    return back.select("flat", "y", "x", F.lit(0).alias("t"), "v")


@query("SELECT (p_partkey % 20)::INT AS y, (p_partkey // 20)::INT AS x, p_retailprice AS v FROM part")
def swapped_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = _grid(spark, sf_dir)
    return df.select(*[F.col(a).alias(b) for a, b in zip(reshape.swapaxes(df.select("y", "x"), "y", "x").columns, ("y", "x"))], "v")


@query("SELECT (p_partkey // 20)::INT AS y, 3 AS section, p_retailprice AS v FROM part WHERE p_partkey % 20 = 3 UNION ALL SELECT (p_partkey // 20)::INT, 17, p_retailprice FROM part WHERE p_partkey % 20 = 17")
def sections_of_an_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, shape = _grid(spark, sf_dir)
    parts = dict(reshape.sections(df, "x", shape["x"]))
    return parts[3].withColumn("section", F.lit(3)).unionByName(parts[17].withColumn("section", F.lit(17)))


@query("SELECT max(v) FILTER (WHERE k = 0) AS first, max(v) FILTER (WHERE k = 1) AS second, max(v) FILTER (WHERE k = n - 1) AS last FROM (SELECT p_partkey AS k, p_retailprice AS v, count(*) OVER () AS n FROM part)")
def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, shape = _grid(spark, sf_dir)
    return spark.createDataFrame([tuple(reshape.element(df, shape, "v", k) for k in (0, 1, -1))], "first double, second double, last double")


# --- functions ------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, p_size + 3 AS add, 3 + p_size AS radd, p_size - 3 AS sub, p_size * 2 AS mul, p_size / 4 AS div, round(100.0::DOUBLE / p_size, 8) AS rdiv, p_size < 25 AS lt, p_size <= 25 AS le, p_size <> 25 AS ne, p_size = 25 AS eq,
       p_size > 25 AS gt, p_size >= 25 AS ge, p_size & 6 AS land, p_size | 6 AS lor, xor(p_size, 6) AS lxor, p_size << 2 AS lshift, p_size >> 1 AS rshift, -p_size AS neg, p_size AS pos, abs(p_size - 25) AS abs, ~p_size AS invert FROM part""")
def binary_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_size")
    op = lambda name, a, b: elementwise.binary(name, a, NONE, b, NONE)[0]
    one = lambda name, a: elementwise.UNARY[name](a, NONE)[0]
    made = {"add": op("add", x, F.lit(3)), "radd": op("add", F.lit(3), x), "sub": op("sub", x, F.lit(3)), "mul": op("mul", x, F.lit(2)), "div": op("truediv", x, F.lit(4)), "rdiv": F.round(op("truediv", F.lit(100.0), x), 8)}
    made |= {n: op(n, x, F.lit(25)) for n in ("lt", "le", "ne", "eq", "gt", "ge")}
    made |= {"land": op("and", x, F.lit(6)), "lor": op("or", x, F.lit(6)), "lxor": op("xor", x, F.lit(6)), "lshift": op("lshift", x, F.lit(2)), "rshift": op("rshift", x, F.lit(1))}
    made |= {"neg": one("neg", x), "pos": one("pos", x), "abs": one("abs", x - 25), "invert": one("invert", x)}
    return _t(spark, sf_dir, "part").select("p_partkey", *[v.alias(n) for n, v in made.items()])


@query("""
SELECT s_suppkey, round(cos(u), 8) AS cos, round(tan(u), 8) AS tan, round(asin(u), 8) AS arcsin, round(acos(u), 8) AS arccos, round(atan(u), 8) AS arctan, round(cosh(u), 8) AS cosh, round(tanh(u), 8) AS tanh,
       round(asinh(u), 8) AS arcsinh, round(acosh(u + 2), 8) AS arccosh, round(atanh(u / 2), 8) AS arctanh, round(u * u, 8) AS square, floor(s_acctbal)::BIGINT AS floor, round(log2(u + 2), 8) AS log2, round(ln(u + 2) / ln(7), 8) AS log7
FROM (SELECT *, s_acctbal / 20000 AS u FROM supplier)""")
def trigonometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, one = F.col("s_acctbal") / 20000, Units.of("1")
    made = {n: elementwise.UNARY[n](u, one)[0] for n in ("cos", "tan", "arcsin", "arccos", "arctan", "cosh", "tanh", "arcsinh", "square")}
    made |= {"arccosh": elementwise.UNARY["arccosh"](u + 2, one)[0], "arctanh": elementwise.UNARY["arctanh"](u / 2, one)[0], "log2": elementwise.log(u + 2, 2), "log7": elementwise.log(u + 2, 7)}
    return _t(spark, sf_dir, "supplier").select("s_suppkey", *[F.round(v, 8).alias(n) for n, v in made.items()], elementwise.UNARY["floor"](F.col("s_acctbal"), one)[0].alias("floor"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size * 2.0::DOUBLE + 1 END AS doubled FROM part")
def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = elementwise.masked_where(F.col("p_size").cast("double"), F.col("p_size") % 5 == 0)
    return _t(spark, sf_dir, "part").select("p_partkey", elementwise.func(lambda v: v * 2 + 1)(x).alias("doubled"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS text, day(last_day(o_orderdate))::BIGINT AS days, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))::DOUBLE - (SELECT count(*) FROM generate_series(1972, year(o_orderdate) - 1) t(y) WHERE y % 4 = 0)
       - CASE WHEN year(o_orderdate) % 4 = 0 AND month(o_orderdate) > 2 THEN 1 ELSE 0 END AS noleap, 0 AS minute, 0.0::DOUBLE AS second FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)""")
def calendar_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since 1970 of the same dates in a calendar without leap days, which has no 29th of February."""
    t = _t(spark, sf_dir, "orders").where("NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)")
    days = calendars.days_from_date(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"), "standard").cast("double")
    units = Units.of("days since 1970-01-01")
    noleap, new = calendars.change_calendar(days, units, "noleap")
    assert calendars.unique_calendars([new, calendars.override_calendar(units, "365_day")]) == {"365_day"}
    t = t.select("o_orderkey", noleap.alias("noleap"), F.transform(F.array(days), lambda d: F.struct(*[x.alias(k) for k, x in calendars.decode(d, units).items()]))[0].alias("p"))
    parts = {k: F.col(f"p.{k}") for k in ("year", "month", "day", "hour", "minute", "second")}
    return t.select("o_orderkey", calendars.as_string(parts).alias("text"), calendars.days_in_month(parts["year"], parts["month"], "standard").cast("long").alias("days"), "noleap", parts["minute"].cast("int").alias("minute"), parts["second"].cast("double").alias("second"))


@query("""
SELECT event_id, time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-01') AS two_days, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS hours, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS minutes,
       time_bucket(INTERVAL 30 SECOND, ts, TIMESTAMP '1970-01-01') AS seconds, ts + INTERVAL 3 HOUR AS later, ts - INTERVAL 90 SECOND AS earlier, 'P2D PT6H PT5M PT30S' AS iso, true AS factor, false AS no_factor, true AS shorter FROM events""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, made = F.col("ts"), {"two_days": calendars.D(2), "hours": calendars.h(6), "minutes": calendars.m(5), "seconds": calendars.s(30)}
    later, earlier = calendars.h(3).add_to(t), (3 * calendars.s(30)).add_to(t, -1)
    return _t(spark, sf_dir, "events").select(
        "event_id", *[d.bounds(t)[0].cast("timestamp_ntz").alias(n) for n, d in made.items()], later.cast("timestamp_ntz").alias("later"), earlier.cast("timestamp_ntz").alias("earlier"),
        F.lit(" ".join(d.iso for d in made.values())).alias("iso"), F.lit(calendars.h(6).is_day_factor).alias("factor"), F.lit(calendars.h(7).is_day_factor).alias("no_factor"), F.lit(calendars.m(5) < calendars.h(6) and calendars.D(1).same_length(calendars.h(24))).alias("shorter"),
    )


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size & 1 = 1 THEN 'odd' END, CASE WHEN (p_size & 6) = 4 THEN 'four' END, CASE WHEN p_size & 8 = 8 THEN 'eight' END], lambda x: x IS NOT NULL), ',') AS meanings FROM part")
def flag_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flags.Flags(("eight", "four", "odd"), values=(8, 4, 1), masks=(8, 6, 1)).sorted()
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(f.meanings_of(F.col("p_size")), ",").alias("meanings"))


@query("""WITH e AS (SELECT event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, value AS v FROM events), d AS (SELECT event_type, day, sum(v) AS v FROM e GROUP BY ALL), o AS (SELECT day, sum(v) AS v FROM e WHERE event_type = 'click' GROUP BY 1),
b AS (SELECT d.event_type, d.v AS x, o.v AS y FROM d FULL JOIN o ON d.day = o.day)
SELECT event_type, count(y) = (SELECT count(*) FROM o) AND bool_and(x IS NOT NULL AND y IS NOT NULL AND abs(x - y) <= 1e-9) AS same, count(y) = (SELECT count(*) FROM o) AND bool_and(x IS NOT NULL AND y IS NOT NULL AND abs(x - y) <= 0.2 * abs(y)) AS near, count(y) = (SELECT count(*) FROM o) AND bool_and(x IS NOT NULL AND y IS NOT NULL AND abs(x - y) <= 1000000.0) AS far
FROM b WHERE event_type IS NOT NULL GROUP BY 1""")
def close_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind's daily sums against those of clicks, within three tolerances."""
    e = _t(spark, sf_dir, "events").select("event_type", F.datediff("ts", F.lit("2024-01-01")).alias("day"), "value")
    daily = e.groupBy("event_type", "day").agg(F.sum("value").alias("v"))
    clicks = daily.where("event_type = 'click'").select("day", "v")
    tolerances = {"same": (0.0, 1e-9), "near": (0.2, 0.0), "far": (0.0, 1e6)}
    found = [(k, *(combine.allclose(daily.where(F.col("event_type") == k).select("day", "v"), clicks, ["day"], "v", rtol=r, atol=a) for r, a in tolerances.values())) for k in (r[0] for r in e.select("event_type").distinct().collect())]
    return spark.createDataFrame(found, "event_type string, same boolean, near boolean, far boolean")


# --- weights and geometry -------------------------------------------------------------------------------------------


@query("WITH " + _DAILY + """, a AS (SELECT i, (i * i + i)::DOUBLE AS coord, lag(i * i + i) OVER (ORDER BY i) AS p, lead(i * i + i) OVER (ORDER BY i) AS n FROM daily),
b AS (SELECT i, coord, CASE WHEN p IS NULL THEN 2 * coord - (coord + n) / 2.0 ELSE (coord + p) / 2.0 END AS lower, CASE WHEN n IS NULL THEN 2 * coord - (coord + p) / 2.0 ELSE (coord + n) / 2.0 END AS upper FROM a)
SELECT i, coord, lower, upper, upper - lower AS size, round((upper - lower) * 10 / max(upper - lower) OVER (), 8) AS scaled, true AS contiguous FROM b""")
def bounds_and_cell_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = _daily(spark, sf_dir).select("i", (F.col("i") * F.col("i") + F.col("i")).cast("double").alias("coord"))
    made = weights.create_bounds(axis)
    rows = made.withColumn("size", weights.linear(F.col("lower"), F.col("upper")))
    rows = weights.scaled(weights.positive(rows.withColumn("scaled", weights.cellsize(F.col("lower"), F.col("upper"))), "scaled"), "scaled", 10.0)
    return rows.withColumns({"scaled": F.round("scaled", 8), "contiguous": F.lit(weights.contiguous(made))})


@query("""
SELECT p_partkey, round(radians(p_size) * 4, 6) AS triangle, round(radians(p_size) * 2 * 4, 6) AS lune, round(radians(p_size) * 2 * 4, 6) AS halves, round(radians(p_size) * 2 * sin(radians(p_size % 10 + 1)), 6) AS box FROM part""")
def spherical_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a sphere of radius 2: a triangle with a corner at the pole, a lune from pole to pole, the sum of its halves, and a box by latitudes and longitudes."""
    a, zero, pole = F.col("p_size").cast("double"), F.lit(0.0), F.lit(90.0)
    north = weights.spherical_polygon_area(F.array(zero, a, zero), F.array(zero, zero, pole), 2.0)
    # From pole to pole, with corners on the equator: a lune's edges are two half circles.
    lune = weights.spherical_polygon_area(F.array(zero, zero, a, a), F.array(-pole, zero, pole, zero), 2.0)
    south = weights.spherical_polygon_area(F.array(zero, zero, a), F.array(zero, -pole, zero), 2.0)
    h = (F.col("p_size") % 10 + 1).cast("double")
    box = weights.area(zero, a, zero, h, measure=True, radius=2.0) / 2
    return _rounded(_t(spark, sf_dir, "part").select("p_partkey", north.alias("triangle"), lune.alias("lune"), (north + south).alias("halves"), box.alias("box")), 6, "triangle", "lune", "halves", "box")


@query("SELECT p_partkey AS cell, round(p_size * 10.0::DOUBLE + 6 - 0.25 * p_size, 6) AS area, round(20.0 + 2 * p_size + 0.0::DOUBLE, 6) AS length FROM part")
def geometry_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a cell of three rings: a box of p_size by 10, a triangle of 4 by 3, and a hole of p_size / 2 by a half."""
    n = F.col("p_size").cast("double")
    ring = lambda k, hole, *xy: F.struct(F.lit(k).alias("part"), F.lit(hole).alias("hole"), F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in xy]).alias("v"))
    z, lit = F.lit(0.0), lambda v: F.lit(float(v))
    rings = [ring(0, False, (z, z), (n, z), (n, lit(10)), (z, lit(10))), ring(1, False, (lit(100), z), (lit(104), z), (lit(100), lit(3))), ring(2, True, (z, z), (n / 2, z), (n / 2, lit(0.5)), (z, lit(0.5)))]
    cells = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), F.explode(F.array(*rings)).alias("r")).select("cell", "r.*")
    nodes = cells.select("cell", "part", "hole", F.posexplode("v").alias("node", "p")).select("cell", "part", "hole", "node", "p.x", "p.y")
    area = weights.geometry_area(nodes, "cell", "part", "node", "x", "y", "hole", spherical=False)
    outline = nodes.where("part = 0").unionByName(nodes.where("part = 0 AND node = 0").withColumn("node", F.lit(4)))
    length = weights.geometry_length(outline, "cell", "part", "node", "x", "y", spherical=False)
    return _rounded(area.join(length, "cell"), 6, "area", "length")


@query("SELECT p_partkey, round(pi() * 6371229.0 * 6371229.0 / 3 / power(4, p_size % 30) / 1e6, 6) AS km2, round(1 / power(4, p_size % 30), 15) AS relative FROM part")
def healpix_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("p_size") % (healpix.MAX_LEVEL + 1)
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(weights.healpix_area(level, measure=True) / 1e6, 6).alias("km2"), F.round(weights.healpix_area(level), 15).alias("relative"))


@query("""
WITH f AS (SELECT p_partkey, p_partkey % 12 AS f FROM part),
c AS (SELECT *, CASE WHEN f // 4 = 1 THEN (f % 4) * 90.0 ELSE (f % 4) * 90.0 + 45 END AS lon, (1 - f // 4) * degrees(asin(2 / 3.0::DOUBLE)) AS lat FROM f)
SELECT p_partkey, round(lon::DOUBLE, 8) AS lon, round(lat, 8) + 0.0 AS lat, round(CASE f // 4 WHEN 0 THEN 90 WHEN 1 THEN degrees(asin(2 / 3.0::DOUBLE)) ELSE 0 END, 8) AS north, round(CASE f // 4 WHEN 0 THEN 0 WHEN 1 THEN -degrees(asin(2 / 3.0::DOUBLE)) ELSE -90 END, 8) + 0.0 AS south FROM c""")
def healpix_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres and the northern and southern corners of the twelve base cells."""
    f = F.col("p_partkey") % 12
    rows = _dealt(_t(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", healpix.centre(f, 0).alias("c"), healpix.corners(f, 0).alias("v"))
    lats = F.transform("v", lambda p: p["lat"])
    return rows.select("p_partkey", F.round(F.pmod(F.col("c.lon"), F.lit(360.0)), 8).alias("lon"), (F.round("c.lat", 8) + 0.0).alias("lat"), F.round(F.array_max(lats), 8).alias("north"), (F.round(F.array_min(lats), 8) + 0.0).alias("south"))


@query("SELECT p_partkey, p_partkey AS found FROM part")
def healpix_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell that holds each cell's centre."""
    t = _dealt(_t(spark, sf_dir, "part").select("p_partkey"))
    level = next(k for k in range(healpix.MAX_LEVEL + 1) if 12 * 4**k >= _size(t, "p_partkey"))
    at = t.select("p_partkey", healpix.centre(F.col("p_partkey"), level).alias("c"))
    return at.select("p_partkey", healpix.locate(F.col("c.lon"), F.col("c.lat"), level).alias("found"))


# --- vertical coordinates -------------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT s_suppkey, -(s_suppkey % 9 + 1) / 10.0::DOUBLE AS s, (s_acctbal + 1000) / 100 AS eta, 4000.0::DOUBLE + s_suppkey % 50 AS depth FROM supplier),
u AS (SELECT *, (1 - 0.4) * sinh(5 * s) / sinh(5.0) + 0.4 * (tanh(5 * (s + 0.5)) / (2 * tanh(2.5)) - 0.5) AS big_c, 0.5 * (3000 + 100) + 0.5 * (3000 - 100) * tanh(2 * 0.1 / (3000 - 100) * (depth - 2000)) AS f FROM t)
SELECT s_suppkey, round(5000 + 0.3 * eta, 5) AS pressure, round(0.2 * 20000 + 0.5 * eta + 0.25 * depth, 5) AS sleve, round(eta + s * (depth + eta), 5) AS sigma,
       round(eta * (1 + s) + 40 * s + (depth - 40) * big_c, 5) AS s_coordinate, round(40 * s + (depth - 40) * s * s + eta * (1 + (40 * s + (depth - 40) * s * s) / depth), 5) AS g1,
       round(eta + (eta + depth) * (40 * s + depth * s * s) / (depth + 40), 5) AS g2, round(CASE WHEN s_suppkey % 9 < 5 THEN eta + s * (least(40, depth) + eta) ELSE -depth / 2 END, 5) AS sigma_z,
       round(CASE WHEN s_suppkey % 9 <= 4 THEN s * f ELSE f + (s - 1) * (depth - f) END, 5) AS double_sigma FROM u""")
def vertical_coordinates_of_the_ocean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit, key = lambda v: F.lit(float(v)), F.col("s_suppkey")
    s, eta, depth = -(key % 9 + 1) / 10.0, (F.col("s_acctbal") + 1000) / 100, 4000.0 + key % 50
    base = {"s": s, "sigma": s, "eta": eta, "depth": depth, "depth_c": lit(40), "C": s * s, "k": key % 9}
    made = {
        "pressure": ("atmosphere_hybrid_sigma_pressure_coordinate", {"a": lit(0.05), "p0": lit(100000), "b": lit(0.3), "ps": eta}),
        "sleve": ("atmosphere_sleve_coordinate", {"a": lit(0.2), "ztop": lit(20000), "b1": lit(0.5), "zsurf1": eta, "b2": lit(0.25), "zsurf2": depth}),
        "sigma": ("ocean_sigma_coordinate", base), "s_coordinate": ("ocean_s_coordinate", base | {"a": lit(5), "b": lit(0.4)}), "g1": ("ocean_s_coordinate_g1", base), "g2": ("ocean_s_coordinate_g2", base),
        "sigma_z": ("ocean_sigma_z_coordinate", base | {"nsigma": lit(5), "zlev": -depth / 2}),
        "double_sigma": ("ocean_double_sigma_coordinate", base | {"a": lit(0.1), "z1": lit(3000), "z2": lit(100), "href": lit(2000), "k_c": lit(4)}),
    }
    return _t(spark, sf_dir, "supplier").select("s_suppkey", *[F.round(vertical.compute(name, terms)[1], 5).alias(n) for n, (name, terms) in made.items()])


# --- along axes -----------------------------------------------------------------------------------------------------

_MODES = {
    "reflect": "CASE WHEN j < 0 THEN -1 - j WHEN j >= cells THEN 2 * cells - 1 - j ELSE j END", "mirror": "CASE WHEN j < 0 THEN -j WHEN j >= cells THEN 2 * (cells - 1) - j ELSE j END",
    "nearest": "greatest(0, least(cells - 1, j))", "wrap": "((j % cells) + cells) % cells",
}


@query("WITH " + _DAILY + ", c AS (SELECT max(i) + 1 AS cells FROM daily), w AS (SELECT i, cells, unnest(range(i - 2, i + 3)) AS j FROM daily, c), "
       + ", ".join(f"{m} AS (SELECT w.i, round(avg(d.x), 4) AS x FROM w JOIN daily d ON d.i = {at} GROUP BY 1)" for m, at in _MODES.items())
       + " SELECT i, " + ", ".join(f"{m}.x AS {m}" for m in _MODES) + " FROM reflect JOIN mirror USING (i) JOIN nearest USING (i) JOIN wrap USING (i)")
def moving_window_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily, out = _daily(spark, sf_dir).select("i", "x"), None
    for m in _MODES:
        one = windows.moving_window(daily, [], "i", "x", "mean", 5, mode=m).select("i", F.round("x", 4).alias(m))
        out = one if out is None else out.join(one, "i")
    return out


@query("WITH " + _DAILY + " SELECT d.i, round(0.25 * a.x + 0.5 * d.x + 0.25 * b.x, 4) AS x FROM daily d JOIN daily a ON a.i = CASE WHEN d.i = 0 THEN 0 ELSE d.i - 1 END JOIN daily b ON b.i = least(d.i + 1, (SELECT max(i) FROM daily))")
def convolution_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.convolution_filter(_daily(spark, sf_dir).select("i", "x"), [], "i", "x", [0.25, 0.5, 0.25], "reflect"), 4, "x")


@query("""
WITH g AS (SELECT (p_partkey // 20)::INT AS y, (p_partkey % 20)::INT AS x, p_retailprice AS u, p_size::DOUBLE AS v FROM part),
d AS (SELECT *, (lead(v) OVER r - lag(v) OVER r) / 4.0 AS vx, (lead(u) OVER c - lag(u) OVER c) / 6.0 AS uy FROM g WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))
SELECT y, x, round(vx - uy, 6) AS curl FROM d""")
def curl_on_a_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    g = _t(spark, sf_dir, "part").select(F.floor(p / 20).cast("int").alias("y"), (p % 20).cast("int").alias("x"), F.col("p_retailprice").alias("u"), F.col("p_size").cast("double").alias("v"))
    g = g.withColumns({"cx": F.col("x") * 2.0, "cy": F.col("y") * 3.0})
    return _rounded(windows.curl_xy(g, [], "x", "y", "cx", "cy", "u", "v", spherical=False).select("y", "x", "curl"), 6, "curl")


@query("""
WITH g AS (SELECT (p_partkey // 20)::INT AS y, (p_partkey % 20)::INT AS x, p_retailprice AS u, p_size::DOUBLE AS v, radians((p_partkey % 20) * 2.0) AS lon, radians((p_partkey // 20) * 0.05 - 50) AS lat FROM part),
d AS (SELECT *, (lead(v) OVER r - lag(v) OVER r) / (lead(lon) OVER r - lag(lon) OVER r) AS vx, (lead(u * cos(lat)) OVER c - lag(u * cos(lat)) OVER c) / (lead(lat) OVER c - lag(lat) OVER c) AS uy FROM g
      WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))
SELECT y, x, round((vx - uy) / (6371229.0 * cos(lat)) * 1e3, 6) AS vorticity FROM d""")
def vorticity_on_the_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    g = _t(spark, sf_dir, "part").select(F.floor(p / 20).cast("int").alias("y"), (p % 20).cast("int").alias("x"), F.col("p_retailprice").alias("u"), F.col("p_size").cast("double").alias("v"))
    g = g.withColumns({"lon": F.col("x") * 2.0, "lat": F.col("y") * 0.05 - 50})
    got = windows.relative_vorticity(g, [], "x", "y", "lon", "lat", "u", "v", out="vorticity")
    return got.select("y", "x", F.round(F.col("vorticity") * 1e3, 6).alias("vorticity"))


@query("""
WITH a AS (SELECT p_partkey AS k, 360.0::DOUBLE * p_partkey / (SELECT count(*) FROM part) AS lon, p_retailprice AS v FROM part), b AS (SELECT *, CASE WHEN lon < 100.5 THEN lon + 360 ELSE lon END AS place FROM a)
SELECT (row_number() OVER (ORDER BY place) - 1)::INT AS i_lon, round(place, 8) AS lon, v AS value FROM b""")
def anchored_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "part")
    n = _size(t, "p_partkey")
    axis = Axis("lon", n, spark.range(n).select(F.col("id").cast("int").alias("i"), (F.lit(360.0) * F.col("id") / n).alias("coord")), Units.of("degrees_east"), None, "longitude", "X")
    cube = Cube(t.select(F.col("p_partkey").cast("int").alias("i_lon"), F.col("p_retailprice").alias("value")), {"lon": axis})
    cube = cube.cyclic("X", 360.0)
    assert cube.iscyclic("longitude") and cube.direction("X") and cube.directions() == {"lon": True}
    return _rounded(cube.roll("X", 7).anchor("X", 100.5).with_coords(), 8, "lon").select("i_lon", "lon", "value")


# --- cubes ----------------------------------------------------------------------------------------------------------


def _events_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """Sums of events by type and day; units of the day axis in days."""
    e = _t(spark, sf_dir, "events").groupBy("event_type", F.datediff("ts", F.lit("2024-01-01")).alias("day")).agg(F.round(F.sum("value"), 4).alias("total"))
    return Cube.from_table(e, {"kind": "event_type", "day": "day"}, "total", "kg", "mass", {"day": "days"})


_EVENTS = "e AS (SELECT event_type AS kind, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))::INT AS day, round(sum(value), 4) AS v FROM events GROUP BY ALL)"


@query("WITH " + _EVENTS + " SELECT kind, day, round(2 * v - avg(v) OVER (PARTITION BY kind), 4) AS value, 0.0::DOUBLE AS nothing, v > 50 AS many FROM e")
def cube_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _events_cube(spark, sf_dir)
    out = (cube + cube) - cube.collapse("mean", ["day"])
    nothing, many = cube - cube, cube.override_units(None) > 50
    rows = out.with_coords().join(nothing.df.withColumnRenamed("value", "nothing"), cube.keys).join(many.df.withColumnRenamed("value", "many"), cube.keys)
    return _rounded(rows.select("kind", "day", "value", "nothing", "many"), 4, "value")


@query("WITH " + _EVENTS + " SELECT kind, round(sum(v * 2), 2) AS value, 'kg.days' AS units FROM e GROUP BY 1")
def cube_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two days each; the units are the values' times the weights'."""
    cube = _events_cube(spark, sf_dir)
    day = cube.axis("day")
    table = day.table.withColumns({"lower": F.col("coord") * 2.0, "upper": F.col("coord") * 2.0 + 2})
    cube = Cube(cube.df, {**cube.axes, "day": Axis("day", day.size, table, Units.of("days"))}, "value", cube.units, cube.name)
    out = cube.collapse("integral", ["day"], weights=cube.weights("day"))
    same = out.units.equivalent(Units.of("kg") * Units.of("days"))
    return _rounded(out.with_coords().select("kind", "value", F.lit("kg.days" if same else out.units.text).alias("units")), 2, "value")


@query("WITH " + _EVENTS + " SELECT kind, max(v) AS maximum, round(median(v), 4) AS median, arg_max(day, v) AS day_of_most FROM e GROUP BY 1")
def cube_collapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _events_cube(spark, sf_dir)
    most = cube.collapse("maximum", ["day"]).with_coords().withColumnRenamed("value", "maximum")
    median = cube.collapse("median", ["day"]).df.withColumnRenamed("value", "median")
    at = cube.extreme_positions(["day"]).join(cube.axis("day").keyed().select("i_day", F.col("coord").alias("day_of_most")), "i_day")
    return _rounded(most.join(median, "i_kind").join(at, "i_kind").select("kind", "maximum", "median", "day_of_most"), 4, "median")


@query("WITH " + _EVENTS + " SELECT kind, day // 7 AS week, count(*) AS n, round(sum(v), 3) AS total FROM e WHERE day >= 2 GROUP BY ALL")
def cube_subspace_and_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _events_cube(spark, sf_dir).subspace(day=q.ge(2))
    label = F.floor(F.col("coord") / 7)
    total, n = cube.grouped("sum", "day", label), cube.grouped("sample_size", "day", label)
    rows = total.df.withColumnRenamed("value", "total").join(n.df.withColumnRenamed("value", "n"), total.keys)
    kinds = cube.axis("kind").keyed().select("i_kind", F.col("coord").alias("kind"))
    return _rounded(rows.join(kinds, "i_kind").select("kind", F.col("i_day").cast("int").alias("week"), "n", "total"), 3, "total")


@query("WITH " + _EVENTS + """, n AS (SELECT max(day) + 1 AS n FROM e), s AS (SELECT kind, day, round(sum(v) OVER (PARTITION BY kind ORDER BY day), 3) AS v FROM e)
SELECT kind, (n - 1 - day)::INT AS i_day, v AS value FROM s, n""")
def cube_along_an_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums, then turned round, with an axis of one cell put in and taken out."""
    cube = _events_cube(spark, sf_dir).cumsum("day").flip("day").insert_dimension(Axis("height", 1)).squeeze().transpose(["day", "kind"])
    return _rounded(cube.df.join(cube.axis("kind").keyed().select("i_kind", F.col("coord").alias("kind")), "i_kind").select("kind", "i_day", "value"), 3, "value")


@query("WITH " + _EVENTS + " SELECT kind, round(min(v), 4) AS low, round(max(v), 4) AS high, round(avg(least(greatest(v, 10), 60)), 4) AS clipped, count(*) FILTER (WHERE v > 40) AS masked, round(avg(v) * 1000, 2) AS grams FROM e GROUP BY 1")
def cube_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube, out = _events_cube(spark, sf_dir), None
    high = cube.masked_where(q.gt(40, "kg"))
    made = {"low": cube.collapse("minimum", ["day"]), "high": abs(cube).collapse("max", ["day"]), "clipped": cube.clip(10, 60).collapse("mean", ["day"]), "masked": high.collapse("count_masked", ["day"]), "grams": cube.to_units("g").collapse("mean", ["day"])}
    for n, one in made.items():
        df = one.df.withColumnRenamed("value", n)
        out = df if out is None else out.join(df, "i_kind")
    assert high.is_masked() and not cube.is_masked() and high.equals(high) and cube.shape["i_kind"] == cube.axis("kind").size
    kinds = cube.axis("kind").keyed().select("i_kind", F.col("coord").alias("kind"))
    return _rounded(_rounded(out.join(kinds, "i_kind").drop("i_kind"), 4, "low", "high", "clipped"), 2, "grams")


@query("""WITH k AS (SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1)
SELECT 'by name' AS how, event_type AS name, total FROM k WHERE event_type IN ('click', 'view') UNION ALL SELECT 'by units', event_type, total FROM k WHERE event_type < 'm' UNION ALL SELECT 'by property', event_type, total FROM k WHERE n % 2 = 0
UNION ALL SELECT 'by rank', event_type, total FROM k""")
def selected_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube of daily sums for each kind of event, with units, a property and a rank to choose by; the sums of the chosen ones."""
    e = _t(spark, sf_dir, "events").select("event_type", F.datediff("ts", F.lit("2024-01-01")).cast("int").alias("i_day"), "value")
    sizes = {r[0]: r[1] for r in e.groupBy("event_type").count().collect()}
    days = _size(e, "i_day")
    axis = Axis("day", days)
    made = []
    for kind, n in sizes.items():
        rows = e.where(F.col("event_type") == kind).groupBy("i_day").agg(F.sum("value").alias("value"))
        made.append(Cube(rows, {"day": axis}, "value", Units.of("km" if kind < "m" else "K"), kind, {"even": n % 2 == 0}))
    cubes = catalog.CubeList(made)
    found = {"by name": cubes.select_by_identity("click", "view"), "by units": cubes.select_by_units("m", exact=False), "by property": cubes.select_by_property(even=True), "by rank": cubes.select_by_rank(1)}
    out = [c.df.select(F.lit(how).alias("how"), F.lit(c.name).alias("name"), "value") for how, chosen in found.items() for c in chosen]
    rows = out[0]
    for other in out[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("how", "name").agg(F.round(F.sum("value"), 3).alias("total"))


# --- statistics -----------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS v, count(*) AS n, 0.3::DOUBLE AS q FROM orders GROUP BY 1), i AS (SELECT *, unnest([
  {'m': 'linear', 'h': q * (n - 1)}, {'m': 'lower', 'h': floor(q * (n - 1))}, {'m': 'higher', 'h': ceil(q * (n - 1))}, {'m': 'midpoint', 'h': (floor(q * (n - 1)) + ceil(q * (n - 1))) / 2}, {'m': 'nearest', 'h': round_even(q * (n - 1), 0)},
  {'m': 'weibull', 'h': q * (n + 1) - 1}, {'m': 'hazen', 'h': q * n - 0.5}, {'m': 'median_unbiased', 'h': q * (n + 1.0 / 3) - 2.0 / 3}, {'m': 'normal_unbiased', 'h': q * (n + 0.25) - 0.625}, {'m': 'interpolated_inverted_cdf', 'h': q * n - 1},
  {'m': 'inverted_cdf', 'h': ceil(round(q * n, 9)) - 1}, {'m': 'averaged_inverted_cdf', 'h': CASE WHEN round(q * n, 9) = floor(round(q * n, 9)) THEN round(q * n, 9) - 0.5 ELSE ceil(q * n) - 1 END},
  {'m': 'closest_observation', 'h': CASE WHEN round(q * n - 0.5, 9) = floor(round(q * n - 0.5, 9)) AND floor(round(q * n - 0.5, 9))::BIGINT % 2 = 0 THEN round(q * n - 0.5, 9) - 1 ELSE floor(round(q * n - 0.5, 9)) END}]) AS k FROM s),
p AS (SELECT *, greatest(0, least(n - 1, k.h)) AS h FROM i)
SELECT o_orderpriority, k.m AS method, round(v[floor(h)::BIGINT + 1] + (v[ceil(h)::BIGINT + 1] - v[floor(h)::BIGINT + 1]) * (h - floor(h)), 4) AS value FROM p""")
def percentile_every_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, out = _t(spark, sf_dir, "orders"), None
    for m in c.PERCENTILE_METHODS:
        one = c.percentile(orders, ["o_orderpriority"], "o_totalprice", [30], m).select("o_orderpriority", F.lit(m).alias("method"), F.round("o_totalprice", 4).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT min(p_size)::DOUBLE AS minimum, round(avg(p_size), 6) AS mean, median(p_size)::DOUBLE AS median, max(p_size)::DOUBLE AS maximum, (max(p_size) - min(p_size))::DOUBLE AS range, (max(p_size) + min(p_size)) / 2 AS mid_range, round(stddev_pop(p_size), 6) AS standard_deviation, round(sqrt(avg(p_size * p_size)), 6) AS root_mean_square, count(*) AS sample_size FROM part")
def statistics_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = c.stats(_t(spark, sf_dir, "part"), "p_size")
    return _rounded(got, 6, *[x for x in got.columns if x != "sample_size"])


# --- grids and meshes -----------------------------------------------------------------------------------------------


@query("SELECT (p_partkey // 20 // 2)::INT AS y, (p_partkey % 20 // 4)::INT AS x, round(avg(p_retailprice), 6) AS v FROM part GROUP BY ALL")
def regrid_conservative_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From cells of 1 by 1 to cells of 2 by 4 on a plane."""
    df, shape = _grid(spark, sf_dir)
    axes = {n: (weights.regular_axis(spark, 0.0, float(shape[n] // k * k), 1.0), weights.regular_axis(spark, 0.0, float(shape[n] // k * k), float(k))) for n, k in (("y", 2), ("x", 4))}
    return _rounded(rg.regrid(df, [], "v", "conservative", axes).select("y", "x", "v"), 6, "v")


@query("SELECT (p_partkey // 20)::INT AS y, (p_partkey % 20)::INT AS x, round(3.0::DOUBLE * (p_partkey // 20) + 0.5::DOUBLE * (p_partkey % 20), 6) AS v FROM part WHERE p_partkey // 20 < (SELECT max(p_partkey) // 20 FROM part) AND p_partkey % 20 < 19")
def regrid_linear_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane taken to the middles between its points, and put back to their numbers."""
    df, shape = _grid(spark, sf_dir)
    df = df.withColumn("v", 3.0 * F.col("y") + 0.5 * F.col("x"))
    point = lambda n, at: spark.range(n).select(F.col("id").cast("int").alias("i"), (F.col("id") + at).cast("double").alias("coord"))
    axes = {n: (point(k, 0.0), point(k - 1, 0.5)) for n, k in shape.items()}
    return _rounded(rg.regrid(df, [], "v", "linear", axes).select("y", "x", (F.col("v") - 1.75).alias("v")), 6, "v")


@query("SELECT p_partkey AS cell, [{'x': p_partkey, 'y': 0}, {'x': p_partkey + 1, 'y': 0}, {'x': p_partkey + 1, 'y': 1}, {'x': p_partkey, 'y': 1}] IS NOT NULL AS closed, CASE WHEN p_partkey IN (0, (SELECT max(p_partkey) FROM part)) THEN 1 ELSE 2 END AS neighbours, p_partkey AS low, p_partkey + 1 AS high FROM part")
def mesh_of_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as boxes in a row that share edges: bounds from nodes, and cells that touch."""
    k, t = F.col("cell"), _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"))
    mesh = t.select("cell", F.posexplode(F.array(2 * k, 2 * (k + 1), 2 * (k + 1) + 1, 2 * k + 1)).alias("k", "node"))
    nodes = mesh.select("node").distinct().select("node", F.floor(F.col("node") / 2).cast("double").alias("x"), (F.col("node") % 2).cast("double").alias("y"))
    bounds = compressed.bounds_from_nodes(mesh, nodes)
    near = compressed.cell_connectivity(mesh)
    n = near.groupBy(F.col(near.columns[0]).alias("cell")).agg(F.count("*").cast("int").alias("neighbours"))
    xs = F.transform("vertices", lambda v: v["x"])
    return bounds.join(n, "cell").select("cell", (F.size("vertices") == 4).alias("closed"), "neighbours", F.array_min(xs).cast("long").alias("low"), F.array_max(xs).cast("long").alias("high"))


@query("SELECT l_orderkey AS a, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT -1 - l_partkey, count(DISTINCT l_orderkey) FROM lineitem GROUP BY l_partkey")
def point_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts as points, line items as edges: each point's neighbours."""
    edges = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), (-1 - F.col("l_partkey")).alias("b"))
    got = compressed.point_topology(edges)
    return got.groupBy(F.col(got.columns[0]).alias("a")).agg(F.count("*").alias("n"))


@query("SELECT i_station, i_profile_element, i_element, x FROM (SELECT o_custkey AS i_station, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i_profile_element, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS i_element, l_extendedprice AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def ragged_indexed_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items laid end to end by order, orders as profiles of customers as stations."""
    from pyspark.sql import Window

    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = _t(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    obs = reshape.numbered(items.withColumn("k", F.col("l_orderkey") * (1 << 24) + place), "k", "i_obs").select("i_obs", F.col("l_extendedprice").alias("x"))
    counts = items.groupBy("l_orderkey", "o_custkey").agg(F.count("*").alias("row_size"))
    profiles = reshape.numbered(counts, "l_orderkey", "i_profile").select("i_profile", F.col("o_custkey").alias("i_station"), "row_size")
    got = compressed.ragged_indexed_contiguous(obs, profiles)
    return got.select("i_station", F.col("i_profile_element").cast("long").alias("i_profile_element"), F.col("i_element").cast("long").alias("i_element"), "x")


@query("SELECT (p_partkey // 20)::INT AS y, (p_partkey % 20)::INT AS x, round(5.0 * (p_partkey // 20) + 2 * (p_partkey % 20) + (p_partkey // 20) * (p_partkey % 20) / 10.0, 6) AS v FROM part WHERE p_partkey % 20 <= 18 AND p_partkey // 20 <= (SELECT max(p_partkey) // 20 // 3 * 3 FROM part)")
def subsampled_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bilinear surface from every third point each way."""
    df, shape = _grid(spark, sf_dir)
    ties = df.where("x % 3 = 0 AND y % 3 = 0").withColumn("v", 5.0 * F.col("y") + 2 * F.col("x") + F.col("y") * F.col("x") / 10.0)
    got = compressed.subsampled_bilinear(ties, "x", "y", [], "v").select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")
    return _rounded(got, 6, "v")


# --- files ----------------------------------------------------------------------------------------------------------


@query("SELECT (p_partkey // 20)::INT AS i_y, (p_partkey % 20)::INT AS i_x, CASE WHEN p_size % 6 <> 0 THEN p_retailprice END AS v, p_size * 0.5::DOUBLE AS n FROM part")
def netcdf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a file, with missing values and packed integers, and read again."""
    p, t = F.col("p_partkey"), _t(spark, sf_dir, "part")
    ny = -(-_size(t, "p_partkey") // 20)
    df = t.select(F.floor(p / 20).cast("int").alias("i_y"), (p % 20).cast("int").alias("i_x"), F.when(F.col("p_size") % 6 != 0, F.col("p_retailprice")).alias("v"), F.col("p_size").alias("n"))
    path = os.path.join(as_file(new_folder(spark, "netcdf")), "part.nc")
    netcdf3.write(path, {"y": ny, "x": 20}, {"v": (df, ["y", "x"], "f8", {"units": "1", "_FillValue": -1e30}), "n": (df, ["y", "x"], "i4", {"scale_factor": 0.5})})
    return netcdf3.read(spark, path, "v").join(netcdf3.read(spark, path, "n"), ["i_y", "i_x"])


@query("SELECT (p_partkey // 20)::INT AS i_y, (p_partkey % 20)::INT AS i_x, CASE WHEN p_size % 6 <> 0 THEN p_retailprice END AS value FROM part")
def zarr_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = F.col("p_partkey"), _t(spark, sf_dir, "part")
    df = t.select(F.floor(p / 20).cast("int").alias("i_y"), (p % 20).cast("int").alias("i_x"), F.when(F.col("p_size") % 6 != 0, F.col("p_retailprice")).alias("value"))
    place = os.path.join(as_file(new_folder(spark, "zarr")), "part.zarr")
    zarr.write(df, place, {"y": -(-_size(t, "p_partkey") // 20), "x": 20}, {"y": 16, "x": 7})
    return zarr.read(spark, place)


# --- streams --------------------------------------------------------------------------------------------------------


@query("""
SELECT s AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = streaming.run_to_table(streaming.sliding(streaming.read_events(spark, sf_dir), "2 days", "1 day", ["event_type"]), "stream_sliding")
    return _rounded(got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), 3, "total")


@query("SELECT event_id, value FROM events")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended to a stored field by a checkpointed stream that is started twice: every row is there once."""
    place = new_folder(spark, "append")
    for _ in range(2):
        streaming.append_to_field(streaming.read_events(spark, sf_dir).select("event_id", "value"), f"{place}/out", f"{place}/check").awaitTermination()
    return spark.read.parquet(f"{place}/out")


@query("WITH " + _EVENTS + """, m AS (SELECT kind, day, CASE WHEN v <= 3300 THEN v END AS v FROM e), s AS (SELECT kind, count(v) AS hard, count(*) AS soft FROM m GROUP BY 1)
SELECT kind, hard, soft, (SELECT count(*) FROM (SELECT DISTINCT day FROM e) WHERE day % 3 = 1) AS third, (SELECT max(day) + 1 FROM e)::DOUBLE AS upper, true AS same, 'day' AS axes FROM s""")
def cube_masks_bounds_and_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a hard and a soft mask leave, a subspace by a function, bounds, digests and axes by their units."""
    cube = _events_cube(spark, sf_dir)
    day = cube.axis("day")
    table = day.table.withColumns({"lower": F.col("coord") + 1.0, "upper": F.col("coord") * 1.0})
    cube = Cube(cube.df, {**cube.axes, "day": Axis("day", day.size, table, Units.of("days"))}, "value", cube.units, cube.name)
    masked = cube.masked_where(q.gt(3300, "kg"))
    hard, soft = (m.where(F.col("value").isNull(), 1.0).collapse("sample_size", ["day"]).df for m in (masked.harden_mask(), masked.soften_mask()))
    third = cube.subspace(day=lambda x: x % 3 == 1).axis("day").size
    upper = cube.upper_bounds("day").agg(F.max("bound")).first()[0]
    assert cube.lower_bounds("day").agg(F.min("bound")).first()[0] == 0 and cube.get_fill_value() > 9e36 and cube.persist().rechunk(3, ["day"]).df.rdd.getNumPartitions() <= 3
    same = cube.rechunk(5).digest() == cube.digest()
    axes = " ".join(a.name for a in cube.filter_axes(units="hours"))
    rows = hard.withColumnRenamed("value", "hard").join(soft.withColumnRenamed("value", "soft"), "i_kind").join(cube.axis("kind").keyed().select("i_kind", F.col("coord").alias("kind")), "i_kind")
    return rows.select("kind", "hard", "soft", F.lit(third).cast("long").alias("third"), F.lit(upper).cast("double").alias("upper"), F.lit(same).alias("same"), F.lit(axes).alias("axes"))
