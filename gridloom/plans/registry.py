"""Queries over the driver's tables, one for each operator or family of operators, with equivalent SQL."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import calendars, elementwise, flags, query as q
from gridloom.functions.units import ONE, Units
from gridloom.operators import binning, collapse as c, combine, grouping, healpix, regrid as rg, reshape, subspace, vertical, weights, windows
from gridloom.sources import compressed as compressed_
from gridloom.streaming import windows as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows dealt out to all cores, for what takes long for each row: a small file is one partition, however many rows it holds."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({x: F.round(F.col(x).cast("double"), digits) for x in columns})


def _masked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the price of every first line missing."""
    return _t(spark, sf_dir, "lineitem").withColumn("x", F.when(F.col("l_linenumber") != 1, F.col("l_extendedprice")))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events by day: i (from 0), x (sum of values), n."""
    e = _t(spark, sf_dir, "events")
    return e.groupBy(F.datediff("ts", F.lit("2024-01-01")).alias("i")).agg(F.round(F.sum("value"), 4).alias("x"), F.count("*").alias("n"))


def _size(rows: DataFrame, index: str) -> int:
    """Cells of the axis whose positions are in a column: one more than the largest, 0 for an empty table."""
    most = rows.agg(F.max(index)).first()[0]
    return 0 if most is None else int(most) + 1


_DAILY = "daily AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))::INT AS i, round(sum(value), 4) AS x, count(*) AS n FROM events GROUP BY 1)"


# --- collapses ------------------------------------------------------------------------------------------------------


@query("""
SELECT l_returnflag, l_linestatus,
       CASE WHEN count(x) >= 0.7 * count(*) THEN round(sum(x * l_quantity) / sum(CASE WHEN x IS NOT NULL THEN l_quantity END), 4) END AS mean
FROM (SELECT *, CASE WHEN l_linenumber <> 1 THEN l_extendedprice END AS x FROM lineitem) GROUP BY ALL""")
def collapse_weighted_mean_mtol(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = c.collapse(_masked_items(spark, sf_dir), ["l_returnflag", "l_linestatus"], "x", {"mean": "mean"}, weights="l_quantity", mtol=0.3)
    return _rounded(got, 4, "mean")


@query("""
SELECT l_returnflag, l_linestatus, max(x) AS maximum, min(x) AS minimum, max(abs(x)) AS maximum_absolute_value, min(abs(x)) AS minimum_absolute_value,
       round((max(x) + min(x)) / 2, 4) AS mid_range, round(max(x) - min(x), 4) AS range, round(avg(x), 4) AS mean, round(avg(abs(x)), 4) AS mean_absolute_value,
       round(sum(x), 1) AS sum, round(sum(x * x) / 1e6, 2) AS sum_of_squares, count(x) AS sample_size, count(x)::DOUBLE AS sum_of_weights, count(x)::DOUBLE AS sum_of_weights2,
       round(sqrt(avg(x * x)), 4) AS root_mean_square, round(median(x), 4) AS median, count(*) - count(x) AS count_masked
FROM (SELECT *, CASE WHEN l_linenumber <> 1 THEN l_extendedprice END AS x FROM lineitem) GROUP BY ALL""")
def collapse_stats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = ["maximum", "minimum", "maximum_absolute_value", "minimum_absolute_value", "mid_range", "range", "mean", "mean_absolute_value", "sum", "sum_of_squares", "sample_size", "sum_of_weights", "sum_of_weights2", "root_mean_square", "median", "count_masked"]
    got = c.collapse(_masked_items(spark, sf_dir), ["l_returnflag", "l_linestatus"], "x", methods).withColumn("sum_of_squares", F.col("sum_of_squares") / 1e6)
    return _rounded(_rounded(_rounded(got, 4, "mid_range", "range", "mean", "mean_absolute_value", "root_mean_square", "median", "sum_of_weights", "sum_of_weights2"), 1, "sum"), 2, "sum_of_squares")


@query("""
SELECT l_returnflag, round(sum(w * x) / sum(w), 4) AS mean, round(sum(w * x), 1) AS integral, round(sum(w * x * x) / 1e6, 1) AS sum_of_squares, sum(w) AS sum_of_weights,
       sum(w * w) AS sum_of_weights2, round(sqrt(sum(w * x * x) / sum(w)), 4) AS root_mean_square
FROM (SELECT l_returnflag, l_extendedprice AS x, l_quantity AS w FROM lineitem) GROUP BY ALL""")
def collapse_weighted_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = c.collapse(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", ["mean", "integral", "sum_of_squares", "sum_of_weights", "sum_of_weights2", "root_mean_square"], weights="l_quantity")
    got = got.withColumn("sum_of_squares", F.col("sum_of_squares") / 1e6)
    return _rounded(_rounded(got, 4, "mean", "root_mean_square"), 1, "integral", "sum_of_squares")


@query("""
SELECT l_linestatus, round((s2 - s1 * s1 / v1) / v1, 0) AS var0, round((s2 - s1 * s1 / v1) * v1 / (v1 * v1 - v2), 0) AS var1, round(sqrt((s2 - s1 * s1 / v1) / v1), 2) AS sd0
FROM (SELECT l_linestatus, sum(l_quantity) AS v1, sum(l_quantity * l_quantity) AS v2, sum(l_quantity * l_extendedprice) AS s1, sum(l_quantity * l_extendedprice * l_extendedprice) AS s2
      FROM lineitem GROUP BY 1)""")
def collapse_var_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem")
    x, w = F.col("l_extendedprice"), F.col("l_quantity")
    got = items.groupBy("l_linestatus").agg(c.statistic("variance", x, w, 0).alias("var0"), c.statistic("variance", x, w, 1).alias("var1"), c.statistic("sd", x, w, 0).alias("sd0"))
    return _rounded(_rounded(got, 0, "var0", "var1"), 2, "sd0")


@query("""
SELECT o_orderpriority, round(var_pop(o_totalprice) / 1e6, 3) AS var0, round(var_samp(o_totalprice) / 1e6, 3) AS var1, round(stddev_samp(o_totalprice), 2) AS sd1 FROM orders GROUP BY 1""")
def collapse_var_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice")
    got = _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg((c.statistic("var", x, None, 0) / 1e6).alias("var0"), (c.statistic("var", x, None, 1) / 1e6).alias("var1"), c.statistic("std", x, None, 1).alias("sd1"))
    return _rounded(_rounded(got, 3, "var0", "var1"), 2, "sd1")


@query("""
SELECT o_orderpriority, rank, round(CASE rank WHEN 5 THEN quantile_cont(o_totalprice, 0.05) WHEN 50 THEN quantile_cont(o_totalprice, 0.5) ELSE quantile_cont(o_totalprice, 0.95) END, 4) AS o_totalprice
FROM orders, (VALUES (5.0::DOUBLE), (50.0::DOUBLE), (95.0::DOUBLE)) r(rank) GROUP BY o_orderpriority, rank""")
def percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(c.percentile(_t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", [5, 50, 95]), 4, "o_totalprice")


@query("""
WITH s AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, 30.0::DOUBLE AS rank, v[floor(0.3 * (n - 1))::BIGINT + 1] AS lower, v[ceil(0.3 * (n - 1))::BIGINT + 1] AS higher,
       round((v[floor(0.3 * (n - 1))::BIGINT + 1] + v[ceil(0.3 * (n - 1))::BIGINT + 1]) / 2, 4) AS midpoint FROM s""")
def percentile_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, out = _t(spark, sf_dir, "orders"), None
    for m in ("lower", "higher", "midpoint"):
        part = c.percentile(orders, ["o_orderpriority"], "o_totalprice", [30], m).withColumnRenamed("o_totalprice", m)
        out = part if out is None else out.join(part, ["o_orderpriority", "rank"])
    return _rounded(out, 4, "midpoint")


@query("""
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS top FROM (SELECT *, quantile_cont(o_totalprice, 0.9) OVER (PARTITION BY o_orderpriority) AS p FROM orders) WHERE o_totalprice >= p GROUP BY 1""")
def mean_of_upper_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(c.collapse(_t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"top": "mean_of_upper_decile"}), 4, "top")


@query("SELECT p_size, count(*) AS count FROM (SELECT CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS p_size FROM part) GROUP BY 1")
def unique_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.unique(_t(spark, sf_dir, "part").withColumn("p_size", F.when(F.col("p_size") % 7 != 0, F.col("p_size"))), "p_size", counts=True)


@query("""
SELECT c_nationkey, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS largest, arg_min(c_custkey, (c_acctbal, c_custkey)) AS smallest FROM customer GROUP BY 1""")
def argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "customer")
    a = c.arg_extreme(t, ["c_nationkey"], "c_acctbal", ["c_custkey"]).withColumnRenamed("c_custkey", "largest")
    return a.join(c.arg_extreme(t, ["c_nationkey"], "c_acctbal", ["c_custkey"], largest=False).withColumnRenamed("c_custkey", "smallest"), "c_nationkey")


@query("SELECT bool_or(c_acctbal < 0) AS any_negative, bool_and(c_acctbal > -1e9) AS all_above FROM customer")
def any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "customer")
    return t.agg(c.statistic("any", F.col("c_acctbal") < 0).alias("any_negative"), c.statistic("all", F.col("c_acctbal") > -1e9).alias("all_above"))


# --- bins -----------------------------------------------------------------------------------------------------------

_EDGES = [0.0, 10.0, 25.0, 50.0, 100.0]


@query("""
SELECT event_id, CASE WHEN value >= 0 AND value < 10 THEN 0 WHEN value >= 10 AND value < 25 THEN 1 WHEN value >= 25 AND value < 50 THEN 2 WHEN value >= 50 AND value < 100 THEN 3 END::INT AS bin,
       CASE WHEN value <= 0 THEN 0 WHEN value <= 10 THEN 1 WHEN value <= 25 THEN 2 WHEN value <= 50 THEN 3 WHEN value <= 100 THEN 4 ELSE 5 END::INT AS upper_open FROM events""")
def digitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value")
    return _t(spark, sf_dir, "events").select("event_id", binning.digitize(x, _EDGES).alias("bin"), binning.digitize(x, _EDGES, upper=True, open_ends=True).alias("upper_open"))


_QTY, _DISC = [1.0, 10.0, 20.0, 35.0, 50.0], [0.0, 0.025, 0.055, 0.1]
_BINS2 = """
b AS (SELECT least(len(list_filter([1.0, 10.0, 20.0, 35.0, 50.0], lambda e: e <= l_quantity)), 4) - 1 AS l_quantity,
             least(len(list_filter([0.0, 0.025, 0.055, 0.1], lambda e: e <= l_discount)), 3) - 1 AS l_discount, l_extendedprice AS x
      FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_discount BETWEEN 0 AND 0.1),
g AS (SELECT a.range::INT AS l_quantity, d.range::INT AS l_discount FROM range(4) a, range(3) d)"""


@query("WITH " + _BINS2 + " SELECT l_quantity, l_discount, count(x) AS count FROM g LEFT JOIN b USING (l_quantity, l_discount) GROUP BY ALL")
def histogram_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.histogram(_t(spark, sf_dir, "lineitem"), {"l_quantity": _QTY, "l_discount": _DISC})


@query("WITH " + _BINS2 + """, h AS (SELECT l_quantity, l_discount, count(x) AS k FROM g LEFT JOIN b USING (l_quantity, l_discount) GROUP BY ALL)
SELECT l_quantity, l_discount, round(k / (sum(k) OVER () * [9.0, 10.0, 15.0, 15.0][l_quantity + 1] * [0.025, 0.03, 0.045][l_discount + 1]), 6) AS density FROM h""")
def histogram_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(binning.histogram(_t(spark, sf_dir, "lineitem"), {"l_quantity": _QTY, "l_discount": _DISC}, density=True), 6, "density")


@query("WITH " + _BINS2 + " SELECT l_quantity, l_discount, round(avg(x), 4) AS l_extendedprice FROM g LEFT JOIN b USING (l_quantity, l_discount) GROUP BY ALL")
def bin_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(binning.bin_collapse(_t(spark, sf_dir, "lineitem"), {"l_quantity": _QTY, "l_discount": _DISC}, "l_extendedprice", "mean"), 4, "l_extendedprice")


# --- conditions, subspaces, masks -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000")
def subspace_wi_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").where(q.wi(100000, 200000, open_lower=True)(F.col("o_totalprice"))).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice < 50000 OR o_totalprice > 300000) AND NOT regexp_matches(o_orderpriority, 'LOW') OR o_orderstatus IN ('P')")
def subspace_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "orders")
    hit = (q.wo(50000, 300000)(F.col("o_totalprice")) & q.ne(re.compile("LOW"))(F.col("o_orderpriority"))) | q.set_(["P"])(F.col("o_orderstatus"))
    return t.where(hit).select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE abs(s_acctbal - 1000) <= 500 + 0.001 * 1000")
def query_isclose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "supplier").where(q.isclose(1000.0, rtol=0.001, atol=500.0)(F.col("s_acctbal"))).select("s_suppkey")


@query("SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 0 WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 1 WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 2 ELSE 3 END::INT AS season FROM orders WHERE year(o_orderdate) >= 1996 AND day(o_orderdate) <= 15")
def subspace_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "orders")
    parts = {"coord": F.col("o_orderdate"), **calendars.timestamp_parts(F.col("o_orderdate"))}
    keep = (q.year(q.ge(1996)) & q.day(q.le(15))).column(parts)
    return t.where(keep).select("o_orderkey", grouping.season_of(q.seasons(4, 12), parts).alias("season"))


@query("SELECT event_id FROM events WHERE hour(ts) >= 22 OR hour(ts) <= 3")
def subspace_cyclic_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("ts")
    return _t(spark, sf_dir, "events").where(subspace.cyclic_within(hour, q.wi(22, 3), ONE, 24.0)).select("event_id")


@query("""
WITH cells AS (SELECT p_partkey, p_retailprice AS lo, p_retailprice + p_size AS hi FROM part)
SELECT p_partkey, lo <= 950 AND hi >= 950 AS holds, hi - lo >= 25 AS large, lo >= 910 AND hi <= 1000 AS within, lo < 940 AND hi > 945 AS spans, lo > 930 AS above, hi <= 930 AS below FROM cells""")
def cell_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"lower": F.col("p_retailprice"), "upper": F.col("p_retailprice") + F.col("p_size"), "coord": F.col("p_retailprice")}
    asked = {"holds": q.contains(950), "large": q.cellsize(q.ge(25)), "within": q.cellwi(910, 1000), "spans": q.cellwo(940, 945), "above": q.cellgt(930), "below": q.cellle(930)}
    return _t(spark, sf_dir, "part").select("p_partkey", *[x.column(cols).alias(n) for n, x in asked.items()])


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 10 AND 20 THEN l_extendedprice END AS full_mode, CASE WHEN l_quantity > 25 THEN -1.0 ELSE l_discount END AS replaced,
       greatest(least(l_quantity, 40), 5) AS clipped, (l_tax = 0.02)::BOOLEAN AS equal FROM lineitem""")
def where_mask_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity")
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", elementwise.masked_where(F.col("l_extendedprice"), ~q.wi(10, 20)(n)).alias("full_mode"),
        elementwise.where(F.col("l_discount"), n > 25, -1.0).alias("replaced"), elementwise.clip(n, 5.0, 40.0).alias("clipped"), (F.col("l_tax") == 0.02).alias("equal"),
    )


def _nation_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("coord"))


_ENVELOPE = """
SELECT c_custkey, c_nationkey, CASE WHEN n_regionkey = 2 THEN c_acctbal END AS c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE c_nationkey BETWEEN (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2) AND (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 2)"""


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def subspace_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = subspace.select_positions(_nation_axis(spark, sf_dir), "c_nationkey", q.eq(2))
    return subspace.subspace(_t(spark, sf_dir, "customer"), {"c_nationkey": axis}, "c_acctbal").select("c_custkey", "c_nationkey", "c_acctbal")


@query(_ENVELOPE)
def subspace_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = subspace.select_positions(_nation_axis(spark, sf_dir), "c_nationkey", q.eq(2))
    return subspace.subspace(_t(spark, sf_dir, "customer"), {"c_nationkey": axis}, "c_acctbal", mode="envelope").select("c_custkey", "c_nationkey", "c_acctbal")


@query("SELECT c_custkey, n_regionkey <> 2 AS mask FROM customer JOIN nation ON n_nationkey = c_nationkey")
def domain_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = subspace.select_positions(_nation_axis(spark, sf_dir), "c_nationkey", q.eq(2))
    return subspace.domain_mask(_t(spark, sf_dir, "customer"), {"c_nationkey": axis}).select("c_custkey", "mask")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey + d FROM nation, (VALUES (-1), (0), (1)) v(d) WHERE n_nationkey = 10)")
def subspace_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = _nation_axis(spark, sf_dir).where("c_nationkey = 10")
    return subspace.subspace(_t(spark, sf_dir, "customer"), {"c_nationkey": axis}, "c_acctbal", halo=1, sizes={"c_nationkey": 25}).select("c_custkey")


@query("WITH " + _DAILY + " SELECT (2 - i // 7)::INT AS i, x FROM daily WHERE i % 7 = 3 AND i < 21")
def take_slice_and_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reshape.take(_daily(spark, sf_dir).select("i", "x"), "i", slice(3, 21, 7), 30)
    return windows.flip(rows, "i", 3)


# --- groups and climatologies ---------------------------------------------------------------------------------------


@query("WITH " + _DAILY + " SELECT (i // 7)::INT AS \"group\", max(x) AS x FROM daily GROUP BY 1")
def group_n_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.grouped_collapse(_daily(spark, sf_dir), grouping.by_number(F.col("i"), 7), [], "x", "maximum")


@query("SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS \"group\", round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1")
def group_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grouping.grouped_collapse(_t(spark, sf_dir, "orders"), grouping.by_period(F.col("o_orderdate"), calendars.M()), [], "o_totalprice", "mean"), 4, "o_totalprice")


@query("SELECT year(o_orderdate - INTERVAL 11 MONTH) AS \"group\", round(sum(o_totalprice), 1) AS o_totalprice FROM orders GROUP BY 1")
def group_anchored_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years that begin in December."""
    return _rounded(grouping.grouped_collapse(_t(spark, sf_dir, "orders"), grouping.by_period(F.col("o_orderdate"), calendars.Y(1, month=12)), [], "o_totalprice", "sum"), 1, "o_totalprice")


@query("SELECT floor(o_totalprice / 50000)::BIGINT AS \"group\", count(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def group_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.grouped_collapse(_t(spark, sf_dir, "orders"), grouping.by_width(F.col("o_totalprice"), 50000.0), [], "o_totalprice", "sample_size")


_MONTHS = "m AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate) - 1) AS k, month(o_orderdate) AS mo, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY ALL)"


@query("WITH " + _MONTHS + """, f AS (SELECT *, (mo IN (12, 1, 2)) AS w FROM m), g AS (SELECT *, sum(CASE WHEN w IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (ORDER BY k) AS r
FROM (SELECT *, lag(w) OVER (ORDER BY k) AS p FROM f)), h AS (SELECT r, count(*) AS n, round(avg(x), 4) AS x, min(k) AS first FROM g WHERE w GROUP BY r) SELECT first, n, x FROM h WHERE n = 3""")
def group_djf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole winters only."""
    t = F.col("o_orderdate")
    months = _t(spark, sf_dir, "orders").groupBy((F.year(t) * 12 + F.month(t) - 1).alias("k"), F.month(t).alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))
    runs = grouping.runs(months, "k", [q.djf().column({"month": F.col("month")})])
    whole = runs.join(grouping.complete_groups(runs, "k", size=3), "group")
    return _rounded(whole.groupBy("group").agg(F.min("k").alias("first"), F.count("*").alias("n"), c.statistic("mean", F.col("x")).alias("x")).drop("group"), 4, "x")


@query("""
WITH f AS (SELECT year(o_orderdate) AS y, quarter(o_orderdate) - 1 AS s, max(o_totalprice) AS x FROM orders GROUP BY ALL) SELECT s::INT AS within, round(avg(x), 4) AS o_totalprice FROM f GROUP BY 1""")
def climatology_seasons_over_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderdate")
    parts = {"coord": t, **calendars.timestamp_parts(t)}
    return _rounded(grouping.climatology(_t(spark, sf_dir, "orders"), t, [], "o_totalprice", grouping.season_of(q.seasons(4, 1), parts), "maximum", None, "mean"), 4, "o_totalprice")


@query("""
WITH f AS (SELECT event_type, CAST(ts AS DATE) AS d, hour(ts) AS h, avg(value) AS x FROM events GROUP BY ALL) SELECT event_type, h::INT AS within, round(min(x), 4) AS value FROM f GROUP BY ALL""")
def climatology_hours_over_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = grouping.climatology(_t(spark, sf_dir, "events"), F.col("ts"), ["event_type"], "value", F.hour("ts"), "mean", None, "minimum", year=F.to_date("ts"))
    return _rounded(got, 4, "value")


# --- windows along an axis ------------------------------------------------------------------------------------------


@query("WITH " + _DAILY + " SELECT i, round(sum(x) OVER (ORDER BY i), 3) AS x FROM daily")
def cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.cumsum(_daily(spark, sf_dir).select("i", "x"), [], "i", "x"), 3, "x")


@query("WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS x FROM events) SELECT user_id, event_id, round(CASE WHEN x IS NOT NULL THEN sum(x) OVER (PARTITION BY user_id ORDER BY event_id) END, 3) AS x FROM e")
def cumsum_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("x"))
    return _rounded(windows.cumsum(e, ["user_id"], "event_id", "x"), 3, "x")


@query("WITH " + _DAILY + " SELECT i, round(x2 - 2 * x1 + x, 3) AS x FROM (SELECT i, x, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM daily WINDOW w AS (ORDER BY i)) WHERE x2 IS NOT NULL")
def diff_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.diff(_daily(spark, sf_dir).select("i", "x"), [], "i", "x", 2), 3, "x")


@query("WITH " + _DAILY + """, k AS (SELECT *, count(*) OVER () AS m FROM daily) SELECT a.i, round(0.1 * l.x + 0.6 * a.x + 0.3 * r.x, 3) AS x
FROM k a JOIN k r ON r.i = (a.i - 1 + a.m) % a.m JOIN k l ON l.i = (a.i + 1) % a.m""")
def convolution_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.convolution_filter(_daily(spark, sf_dir).select("i", "x"), [], "i", "x", [0.1, 0.6, 0.3], mode="wrap"), 3, "x")


@query("WITH " + _DAILY + " SELECT i, CASE WHEN i > 0 AND i < (SELECT max(i) FROM daily) THEN round((lag(x) OVER (ORDER BY i) + x + lead(x) OVER (ORDER BY i)) / 3, 3) END AS x FROM daily")
def convolution_missing_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.convolution_filter(_daily(spark, sf_dir).select("i", "x"), [], "i", "x", [1 / 3] * 3, mode="constant"), 3, "x")


@query("WITH " + _DAILY + " SELECT i, round(sum(x * n) OVER w / sum(n) OVER w, 4) AS x FROM daily WINDOW w AS (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def moving_window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.moving_window(_daily(spark, sf_dir), [], "i", "x", "mean", 5, weights="n").select("i", "x"), 4, "x")


@query("WITH " + _DAILY + " SELECT i, round(CASE WHEN i = 0 THEN lead(x) OVER w - x WHEN lead(x) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END, 4) AS x FROM daily WINDOW w AS (ORDER BY i)")
def derivative_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _daily(spark, sf_dir).select("i", "x").withColumn("coord", F.col("i").cast("double"))
    return _rounded(windows.derivative(rows, [], "i", "x", "coord", one_sided_at_boundary=True).drop("coord"), 4, "x")


@query("SELECT ((n_nationkey + 7) % 25)::INT AS i, n_name FROM nation")
def roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.roll(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), "n_name"), "i", 7, 25)


@query("SELECT i::INT AS i, n_name, own FROM (SELECT n_nationkey AS i, n_name, true AS own FROM nation UNION ALL SELECT n_nationkey - 25, n_name, false FROM nation WHERE n_nationkey >= 23 UNION ALL SELECT n_nationkey + 25, n_name, false FROM nation WHERE n_nationkey < 2)")
def halo_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), "n_name")
    return windows.halo(rows, [], "i", 2, cyclic=True, size=25).withColumnRenamed("__own", "own")


# --- shapes ---------------------------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS position, p_size FROM part WHERE p_size % 3 <> 0")
def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("p_size"))
    return reshape.compressed(rows, {"i": 1}, "p_size")


@query("SELECT i::INT AS i, n_name FROM (SELECT n_nationkey + 2 AS i, n_name FROM nation UNION ALL SELECT range, NULL FROM range(2) UNION ALL SELECT range + 27, NULL FROM range(3))")
def pad_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), "n_name")
    return reshape.pad_missing(rows, "i", 25, {}, "n_name", before=2, after=3)


# --- combining ------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS a, r_regionkey AS b, (n_nationkey * r_regionkey)::BIGINT AS value FROM nation, region")
def outerproduct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_nationkey").cast("long").alias("value"))
    b = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("b"), F.col("r_regionkey").cast("long").alias("value"))
    return combine.outerproduct(a, b)


@query("""
SELECT c_custkey, c_nationkey, round(c_acctbal * 1000 - m, 3) AS value FROM customer JOIN (SELECT s_nationkey AS c_nationkey, max(s_acctbal) AS m FROM supplier GROUP BY 1) USING (c_nationkey)""")
def binary_broadcast_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilometres less metres, over the axis that both have, in metres."""
    left = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") * 1000).alias("value"))
    right = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg((F.max("s_acctbal") / 1000).alias("value"))
    got, units = combine.binary_operation(left, right, ["c_nationkey"], "sub", units=Units.of("m"), right_units=Units.of("km"))
    assert units == Units.of("m")
    return _rounded(got.select("c_custkey", "c_nationkey", "value"), 3, "value")


@query("WITH " + _MONTHS + " SELECT row_number() OVER (ORDER BY k) - 1 AS i, x FROM m")
def aggregate_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sums of the first half and of the rest of the years, joined again along time."""
    t = F.col("o_orderdate")
    months = _t(spark, sf_dir, "orders").groupBy((F.year(t) * 12 + F.month(t) - 1).alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))
    fields = []
    for part in (F.col("k") >= 1998 * 12, F.col("k") < 1998 * 12):
        rows = reshape.numbered(months.where(part).withColumn("k", F.col("k").cast("long")), "k", "i_t").withColumn("i_t", F.col("i_t").cast("int"))
        fields.append({"name": "total", "units": "1", "df": rows.select("i_t", "x"), "value": "x", "axes": {"t": rows.select(F.col("i_t").alias("i"), F.col("k").alias("coord"))}})
    (joined,) = combine.aggregate(fields)
    return joined["df"].select(F.col("i_t").cast("long").alias("i"), "x")


# --- weights --------------------------------------------------------------------------------------------------------


@query("""
WITH n AS (SELECT 180.0::DOUBLE / (max(p_partkey) + 1) AS h FROM part)
SELECT p_partkey::INT AS i, round(radians(p_size) * abs(sin(radians(-90 + (p_partkey + 1) * h)) - sin(radians(-90 + p_partkey * h))), 10) AS w, round(6371.229 * radians(p_size) * 6371.229 * abs(sin(radians(-90 + (p_partkey + 1) * h)) - sin(radians(-90 + p_partkey * h))), 3) AS km2 FROM part, n""")
def weights_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells of p_size degrees of longitude, one above the other from pole to pole."""
    t = _t(spark, sf_dir, "part")
    n = _size(t, "p_partkey")
    lat = weights.regular_axis(spark, -90.0, 90.0, 180.0 / n)
    cells = t.select(F.col("p_partkey").cast("int").alias("i"), F.col("p_size").cast("double").alias("width")).join(lat, "i")
    args = (F.lit(0.0), F.col("width"), F.col("lower"), F.col("upper"))
    return cells.select("i", F.round(weights.area(*args), 10).alias("w"), F.round(weights.area(*args, measure=True) / 1e6, 3).alias("km2"))


@query("SELECT p_partkey, round(p_size * p_retailprice / 2, 4) AS area FROM part")
def weights_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right triangles."""
    a, b, zero = F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(0.0)
    return _rounded(_t(spark, sf_dir, "part").select("p_partkey", weights.plane_polygon_area(F.array(zero, a, zero), F.array(zero, zero, b)).alias("area")), 4, "area")


# --- regridding -----------------------------------------------------------------------------------------------------


def _hourly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """events by hour of the month (i, x; missing without events) and the axis."""
    rows = _t(spark, sf_dir, "events").groupBy(F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 3600).cast("int").alias("i")).agg(F.round(F.sum("value"), 4).alias("x"))
    axis = weights.regular_axis(spark, 0.0, 720.0, 1.0)
    return axis.select("i").join(rows, "i", "left"), axis


_HOURLY = "h AS (SELECT date_diff('hour', TIMESTAMP '2024-01-01', ts)::INT AS i, round(sum(value), 4) AS x FROM events GROUP BY 1)"


def _hours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """events by hour, the hours up to the last that has one, and their number."""
    rows, _ = _hourly(spark, sf_dir)
    n = _size(rows.where("x IS NOT NULL"), "i")
    return rows.where(F.col("i") < n), weights.regular_axis(spark, 0.0, float(n), 1.0), n


@query("WITH " + _HOURLY + """, n AS (SELECT max(i) + 1 AS n FROM h), d AS (SELECT j::INT AS i, j * 2.5 AS lo, (j + 1) * 2.5 AS hi FROM n, range((SELECT ceil(n / 2.5)::BIGINT FROM n)) t(j)),
m AS (SELECT d.i, h.x, (least(h.i + 1, hi) - greatest(h.i, lo)) AS w FROM d LEFT JOIN h ON h.i < hi AND h.i + 1 > lo)
SELECT i, round(sum(x * w) / sum(w), 3) AS x FROM m GROUP BY 1""")
def regrid_conservative_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, axis, n = _hours(spark, sf_dir)
    got = rg.regrid(rows, [], "x", "conservative", {"i": (axis, weights.regular_axis(spark, 0.0, math.ceil(n / 2.5) * 2.5, 2.5))})
    return _rounded(got, 3, "x")


def _days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events by day, the days' axis, and places 0.75 days apart from 0.2 on, up to the last day."""
    src = _daily(spark, sf_dir).select("i", "x")
    n = _size(src, "i")
    dst = spark.range(math.floor((n - 1 - 0.2) / 0.75) + 1).select(F.col("id").cast("int").alias("i"), (F.col("id") * 0.75 + 0.2).alias("coord"))
    return src, spark.range(n).select(F.col("id").cast("int").alias("i"), F.col("id").cast("double").alias("coord")), dst


_PLACES = ", d AS (SELECT j::INT AS i, j * 0.75 + 0.2 AS c FROM range((SELECT floor((max(i) - 0.2) / 0.75)::BIGINT + 1 FROM daily)) t(j))"


@query("WITH " + _DAILY + _PLACES + """
SELECT d.i, round(a.x * (1 - (c - floor(c))) + b.x * (c - floor(c)), 6) AS x FROM d LEFT JOIN daily a ON a.i = floor(c) LEFT JOIN daily b ON b.i = floor(c) + 1""")
def regrid_linear_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, axis, dst = _days(spark, sf_dir)
    return _rounded(rg.regrid(src, [], "x", "linear", {"i": (axis, dst)}), 6, "x")


@query("WITH " + _DAILY + _PLACES + " SELECT d.i, x FROM d JOIN daily ON daily.i = round(c)")
def regrid_nearest_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, axis, dst = _days(spark, sf_dir)
    return rg.regrid(src, [], "x", "nearest_stod", {"i": (axis, dst)})


# --- HEALPix --------------------------------------------------------------------------------------------------------


_CELLS = """s AS (SELECT min(k)::INT AS level, min(12 * (1::BIGINT << (2 * k)))::BIGINT AS cells FROM range(2, 29) t(k) WHERE 12 * (1::BIGINT << (2 * k)) > (SELECT max(c_custkey) FROM customer))"""


@query("WITH " + _CELLS + " SELECT i // 16 AS healpix_index, max(c_acctbal) AS v FROM (SELECT unnest(range(cells)) AS i FROM s) LEFT JOIN customer ON c_custkey = i GROUP BY 1")
def healpix_decrease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nested index: the greatest balance in each cell two levels up."""
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("healpix_index"), F.col("c_acctbal").alias("v"))
    level = _level(_size(rows, "healpix_index"))
    cells = healpix.cells(spark, level).select("healpix_index").join(rows, "healpix_index", "left")
    return healpix.decrease_level(cells, "healpix_index", level, level - 2, [], "v", "maximum")


@query("SELECT c_custkey * 16 + k AS healpix_index, c_acctbal AS v FROM customer, range(16) t(k)")
def healpix_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nested index, two levels down; balances don't depend on the area."""
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("healpix_index"), F.col("c_acctbal").alias("v"))
    level = _level(_size(rows, "healpix_index"))
    return healpix.increase_level(rows, "healpix_index", level, level + 2, "v", "intensive")


@query("WITH " + _CELLS.replace("c_custkey", "p_partkey").replace("customer", "part") + " SELECT p_partkey, p_partkey + 4::BIGINT * (1::BIGINT << (2 * level)) AS nuniq, (2 * p_partkey + 1) * (1::BIGINT << (58 - 2 * level)) AS zuniq, p_partkey AS ring FROM part, s")
def healpix_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by nested index on the level that covers their keys, in the other schemes, and through ring indices and back."""
    p, t = F.col("p_partkey"), _dealt(_t(spark, sf_dir, "part").select("p_partkey"))
    level = _level(_size(t, "p_partkey"))
    back = healpix.change_scheme(healpix.change_scheme(p, "nested", "ring", level), "ring", "nested", level)
    return t.select("p_partkey", healpix.change_scheme(p, "nested", "nuniq", level).alias("nuniq"), healpix.change_scheme(p, "nested", "zuniq", level).alias("zuniq"), back.alias("ring"))


# --- scalar functions -----------------------------------------------------------------------------------------------


@query("""
SELECT s_suppkey, round(s_acctbal / 1000, 6) AS km, round(s_acctbal * 9 / 5 + 32, 4) AS fahrenheit, round(sin(radians(s_acctbal)), 8) AS sine, floor(s_acctbal / 7)::BIGINT AS quotient,
       round(s_acctbal - 7 * floor(s_acctbal / 7), 6) AS remainder, trunc(s_acctbal)::BIGINT AS truncated, round_even(s_acctbal / 8, 0) AS rounded FROM supplier""")
def units_and_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, metres = F.col("s_acctbal"), Units.of("m")
    sine, _ = elementwise.UNARY["sin"](x, Units.of("degrees"))
    seven = F.lit(7.0)
    return _t(spark, sf_dir, "supplier").select(
        "s_suppkey", F.round(metres.convert(x, Units.of("km")), 6).alias("km"), F.round(Units.of("Celsius").convert(x, Units.of("Fahrenheit")), 4).alias("fahrenheit"), F.round(sine, 8).alias("sine"),
        elementwise.floordiv(x, seven).alias("quotient"), F.round(elementwise.mod(x, seven), 6).alias("remainder"), elementwise.trunc(x).alias("truncated"), elementwise.round_even(x / 8).alias("rounded"),
    )


@query("""
SELECT o_orderkey, d // 360 + 1990 AS year, (d % 360) // 30 + 1 AS month, d % 30 + 1 AS day, o_orderkey % 24 AS hour FROM (SELECT o_orderkey, (o_orderkey % 9000)::BIGINT AS d FROM orders)""")
def calendar_360_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = Units.of("hours since 1990-01-01", "360_day")
    t = _t(spark, sf_dir, "orders").withColumn("h", (F.col("o_orderkey") % 9000) * 24.0 + F.col("o_orderkey") % 24)
    parts = calendars.decode(F.col("h"), units)
    return t.select("o_orderkey", *[parts[k].cast("long").alias(k) for k in ("year", "month", "day", "hour")])


@query("SELECT o_orderkey, year(o_orderdate)::BIGINT AS year, month(o_orderdate)::BIGINT AS month, day(o_orderdate)::BIGINT AS day, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
def calendar_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "orders")
    days = calendars.days_from_date(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"), "standard")
    parts = calendars.decode(days.cast("double"), Units.of("days since 1970-01-01"))
    return t.select("o_orderkey", *[parts[k].cast("long").alias(k) for k in ("year", "month", "day")], days.cast("long").alias("days"))


@query("""
SELECT s_suppkey, round(1000 + 0.3 * (s_acctbal - 1000), 6) AS sigma, round(100000 * exp(-s_acctbal / 10000), 4) AS ln_pressure, round(50 + 0.7 * s_acctbal, 6) AS hybrid_height FROM supplier""")
def vertical_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = F.col("s_acctbal")
    made = {
        "sigma": vertical.compute("atmosphere_sigma_coordinate", {"ptop": F.lit(1000.0), "sigma": F.lit(0.3), "ps": ps})[1],
        "ln_pressure": vertical.compute("atmosphere_ln_pressure_coordinate", {"p0": F.lit(100000.0), "lev": ps / 10000})[1],
        "hybrid_height": vertical.compute("atmosphere_hybrid_height_coordinate", {"a": F.lit(50.0), "b": F.lit(0.7), "orog": ps})[1],
    }
    return _rounded(_rounded(_t(spark, sf_dir, "supplier").select("s_suppkey", *[v.alias(k) for k, v in made.items()]), 6, "sigma", "hybrid_height"), 4, "ln_pressure")


@query("SELECT p_partkey, p_size & 1 <> 0 AS odd, (p_size & 6) = 4 AS four FROM part")
def flag_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flags.Flags(("odd", "four"), values=(1, 4), masks=(1, 6))
    return _t(spark, sf_dir, "part").select("p_partkey", f.is_set(F.col("p_size"), "odd").alias("odd"), f.is_set(F.col("p_size"), "four").alias("four"))


# --- streams --------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(streaming.run_to_table(streaming.tumbling(streaming.read_events(spark, sf_dir), "1 day", ["event_type"]), "stream_tumbling").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), 3, "total")


# --- compressed arrays ----------------------------------------------------------------------------------------------


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i_element, o_totalprice FROM orders")
def ragged_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders laid end to end by customer, with a count for each customer, and taken apart again."""
    orders = _t(spark, sf_dir, "orders")
    flat = orders.withColumn("k", F.col("o_custkey") * (1 << 32) + F.col("o_orderkey"))
    obs = reshape.numbered(flat, "k", "i_obs").select("i_obs", "o_totalprice")
    counts = orders.groupBy("o_custkey").agg(F.count("*").alias("row_size"))
    got = compressed_.ragged_contiguous(obs, counts, "o_custkey")
    return got.select("o_custkey", F.col("i_element").cast("long").alias("i_element"), "o_totalprice")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i_element FROM events")
def ragged_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = compressed_.ragged_indexed(_t(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id")
    return got.withColumn("i_element", F.col("i_element").cast("long"))


# --- more of the same families --------------------------------------------------------------------------------------


@query("WITH " + _DAILY + " SELECT i, round(sum(x * n) OVER w, 3) AS x FROM daily WINDOW w AS (ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def moving_window_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.moving_window(_daily(spark, sf_dir), [], "i", "x", "integral", 3, weights="n").select("i", "x"), 3, "x")


@query("""
SELECT s_suppkey, round(exp(s_acctbal / 10000), 8) AS e, round(ln(abs(s_acctbal) + 1), 8) AS l, round(sqrt(abs(s_acctbal)), 8) AS r, round(atan2(s_acctbal, 1000), 8) AS a, round(sinh(s_acctbal / 10000), 8) AS h,
       round(log10(abs(s_acctbal) + 1), 8) AS d, round(power(s_acctbal / 1000, 3), 6) AS p, ceil(s_acctbal)::BIGINT AS c FROM supplier""")
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, one = F.col("s_acctbal"), Units.of("1")
    apply = lambda n, c: elementwise.UNARY[n](c, one)[0]
    made = {"e": apply("exp", x / 10000), "l": apply("log", F.abs(x) + 1), "r": apply("sqrt", F.abs(x)), "a": elementwise.arctan2(x, F.lit(1000.0)), "h": apply("sinh", x / 10000), "d": apply("log10", F.abs(x) + 1)}
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", *[F.round(v, 8).alias(k) for k, v in made.items()], F.round(elementwise.power(x / 1000, 3)[0], 6).alias("p"), apply("ceil", x).alias("c"))
    return rows


@query("SELECT o_orderkey, date_trunc('month', o_orderdate) AS start, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS stop, o_orderdate + INTERVAL 3 MONTH AS later FROM orders")
def time_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderdate")
    start, stop = calendars.M().bounds(t)
    return _t(spark, sf_dir, "orders").select("o_orderkey", start.alias("start"), stop.alias("stop"), calendars.M(3).add_to(t).alias("later"))


@query("SELECT o_orderkey, round(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))::DOUBLE * 24, 4) AS hours, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))::DOUBLE - 365 AS days FROM orders")
def reference_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = calendars.days_from_date(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"), "standard").cast("double")
    units = Units.of("days since 1970-01-01")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round(units.convert(d, Units.of("hours since 1990-01-01")), 4).alias("hours"), units.convert(d, Units.of("days since 1991-01-01")).alias("days"))


@query("SELECT p_partkey, p_size > 10 AND p_size < 20 AS inside, abs(p_retailprice - 1000) <= 1.0 + 0.05 * 1000 AS near, CASE WHEN p_size NOT IN (5, 7) THEN p_size END AS kept, coalesce(CASE WHEN p_size <> 9 THEN p_size END, -1) AS filled FROM part")
def masks_and_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return _t(spark, sf_dir, "part").select("p_partkey", q.wi(10, 20, open_lower=True, open_upper=True)(n).alias("inside"), elementwise.isclose(F.col("p_retailprice"), 1000.0, 0.05, 1.0).alias("near"), elementwise.apply_masking(n, fill_values=[5, 7]).alias("kept"), elementwise.filled(elementwise.masked_where(n, n == 9), -1).alias("filled"))


@query("""
SELECT p_partkey, round(radians(p_size) * 6371.0, 4) AS km, round(p_size * p_size * 2.5::DOUBLE, 4) AS volume FROM part""")
def weights_length_and_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs along a meridian, and boxes."""
    n, zero = F.col("p_size").cast("double"), F.lit(0.0)
    arc = weights.great_circle_length(F.array(zero, zero), F.array(zero, n), 6371.0)
    box = weights.volume(weights.plane_polygon_area(F.array(zero, n, n, zero), F.array(zero, zero, n, n)), F.lit(1.0), F.lit(3.5))
    return _rounded(_t(spark, sf_dir, "part").select("p_partkey", arc.alias("km"), box.alias("volume")), 4, "km", "volume")


@query("""
WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n, max(value) AS maximum FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = streaming.run_to_table(streaming.sessions(streaming.read_events(spark, sf_dir), "6 hours", ["user_id"]), "stream_sessions")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "maximum")


# --- shapes that follow from the table's size -----------------------------------------------------------------------


@query("SELECT (p_partkey // 50)::INT AS a, (p_partkey % 50 // 10)::INT AS b, (p_partkey % 10)::INT AS c, p_size FROM part")
def reshape_3d_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("i"), "p_size")
    many = -(-_size(rows, "i") // 50)
    return reshape.reshape(rows, {"i": many * 50}, {"a": many, "b": 5, "c": 10})


@query("""
SELECT (i // 20)::INT AS y, (i % 20)::INT AS x, p_size AS value FROM (SELECT unnest(range((max(p_partkey) // 20 + 1) * 20)) AS i FROM part)
LEFT JOIN (SELECT * FROM part WHERE p_size IS NOT NULL) ON p_partkey = i""")
def gathered_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part that has a size is listed; cells without a part are missing."""
    kept = _t(spark, sf_dir, "part").where("p_size IS NOT NULL").select(F.col("p_partkey").alias("flat"), F.col("p_size").alias("value"))
    shape = {"y": -(-_size(_t(spark, sf_dir, "part"), "p_partkey") // 20), "x": 20}
    listing = reshape.numbered(kept, "flat", "i_list")
    return compressed_.gathered(listing.select("i_list", "value"), listing.select("i_list", "flat"), shape)


@query("""
WITH g AS (SELECT (p_partkey // 20)::INT AS y, (p_partkey % 20)::INT AS x, p_retailprice AS v FROM part),
d AS (SELECT *, (lead(v) OVER r - lag(v) OVER r) / 4.0 AS gx, (lead(v) OVER c - lag(v) OVER c) / 6.0 AS gy FROM g WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))
SELECT y, x, round(gx, 6) AS grad_x, round(gy, 6) AS grad_y, round((lead(gx) OVER r - lag(gx) OVER r) / 4.0 + (lead(gy) OVER c - lag(gy) OVER c) / 6.0, 6) + 0.0 AS laplacian
FROM d WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)""")
def gradient_and_laplacian_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a plane with cells of 2 by 3, in rows of 20."""
    p = F.col("p_partkey")
    g = _t(spark, sf_dir, "part").select(F.floor(p / 20).cast("int").alias("y"), (p % 20).cast("int").alias("x"), F.col("p_retailprice").alias("v"))
    g = g.withColumns({"cx": F.col("x") * 2.0, "cy": F.col("y") * 3.0})
    got = windows.grad_xy(g, [], "x", "y", "cx", "cy", "v", spherical=False)
    got = windows.div_xy(got, [], "x", "y", "cx", "cy", "grad_x", "grad_y", spherical=False, out="laplacian")
    return _rounded(got.select("y", "x", "grad_x", "grad_y", "laplacian"), 6, "grad_x", "grad_y", "laplacian").withColumn("laplacian", F.col("laplacian") + 0.0)


@query("WITH " + _DAILY + ", s AS (SELECT max(i) + 1 AS size FROM daily) SELECT (i // 7)::INT AS i, round(avg(x), 4) AS x FROM daily, s WHERE i < size - size % 7 GROUP BY 1")
def coarsen_trim_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of all days; trimming alone drops the days after the last whole one."""
    rows = _daily(spark, sf_dir)
    return _rounded(c.coarsen(rows, {"i": 7}, [], "x", "mean", {"i": _size(rows, "i")}, trim_excess=True), 4, "x")


@query("WITH " + _DAILY + """, t AS (SELECT i, x, lead(i) OVER (ORDER BY i) AS hi, lead(x) OVER (ORDER BY i) AS x1 FROM daily WHERE i % 7 = 0 OR i = (SELECT max(i) FROM daily))
SELECT d.i, round(coalesce(t.x + (t.x1 - t.x) * (d.i - t.i) / (t.hi - t.i)::DOUBLE, t.x), 6) AS x
FROM (SELECT unnest(range(max(i) + 1))::INT AS i FROM daily) d JOIN t ON d.i >= t.i AND d.i < coalesce(t.hi, t.i + 1)""")
def subsampled_linear_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie points at every seventh day and at the last."""
    rows = _daily(spark, sf_dir)
    ties = rows.where((F.col("i") % 7 == 0) | (F.col("i") == _size(rows, "i") - 1)).select("i", "x")
    return _rounded(compressed_.subsampled_linear(ties, "i", [], "x"), 6, "x")


def _level(cells: int) -> int:
    """The first level from 2 on with so many HEALPix cells or more."""
    level = 2
    while 12 * 4**level < cells:
        level += 1
    return level


@query("""
WITH s AS (SELECT min(12 * (1::BIGINT << (2 * k)))::BIGINT AS cells FROM range(2, 29) t(k) WHERE 12 * (1::BIGINT << (2 * k)) > (SELECT max(p_partkey) FROM part))
SELECT i // 16 AS healpix_index, round(avg(p_retailprice), 6) AS v FROM (SELECT unnest(range(cells)) AS i FROM s) LEFT JOIN part ON p_partkey = i GROUP BY 1""")
def healpix_decrease_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by nested index, on the level that covers their keys; cells without a part are missing."""
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("healpix_index"), F.col("p_retailprice").alias("v"))
    level = _level(_size(part, "healpix_index"))
    cells = healpix.cells(spark, level).select("healpix_index").join(part, "healpix_index", "left")
    return _rounded(healpix.decrease_level(cells, "healpix_index", level, level - 2, [], "v", "mean"), 6, "v")


@query("SELECT p_partkey * 4 + k AS healpix_index, p_retailprice / 4 AS v FROM part, range(4) t(k)")
def healpix_increase_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("healpix_index"), F.col("p_retailprice").alias("v"))
    level = _level(_size(part, "healpix_index"))
    return healpix.increase_level(part, "healpix_index", level, level + 1, "v", "extensive")
