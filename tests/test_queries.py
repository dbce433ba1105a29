import math

import duckdb
import pytest

import __spark_entry__
from gridloom.plans import grids, more, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)


@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    found = db.execute(registry.ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(columns)
    want = [[plain(v) for v in row] for row in found.fetchall()]
    rows = [[plain(r[c]) for c in columns] for r in got.collect()]
    assert len(rows) == len(want) > 0
    differ = [p for p in zip(sorted(rows), sorted(want)) if p[0] != p[1]]
    assert not differ, differ[:3]


def test_entry_points(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_conditions_reach_the_scan(spark):
    plan = registry.QUERIES["subspace_wi_open"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100000" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_collapses_combine_before_the_shuffle(spark):
    plan = registry.QUERIES["collapse_weighted_all"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange") and plan.count("Exchange hash") == 1


@pytest.mark.parametrize("name", ["reshape_3d_whole", "gathered_whole", "gradient_and_laplacian_whole"])
def test_shapes_cover_the_whole_table(spark, name):
    larger = SF.replace("0.001", "0.01")
    parts = spark.read.parquet(f"{larger}/part.parquet").count()
    got = registry.QUERIES[name](spark, larger)
    assert parts == 2000 and got.count() == parts
    assert got.select(*[c for c in got.columns if c in "abcxy"]).distinct().count() == parts
    if name == "gathered_whole":
        assert got.where("value IS NULL").count() == 0


def test_daily_queries_reach_the_last_day(spark):
    days = spark.read.parquet(f"{SF}/events.parquet").selectExpr("max(datediff(ts, '2024-01-01')) + 1").first()[0]
    assert days % 7 and days > 29
    assert sorted(r.i for r in registry.QUERIES["subsampled_linear_whole"](spark, SF).collect()) == [*range(days)]
    assert sorted(r.i for r in registry.QUERIES["coarsen_trim_whole"](spark, SF).collect()) == [*range(days // 7)]


def test_healpix_queries_follow_the_table(spark):
    larger = SF.replace("0.001", "0.01")
    assert [registry.QUERIES["healpix_increase_whole"](spark, d).count() for d in (SF, larger)] == [800, 8000]
    got = [registry.QUERIES["healpix_decrease_whole"](spark, d) for d in (SF, larger)]
    assert [g.count() for g in got] == [48, 192] and [g.where("v IS NOT NULL").count() for g in got] == [13, 125]
