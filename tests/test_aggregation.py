import pytest
from pyspark.sql import functions as F

from gridloom.functions.units import Units
from gridloom.operators.aggregation import aggregate_table, climatology_cells

FIELDS = "field long, name string, units string, model string, run double"
AXES = "field long, axis string, i int, coord double, lower double, upper double"


def table(spark, parts):
    """parts: (field, name, units, model, run, times, xs, values by time and x)"""
    fields = [p[:5] for p in parts]
    axes, cells = [], []
    for f, _, _, _, _, ts, xs, values in parts:
        axes += [(f, "t", k, *t) for k, t in enumerate(ts)] + [(f, "x", k, float(x), x - 0.5, x + 0.5) for k, x in enumerate(xs)]
        cells += [(f, a, b, float(values(t[0], x))) for a, t in enumerate(ts) for b, x in enumerate(xs)]
    return spark.createDataFrame(fields, FIELDS), spark.createDataFrame(axes, AXES), spark.createDataFrame(cells, "field long, i_t int, i_x int, value double")


def days(*at, width=1.0):
    return [(float(t), t - width / 2, t + width / 2) for t in at]


def whole(got):
    """field -> {(t, x): value} by coordinates"""
    out = {}
    coords = {(r.field, r.axis, r.i): r.coord for r in got.axes.collect()}
    for r in got.cells.collect():
        out.setdefault(r.field, {})[coords[r.field, "t", r.i_t], coords[r.field, "x", r.i_x]] = r.value
    return out


def test_two_axes_units_and_rules(spark):
    f = lambda t, x: 100 * t + x
    parts = [
        (5, "tas", "m", "A", 1.0, days(3, 4), [0, 1], f), (2, "tas", "km", "A", 1.0, days(1, 2), [0, 1], lambda t, x: f(t, x) / 1000), (3, "tas", "m", "A", 1.0, days(1, 2), [2, 3], f), (4, "tas", "m", "A", 1.0, days(3, 4), [2, 3], f),
        (10, "pr", "m", "A", 1.0, days(1, 2), [0], f), (11, "pr", "m", "A", 1.0, days(2, 3), [0], f),  # coordinates meet
        (20, "tas", "s", "A", 1.0, days(7), [0, 1], f), (21, None, None, "A", 1.0, days(7), [0, 1], f), (22, None, None, "A", 1.0, days(8), [0, 1], f),
        (30, "gap", "m", "A", 1.0, days(1), [0], f), (31, "gap", "m", "A", 1.0, days(3), [0], f), (40, "lap", "m", "A", 1.0, days(1, width=3), [0], f), (41, "lap", "m", "A", 1.0, days(3, width=3), [0], f),
    ]
    made = table(spark, parts)
    got = aggregate_table(*made, order=["t", "x"])
    found = {r.field: (r.name, r.units, r.parts) for r in got.fields.collect()}
    assert found == {2: ("tas", "km", 4), 10: ("pr", "m", 1), 11: ("pr", "m", 1), 20: ("tas", "s", 1), 21: (None, None, 1), 22: (None, None, 1), 30: ("gap", "m", 2), 40: ("lap", "m", 2)}
    cells = whole(got)
    assert cells[2] == pytest.approx({(float(t), float(x)): f(t, x) / 1000 for t in (1, 2, 3, 4) for x in (0, 1, 2, 3)})
    assert {r.field for r in aggregate_table(*made, contiguous=True).fields.collect()} >= {30, 31} and {r.field for r in aggregate_table(*made, overlap=False).fields.collect()} >= {40, 41}
    assert {r.field: r.parts for r in aggregate_table(*made, relaxed_units=True).fields.where("field IN (10, 11, 20, 21, 22)").collect()} == {10: 1, 11: 1, 20: 1, 21: 2}
    assert aggregate_table(*(t.limit(0) for t in made)).fields.count() == 0


def test_properties_that_must_agree_become_an_axis_or_are_kept(spark):
    f = lambda t, x: t + x / 10
    parts = [(k, "tas", "K", m, float(r), days(*ts), [0, 1], f) for k, (m, r, ts) in enumerate([("A", 1, (1, 2)), ("A", 1, (3,)), ("B", 1, (4,)), ("A", 2, (1, 2)), ("A", 2, (3,))])]
    made = table(spark, parts)
    assert {r.field: r.parts for r in aggregate_table(*made, same=["model", "run"]).fields.collect()} == {0: 2, 2: 1, 3: 2}
    got = aggregate_table(*made, same=["model"], dimension=["run"], order=["t", "run"])
    assert {r.field: r.parts for r in got.fields.collect()} == {0: 4, 2: 1}
    assert got.cells.where("field = 0").count() == 12 and [(r.i, r.coord) for r in got.axes.where("field = 0 AND axis = 'run'").orderBy("i").collect()] == [(0, 1.0), (1, 2.0)]
    kept = aggregate_table(*(t.where("field < 3") for t in made), ancillaries=["model"])
    assert [(r.field, r.i, r.text) for r in kept.ancillaries.where("name = 'model' AND axis = 't'").orderBy("i").collect()] == [(0, 0, "A"), (0, 1, "A"), (0, 2, "A"), (0, 3, "B")]


def test_cells_of_different_lengths_stay_apart(spark):
    f = lambda t, x: t
    month = lambda m: [(a + (b - a) / 2, float(a), float(b)) for a, b in [m]]
    parts = [(1, "tas", "K", "A", 1.0, month((0, 31)), [0], f), (2, "tas", "K", "A", 1.0, month((31, 59)), [0], f), (3, "tas", "K", "A", 1.0, month((59, 424)), [0], f), (4, "tas", "K", "A", 1.0, days(500.5), [0], f), (5, "tas", "K", "A", 1.0, days(501.5), [0], f), (6, "tas", "K", "A", 1.0, [(600.0, None, None), (600.25, None, None)], [0], f), (7, "tas", "K", "A", 1.0, [(601.0, None, None), (601.125, None, None)], [0], f)]
    cells = climatology_cells()
    assert [c.label for c in cells][:3] == ["PT1H", "PT0H every PT1H", "PT3H"] and len(climatology_cells(years=False, hours=(12, 3), days=(), hours_instantaneous=False)) == 3
    made = table(spark, parts)
    assert aggregate_table(*made).fields.count() == 1
    got = aggregate_table(*made, conditions={"t": cells}, axis_units={"t": Units.of("days since 2001-01-01")})
    assert {r.field: r.parts for r in got.fields.collect()} == {1: 2, 3: 1, 4: 2, 6: 1, 7: 1}


def test_ten_thousand_fields_in_a_few_jobs(spark):
    n = 10_000
    ids = spark.range(n).select(F.col("id").alias("field"), (F.col("id") % 10).cast("int").alias("g"), F.floor(F.col("id") / 10).alias("k"))
    fields = ids.select("field", F.concat(F.lit("v"), "g").alias("name"), F.lit("K").alias("units"))
    axes = ids.select("field", F.lit("t").alias("axis"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i"), "k").select("field", "axis", "i", (F.col("k") * 2 + F.col("i")).cast("double").alias("coord"))
    cells = axes.select("field", F.col("i").alias("i_t"), F.col("coord").alias("value"))
    tracker, group = spark.sparkContext.statusTracker(), "aggregation"
    spark.sparkContext.setJobGroup(group, group)
    got = aggregate_table(fields, axes, cells)
    rows = got.cells.groupBy("field").agg(F.count("*").alias("n"), F.bool_and(F.col("i_t") == F.col("value")).alias("right")).collect()
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.field, r.n, r.right) for r in rows} == {(g, 2 * n // 10, True) for g in range(10)} and jobs <= 50, jobs
