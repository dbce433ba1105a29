import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import query as q
from gridloom.functions.units import Units
from gridloom.operators import binning, collapse as c, combine, grouping, healpix as hp, regrid as rg, reshape, subspace, vertical, weights, windows
from gridloom.operators.catalog import CubeList, unique
from gridloom.operators.cube import Axis, Cube

SHAPE = {"a": 3, "b": 4, "d": 5}


@pytest.fixture(scope="module")
def cells(spark):
    x = np.arange(60.0).reshape(3, 4, 5) - 20
    w = 1 + np.arange(60.0).reshape(3, 4, 5) / 7
    m = np.zeros(x.shape, bool)
    m[:, 1, 4] = m[0, 2, :] = True
    rows = [(int(i), int(j), int(k), None if m[i, j, k] else float(x[i, j, k]), float(w[i, j, k])) for i, j, k in np.ndindex(x.shape)]
    return spark.createDataFrame(rows, "a int, b int, d int, x double, w double").cache(), np.ma.array(x, mask=m), w


def grouped(df, key, column):
    return {r[key]: r[column] for r in df.collect()}


def test_collapses_against_numpy(cells):
    df, x, w = cells
    methods = [m for m in c.METHODS if m not in ("any", "all")]
    got = {r.b: r for r in c.collapse(df, ["b"], "x", methods).collect()}
    won = {r.b: r for r in c.collapse(df, ["b"], "x", ["mean", "sum", "variance", "root_mean_square", "sum_of_weights", "sum_of_weights2", "integral", "mean_absolute_value"], "w", ddof=1).collect()}
    for b in range(4):
        v, u = x[:, b].compressed(), w[:, b][~x.mask[:, b]]
        top = np.percentile(v, 90)
        want = {"maximum": v.max(), "minimum": v.min(), "maximum_absolute_value": abs(v).max(), "minimum_absolute_value": abs(v).min(), "mid_range": (v.max() + v.min()) / 2, "range": np.ptp(v), "mean": v.mean(), "mean_absolute_value": abs(v).mean(), "sum": v.sum(), "integral": v.sum(), "sum_of_squares": (v**2).sum(), "sample_size": len(v), "sum_of_weights": len(v), "sum_of_weights2": len(v), "root_mean_square": np.sqrt((v**2).mean()), "variance": v.var(), "standard_deviation": v.std(), "median": np.median(v), "count_masked": x.mask[:, b].sum(), "mean_of_upper_decile": v[v >= top].mean()}
        for m in methods:
            assert got[b][m] == pytest.approx(want[m]), m
        mean, v1, v2 = (u * v).sum() / u.sum(), u.sum(), (u**2).sum()
        assert won[b].mean == pytest.approx(mean) and won[b].integral == pytest.approx((u * v).sum()) and won[b].sum_of_weights2 == pytest.approx(v2)
        assert won[b].variance == pytest.approx((u * (v - mean) ** 2).sum() * v1 / (v1**2 - v2))


def test_missing_data_threshold(cells):
    df, x, _ = cells
    for mtol in (0, 0.25, 0.5, 1):
        got = grouped(c.collapse(df, ["b"], "x", ["mean"], mtol=mtol), "b", "mean")
        for b in range(4):
            enough = x[:, b].count() >= (1 - mtol) * 15
            assert (got[b] is not None) == enough
    none = df.withColumn("x", F.lit(None).cast("double"))
    r = c.collapse(none, [], "x", ["mean", "sum", "sample_size"]).first()
    assert (r["mean"], r["sum"], r.sample_size) == (None, None, 0)
    nan = df.withColumn("x", F.when(F.col("d") == 1, float("nan")).otherwise(F.col("x")))
    assert math.isnan(c.collapse(nan, [], "x", ["minimum"]).first().minimum)


@pytest.mark.parametrize("method", ["linear", "lower", "higher", "nearest", "midpoint", "weibull", "hazen", "median_unbiased", "normal_unbiased", "inverted_cdf", "interpolated_inverted_cdf"])
def test_percentiles(cells, method):
    df, x, _ = cells
    got = {(r.b, r["rank"]): r.x for r in c.percentile(df, ["b"], "x", [0, 12, 37, 50, 91, 100], method).collect()}
    for (b, rank), v in got.items():
        assert v == pytest.approx(np.percentile(x[:, b].compressed(), rank, method=method)), (b, rank)
    assert len(got) == 24


def test_extremes_unique_coarsen(cells, spark):
    df, x, _ = cells
    ties = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, None), (3, 5.0), (4, 1.0)], "i int, v double")
    assert c.arg_extreme(ties, [], "v", ["i"]).first().i == 1 and c.arg_extreme(ties, [], "v", ["i"], False).first().i == 0
    assert c.unique(ties, "v").count() == 3
    got = {(r.a, r.b, r.d): r.x for r in c.coarsen(df, {"d": 2}, ["a", "b"], "x", "sum", {"d": 5}, trim_excess=True).collect()}
    assert got[0, 0, 1] == -20 + 2 + -20 + 3 and max(k[2] for k in got) == 1
    with pytest.raises(ValueError):
        c.coarsen(df, {"d": 2}, ["a"], "x", "sum", {"d": 5})


def test_bins(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 4.0, None, float("nan"))], "v double")
    run = lambda **k: [r.k for r in df.select(binning.digitize(F.col("v"), [0, 1, 3], **k).alias("k")).collect()]
    assert run() == [None, 0, 0, 1, 1, None, None, None, None]
    assert run(upper=True) == [None, None, 0, 0, 1, 1, None, None, None]
    assert run(open_ends=True) == [0, 1, 1, 2, 2, 3, 3, None, None]
    assert run(closed_ends=True) == [None, 0, 0, 1, 1, 1, None, None, None]
    many = [x / 4 for x in range(-8, 40)]
    assert [r.k for r in df.select(binning.digitize(F.col("v"), many).alias("k")).collect()][:3] == [4, 8, 10]
    rng = np.random.default_rng(1)
    a, b = rng.random(300), rng.random(300)
    two = spark.createDataFrame([(float(p), float(s)) for p, s in zip(a, b)], "a double, b double")
    edges = {"a": [0, 0.3, 0.7, 1], "b": [0.1, 0.5, 0.9]}
    want = np.histogram2d(a, b, bins=list(edges.values()))[0]
    assert {(r.a, r.b): r["count"] for r in binning.histogram(two, edges).collect()} == {(i, j): want[i, j] for i, j in np.ndindex(want.shape)}
    dense = np.histogram2d(a, b, bins=list(edges.values()), density=True)[0]
    assert all(r.density == pytest.approx(dense[r.a, r.b]) for r in binning.histogram(two, edges, density=True).collect())
    empty = {r.a: r.b for r in binning.bin_collapse(two.where("a < 0.3"), {"a": [0, 0.3, 0.7]}, "b", "mean").collect()}
    assert empty[1] is None and empty[0] == pytest.approx(b[a < 0.3].mean())


def test_groups(spark):
    axis = spark.createDataFrame([(i, i % 12 + 1, float(i), i + 1.0) for i in range(27)], "i int, month int, lower double, upper double")
    runs = grouping.runs(axis, "i", [q.djf().column({"month": F.col("month")}), q.jja().column({"month": F.col("month")})])
    sizes = sorted(r["count"] for r in runs.groupBy("group").count().collect())
    assert sizes == [2, 3, 3, 3, 3]
    whole = grouping.complete_groups(runs, "i", lower="lower", upper="upper", span=3.0, contiguous=1)
    assert whole.count() == 4
    gap = runs.withColumn("lower", F.when(F.col("i") == 6, F.col("lower") + 0.5).otherwise(F.col("lower")))
    assert grouping.complete_groups(gap, "i", lower="lower", upper="upper", span=3.0, contiguous=1).count() == 3


def line(spark, values, by=0):
    return spark.createDataFrame([(by, i, v) for i, v in enumerate(values)], "g int, i int, x double")


def out(df, column="x"):
    return [r[column] for r in df.orderBy("i").collect()]


def test_windows(spark):
    v = [1.0, 4.0, None, 2.0, 7.0, 5.0]
    assert out(windows.cumsum(line(spark, v), ["g"], "i", "x")) == [1, 5, None, 7, 14, 19]
    assert out(windows.cumsum(line(spark, v), ["g"], "i", "x", True)) == [1, 5, 5, 7, 14, 19]
    assert out(windows.diff(line(spark, v), ["g"], "i", "x")) == [3, None, None, 5, -2]
    assert out(windows.diff(line(spark, v), ["g"], "i", "x", 2)) == [None, None, None, -7]
    full = [1.0, 4.0, 3.0, 2.0, 7.0, 5.0]
    want = {"constant": np.pad(full, 1, constant_values=9), "nearest": np.pad(full, 1, mode="edge"), "reflect": np.pad(full, 1, mode="symmetric"), "wrap": np.pad(full, 1, mode="wrap")}
    for mode, padded in want.items():
        got = out(windows.convolution_filter(line(spark, full), ["g"], "i", "x", [0.1, 0.6, 0.3], mode, cval=9.0))
        assert got == pytest.approx(np.convolve(padded, [0.1, 0.6, 0.3], "valid")), mode
    assert out(windows.convolution_filter(line(spark, full), ["g"], "i", "x", [1, 1, 1], "constant"))[::5] == [None, None]
    with pytest.raises(ValueError):
        windows.convolution_filter(line(spark, full), ["g"], "i", "x", [1, 1, 1], "other")
    for n in (1, 2, 3, 6):
        own = full[:n]
        at = lambda k: own[0] if n == 1 else own[min(k % (2 * n - 2), -k % (2 * n - 2))]  # noqa: B023, E731
        got = out(windows.convolution_filter(line(spark, own), ["g"], "i", "x", [0.1, 0.2, 0.4, 0.2, 0.1], "mirror"))
        assert got == pytest.approx([sum(w * at(i + d) for d, w in zip((-2, -1, 0, 1, 2), (0.1, 0.2, 0.4, 0.2, 0.1))) for i in range(n)])
    assert out(windows.moving_window(line(spark, full), ["g"], "i", "x", "mean", 3)) == pytest.approx([2.5, 8 / 3, 3, 4, 14 / 3, 6])
    assert out(windows.moving_window(line(spark, full), ["g"], "i", "x", "sum", 3, mode="wrap")) == pytest.approx([10, 8, 9, 12, 14, 13])
    two = line(spark, full).unionByName(line(spark, full[:3], 1))
    assert windows.cumsum(two, ["g"], "i", "x").where("g = 1").orderBy("i").collect()[-1].x == 8


def test_derivatives_and_sphere(spark):
    n, m = 36, 19
    rows = [(j, i, i * 10.0, -90.0 + j * 10, math.sin(math.radians(i * 10)) * math.cos(math.radians(-90 + j * 10))) for j in range(m) for i in range(n)]
    df = spark.createDataFrame(rows, "iy int, ix int, lon double, lat double, f double")
    d = windows.derivative(df.where("iy = 9").withColumnRenamed("ix", "i"), [], "i", "f", "lon", wrap=True, period=360.0)
    assert out(d, "f") == pytest.approx([math.cos(math.radians(i * 10)) * math.sin(math.radians(10)) / 10 for i in range(n)])
    args = ([], "ix", "iy", "lon", "lat")
    options = {"x_wrap": True, "radius": 2.0}
    g = windows.grad_xy(df, *args, "f", **options)
    both = windows.div_xy(g, *args, "grad_x", "grad_y", out="l2", **options)
    lap = windows.laplacian_xy(df, *args, "f", **options).select("ix", "iy", "laplacian")
    pairs = both.join(lap, ["ix", "iy"]).where("l2 IS NOT NULL").select("l2", "laplacian", "lat", "f").collect()
    assert len(pairs) > 300 and all(r.l2 == pytest.approx(r.laplacian, abs=1e-12) for r in pairs)
    near = [r for r in pairs if abs(r.lat) <= 40 and abs(r.f) > 0.3]
    assert all(r.laplacian == pytest.approx(-2 * r.f / 4, rel=0.06) for r in near)
    curl = windows.curl_xy(g, *args, "grad_x", "grad_y", **options).where("curl IS NOT NULL AND abs(lat) < 60").agg(F.max(F.abs("curl"))).first()[0]
    assert curl < 1e-10


def test_cyclic_axes(spark):
    axis = spark.createDataFrame([(i, i * 90.0) for i in range(4)], "i int, coord double")
    rolled = windows.roll_coords(axis, "i", 1, 4, 360.0, ["coord"]).orderBy("i").collect()
    assert [r.coord for r in rolled] == [-90, 0, 90, 180]
    assert [r.coord for r in windows.anchor(axis, "i", 4, 100.0, 360.0, "coord").orderBy("i").collect()] == [180, 270, 360, 450]
    assert sorted(r.i for r in windows.halo(line(spark, [1.0, 2.0, 3.0]), ["g"], "i", 1).collect()) == [-1, 0, 1, 2, 3]
    edge = {r.i: r.x for r in windows.halo(line(spark, [1.0, 2.0, 3.0]), ["g"], "i", 1, cyclic=True).collect()}
    assert edge == {-1: 3, 0: 1, 1: 2, 2: 3, 3: 1}
    grid = reshape.full(spark, {"y": 2, "x": 4}, 1.0).withColumn("value", F.col("x") + 10 * F.col("y"))
    fold = {(r.y, r.x): r.value for r in windows.tripolar_halo(grid, "x", "y", 1, 4, 2).collect()}
    assert [fold[2, x] for x in range(4)] == [13, 12, 11, 10]


def test_shapes(spark):
    df = reshape.grid(spark, {"a": 2, "b": 3}).withColumn("value", F.col("a") * 3 + F.col("b"))
    assert {(r.x, r.y): r.value for r in reshape.reshape(df, {"a": 2, "b": 3}, {"x": 3, "y": 2}).collect()} == {(x, y): x * 2 + y for x in range(3) for y in range(2)}
    assert reshape.flatten(df, {"a": 2, "b": 3}, "i").where("i <> value").count() == 0
    assert reshape.pad_missing(df, "b", 3, {"a": 2}, "value", 1, 2).where("value IS NULL").count() == 6
    assert [r.value for r in reshape.compressed(df.withColumn("value", F.when(F.col("value") % 2 == 0, F.col("value"))), {"a": 2, "b": 3}, "value").orderBy("position").collect()] == [0, 2, 4]
    pick = lambda p: sorted((r.b, r.value) for r in reshape.take(df.where("a = 0"), "b", p, 3).collect())
    assert pick([2, 0, -1]) == [(0, 2), (1, 0), (2, 2)] and pick(slice(None, None, -1)) == [(0, 2), (1, 1), (2, 0)] and pick(slice(1, 3)) == [(0, 1), (1, 2)]
    assert reshape.element(df, {"a": 2, "b": 3}, "value", -1) == 5 and len(list(reshape.sections(df, "a", 2))) == 2
    assert reshape.masked_all(spark, {"a": 4}).where("value IS NULL").count() == 4


def test_subspaces(spark):
    axis = spark.createDataFrame([(i, i * 60.0) for i in range(6)], "i int, coord double")
    data = spark.createDataFrame([(i, float(i)) for i in range(6)], "i int, x double")
    pick = lambda query, **k: sorted(r.i for r in subspace.select_positions(axis, "i", query, **k).collect())
    assert pick(q.wi(-70, 60), period=360.0) == [0, 1, 5] and pick(q.wo(-70, 60), period=360.0) == [2, 3, 4]
    with pytest.raises(ValueError):
        pick(q.wo(0, 360), period=360.0)
    chosen = {"i": subspace.select_positions(axis, "i", q.set_([60.0, 180.0]))}
    run = lambda **k: sorted((r.i, r.x) for r in subspace.subspace(data, chosen, "x", **k).collect())
    assert run() == [(1, 1), (3, 3)] and run(mode="envelope") == [(1, 1), (2, None), (3, 3)] and run(halo=1) == [(i, i) for i in range(5)]
    assert [v for _, v in run(mode="full")] == [None, 1, None, 3, None, None]
    assert [r["mask"] for r in subspace.domain_mask(data, chosen).orderBy("i").collect()] == [True, False, True, False, True, True]
    square = lambda x, y, n: [{"x": a, "y": b} for a, b in ((x, y), (x + n, y), (x + n, y + n), (x, y + n))]
    polygons = spark.createDataFrame([(0, square(0.0, 0.0, 2.5)), (1, square(2.5, 0.0, 1.0))], "cell int, vertices array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1.2, 2.2), (3.0, 0.5), (3.0, 2.0)], "px double, py double")
    assert sorted((r.px, r.cell) for r in subspace.point_in_polygon(points, polygons, "px", "py").collect()) == [(1.2, 0), (3.0, 1)]


def test_weights(spark):
    one = lambda col: spark.range(1).select(col.alias("x")).first().x
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    total = weights.regular_axis(spark, -90, 90, 30).select(F.sum(weights.area(F.lit(0.0), F.lit(360.0), F.col("lower"), F.col("upper"), measure=True, radius=2.0)).alias("x")).first().x
    assert total == pytest.approx(4 * math.pi * 4)
    assert one(weights.plane_polygon_area(arr(0, 2, 2, 0), arr(0, 0, 3, 3))) == 6
    assert one(weights.spherical_polygon_area(arr(0, 90, 0), arr(0, 0, 90))) == pytest.approx(math.pi / 2)
    assert one(weights.spherical_polygon_area(arr(350, 80, 350), arr(0, 0, 90))) == pytest.approx(math.pi / 2)
    assert one(weights.spherical_polygon_area(arr(0, 90, 180, 270), arr(0, 0, 0, 0))) == pytest.approx(2 * math.pi)
    assert one(weights.great_circle_length(arr(0, 90, 90), arr(0, 0, 45))) == pytest.approx(math.pi * 0.75)
    assert one(weights.plane_line_length(arr(0, 3, 3), arr(0, 4, 6))) == 7
    nodes = spark.createDataFrame([(0, 0, k, x, y, False) for k, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])] + [(0, 1, k, x, y, True) for k, (x, y) in enumerate([(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)])], "c int, p int, k int, x double, y double, hole boolean")
    assert weights.geometry_area(nodes, "c", "p", "k", "x", "y", "hole", spherical=False).first().area == 15
    axis = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "i int, coord double")
    b = weights.create_bounds(axis).orderBy("i").collect()
    assert [(r.lower, r.upper) for r in b] == [(0.5, 1.5), (1.5, 3.0), (3.0, 5.0)]
    assert weights.contiguous(weights.create_bounds(axis)) and not weights.contiguous(weights.create_bounds(axis, cellsize=0.5))
    assert weights.scaled(weights.create_bounds(axis), "coord", 1.0).agg(F.max("coord")).first()[0] == 1
    with pytest.raises(Exception):
        weights.positive(axis.withColumn("coord", -F.col("coord")), "coord").collect()


def test_regridding(spark):
    src, dst = weights.regular_axis(spark, 0, 10, 1), weights.regular_axis(spark, 0, 10, 2.5)
    data = spark.createDataFrame([(i, None if i == 3 else float(i)) for i in range(10)], "i int, x double")
    got = out(rg.regrid(data, [], "x", "conservative", {"i": (src, dst)}))
    full = np.ma.array(np.arange(10.0), mask=np.arange(10) == 3)
    want = []
    for j in range(4):
        w = np.clip(np.minimum(np.arange(1, 11), 2.5 * j + 2.5) - np.maximum(np.arange(10), 2.5 * j), 0, None) * ~full.mask
        want.append((w * np.arange(10)).sum() / w.sum())
    assert got == pytest.approx(want)
    lin = out(rg.regrid(data, [], "x", "linear", {"i": (src, dst)}))
    assert lin[0] == pytest.approx(0.75) and lin[1] is None and lin[2] == pytest.approx(5.75)
    near = spark.createDataFrame([(0, 0.4), (1, 1.0), (2, 9.9), (3, 4.6)], "i int, coord double")
    assert out(rg.regrid(data, [], "x", "nearest_stod", {"i": (src, near)})) == [0, 0, 9, 4]
    # On the sphere, area-weighted totals are kept.
    lat, lat2 = weights.regular_axis(spark, -90, 90, 10), weights.regular_axis(spark, -90, 90, 25.714285714285715)
    lon, lon2 = weights.regular_axis(spark, 0, 360, 20), weights.regular_axis(spark, -15, 345, 30)
    rng = np.random.default_rng(2)
    field = spark.createDataFrame([(j, i, float(rng.random())) for j in range(18) for i in range(18)], "y int, i int, x double")
    op = rg.operator("conservative", {"y": (lat, lat2), "i": (lon, lon2)}, spherical=True, latitude="y", periods={"i": 360.0})
    new = op.apply(field, [], "x")
    area = lambda axis: axis.select(F.col("i").alias("y"), weights.latitude(F.col("lower"), F.col("upper")).alias("w"))
    mean = lambda df, axis: df.join(area(axis), "y").agg(F.sum(F.col("x") * F.col("w")) / F.sum("w")).first()[0]
    assert new.count() == 84 and mean(new, lat2) == pytest.approx(mean(field, lat))
    assert op.equal_weights(op)
    with pytest.raises(ValueError):
        rg.operator("cubic", {})


def test_healpix(spark):
    for level in (0, 1, 3):
        n = 12 * 4**level
        df = hp.cells(spark, level)
        p = F.col("healpix_index")
        got = df.select(p.alias("p"), hp.nested_to_ring(p, level).alias("r"), hp.centre(p, level).alias("c"), hp.ring_to_nested(hp.nested_to_ring(p, level), level).alias("back")).withColumn("found", hp.locate(F.col("c.lon"), F.col("c.lat"), level)).collect()
        assert sorted(r.r for r in got) == list(range(n)) and all(r.back == r.p == r.found for r in got)
        rings = sorted(got, key=lambda r: r.r)
        assert all(a.c.lat >= b.c.lat - 1e-9 for a, b in zip(rings, rings[1:])), level
    assert [round(math.degrees(math.asin(2 / 3)), 6)] == [round(hp.cells(spark, 0).select(hp.centre(F.col("healpix_index"), 0).alias("c")).first().c.lat, 6)]
    p = F.col("healpix_index")
    big = spark.createDataFrame([(12 * 4**29 - 1,), (0,), (4**29 * 5 + 12345,)], "healpix_index long")
    r = big.select(p.alias("p"), hp.ring_to_nested(hp.nested_to_ring(p, 29), 29).alias("b"), hp.change_scheme(hp.change_scheme(p, "nested", "zuniq", 29), "zuniq", "nested").alias("z"), hp.change_scheme(hp.change_scheme(p, "nested", "nuniq", 29), "nuniq", "nested").alias("u")).collect()
    assert all(x.z == x.u == x.p for x in r)
    mixed = spark.createDataFrame([(0, 5), (3, 700)], "level int, p long").select("p", "level", F.when(F.col("level") == 0, hp.to_nuniq(F.col("p"), 0)).otherwise(hp.to_nuniq(F.col("p"), 3)).alias("u"))
    z = mixed.select("p", "level", hp.zuniq_level(hp.change_scheme(F.col("u"), "nuniq", "zuniq")).alias("l"), hp.change_scheme(hp.change_scheme(F.col("u"), "nuniq", "zuniq"), "zuniq", "nuniq").alias("back"), "u").collect()
    assert all(x.l == x.level and x.back == x.u for x in z)
    df = hp.cells(spark, 2).withColumn("v", F.col("healpix_index") * 1.0)
    down = hp.decrease_level(hp.increase_level(df, "healpix_index", 2, 4, "v"), "healpix_index", 4, 2, [], "v")
    assert down.join(df.withColumnRenamed("v", "o"), "healpix_index").where("abs(v - o) > 1e-9").count() == 0
    with pytest.raises(Exception):
        hp.decrease_level(df.where("healpix_index <> 5"), "healpix_index", 2, 1, [], "v").collect()
    edges, nodes = hp.to_faces(hp.cells(spark, 1), "healpix_index", 1)
    assert edges.count() == 192 and nodes.count() == 50
    area = hp.cells(spark, 1).select(hp.corners(F.col("healpix_index"), 1).alias("k")).count()
    assert area == 48


def test_vertical(spark):
    t = {k: F.lit(float(v)) for k, v in {"eta": 1, "s": -0.5, "depth": 100, "depth_c": 10, "a": 3, "b": 0.2, "C": -0.4, "sigma": -0.3, "nsigma": 2, "zlev": -77, "k": 1, "z1": 5, "z2": 3, "href": 50, "k_c": 2}.items()}
    one = lambda name, **more: spark.range(1).select(vertical.compute(name, {**t, **{k: F.lit(float(v)) for k, v in more.items()}})[1].alias("x")).first().x
    big_c = 0.8 * math.sinh(-1.5) / math.sinh(3) + 0.2 * (math.tanh(0) / (2 * math.tanh(1.5)) - 0.5)
    assert one("ocean_s_coordinate") == pytest.approx(1 * 0.5 + 10 * -0.5 + 90 * big_c)
    s1 = 10 * -0.5 + 90 * -0.4
    assert one("ocean_s_coordinate_g1") == pytest.approx(s1 + 1 * (1 + s1 / 100))
    assert one("ocean_s_coordinate_g2") == pytest.approx(1 + 101 * (-5 - 40) / 110)
    assert one("ocean_sigma_coordinate") == pytest.approx(1 - 0.3 * 101)
    assert one("ocean_sigma_z_coordinate") == pytest.approx(1 - 0.3 * 11) and one("ocean_sigma_z_coordinate", k=2) == -77
    f = 4 + 1 * math.tanh(6 / 2 * 50)
    assert one("ocean_double_sigma_coordinate") == pytest.approx(-0.3 * f) and one("ocean_double_sigma_coordinate", k=3) == pytest.approx(f - 1.3 * (100 - f))
    assert one("atmosphere_hybrid_sigma_pressure_coordinate", p0=1000, ps=900) == pytest.approx(3000 + 180)
    assert one("atmosphere_sleve_coordinate", ztop=10, b1=0.5, zsurf1=4) == pytest.approx(32)
    with pytest.raises(ValueError):
        vertical.compute("atmosphere_sigma_coordinate", {})


def test_combining(spark):
    axis = lambda *v: spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, coord double")
    field = lambda units, *v: {"name": "t", "units": units, "df": spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i_t int, value double"), "axes": {"t": axis(*[float(x) for x in v])}}
    joined = combine.aggregate([field("m", 4, 5), field("m", 1, 2, 3), field("km", 6, 7)])
    assert len(joined) == 1
    assert [r.value for r in joined[0]["df"].orderBy("i_t").collect()] == [1, 2, 3, 4, 5, 6000, 7000]
    assert len(combine.aggregate([field("m", 1, 3), field("m", 2, 4)])) == 2 and len(combine.aggregate([field("m", 1), field("s", 2)])) == 2
    assert combine.misaligned(axis(1, 2), axis(1, 3), "i").collect()[0]["right"] == 3
    assert combine.combined_bounds("add", (F.lit(1.0), (F.lit(0.0), F.lit(2.0))), (F.lit(1.0), None), "and") is None
    assert combine.combined_bounds("add", (F.lit(1.0), (F.lit(0.0), F.lit(2.0))), (F.lit(1.0), None), "or") is not None


@pytest.fixture(scope="module")
def cube(spark):
    axes = Cube.regular_lonlat(spark, (0, 360, 90), (-90, 90, 60))
    rows = [(j, i, float(10 * j + i)) for j in range(3) for i in range(4)]
    return Cube(spark.createDataFrame(rows, "i_lat int, i_lon int, value double"), axes, units=Units.of("K"), name="air_temperature")


def test_cube(cube, spark):
    area = cube.collapse("mean", weights=cube.weights("latitude", "longitude"))
    assert area.df.first().value == pytest.approx((1.5 + 11.5 * 2 + 21.5) / 4) or area.df.first().value == pytest.approx(11.5)
    assert str(area.cell_methods[0]) == "lat: lon: mean" and not area.axes
    assert cube.collapse("variance", ["lat"]).units == Units.of("K2")
    assert cube.collapse("maximum", ["latitude"]).collapse("minimum", ["X"]).df.first().value == 20
    sub = cube.subspace(longitude=q.wi(-50, 60), latitude=q.gt(0))
    assert sub.axis("lon").size == 2 and sorted(r.value for r in sub.df.collect()) == [20, 23]
    assert cube.subspace(lat=slice(None, None, -1)).df.where("i_lat = 0 AND i_lon = 0").first().value == 20
    assert (cube.to_units("Celsius") + 0).df.where("i_lat = 0 AND i_lon = 1").first().value == pytest.approx(1 - 273.15)
    assert (cube - cube).collapse("maximum_absolute_value").df.first().value == 0
    zonal = cube.collapse("mean", ["lon"])
    assert (cube - zonal).collapse("sum").df.first().value == pytest.approx(0)
    assert (2 * cube).df.agg(F.sum("value")).first()[0] == 2 * (cube.df.agg(F.sum("value")).first()[0])
    rolled = cube.roll("X", 1)
    assert [r.coord for r in rolled.axis("X").table.orderBy("i").collect()] == [-45, 45, 135, 225] and rolled.df.where("i_lon = 0 AND i_lat = 0").first().value == 3
    assert cube.anchor("X", 100.0).axis("X").table.orderBy("i").first().coord == 135
    assert cube.where(q.lt(5), 0.0).collapse("minimum").df.first().value == 0
    new = Cube.regular_lonlat(spark, (0, 360, 180), (-90, 90, 90))
    got = cube.regrids(new, "conservative")
    w = got.collapse("mean", weights=got.weights("lat", "lon")).df.first().value
    assert w == pytest.approx(area.df.first().value)
    halves = [cube.subspace(lat=slice(0, 1)), cube.subspace(lat=slice(1, 3))]
    assert Cube.concatenate(halves, "lat").equals(cube)
    assert cube.grouped("sum", "lat", F.when(F.col("coord") > 0, "n").otherwise("s")).df.count() == 8
    assert cube.pad_missing("lat", after=1).is_masked() and not cube.is_masked() and cube.contains(23.0)
    assert cube.direction("Y") and cube.iscyclic("X") and cube.collapse("range", ["lat"]).transpose(["lon"]).squeeze().keys == ["i_lon"]
    with pytest.raises(ValueError):
        cube.collapse("integral")
    with pytest.raises(ValueError):
        cube + replace_units(cube, "m")


def replace_units(cube, units):
    return cube.override_units(units)


def test_from_table_and_lists(spark, cube):
    t = spark.createDataFrame([("x", 2, 1.0), ("y", 1, 2.0), ("x", 1, 3.0), ("x", 1, None)], "a string, b int, v double")
    made = Cube.from_table(t, {"a": "a", "b": "b"}, "v", "m")
    assert made.shape == {"i_a": 2, "i_b": 2} and made.collapse("sum", ["b"]).df.orderBy("i_a").first().value == 4
    found = CubeList([cube, made, cube])
    assert len(found("air_temperature")) == 2 and len(found.select_by_units("K")) == 2 and len(found.select_by_units("km", exact=False)) == 1
    assert len(found.select_by_rank(q.ge(2))) == 3 and len(found.select_by_construct("X")) == 2 and len(unique(found)) == 2
    found.sort(reverse=True)
    assert found[0].name == "air_temperature" or found[0].name is None
    with pytest.raises(ValueError):
        found.select_field("air_temperature")
    assert isinstance(Axis("z", 1), Axis)


def test_calendar_groups_of_cubes(spark):
    from gridloom.functions import calendars as cal
    from gridloom.sources.examples import example

    t = example(spark, 1)
    assert t.grouped("mean", "T", cal.Y()).axis("T").size == 11 and t.grouped("mean", "T", cal.Y(1, month=12)).axis("T").size == 10
    assert t.grouped("mean", "T", cal.M(3, day=1)).axis("T").size == 41 and t.grouped("mean", "T", 12).axis("T").size == 10
    assert t.grouped("mean", "T", q.djf()).axis("T").size == 10 and t.grouped("mean", "T", q.seasons()).axis("T").size == 40
    assert t.grouped("mean", "T", cal.Y(), group_size=12).axis("T").size == 9
    assert t.grouped("mean", "T", q.djf(), group_contiguous=1, group_span=90.0).axis("T").size == 7
    climate = t.climatology("mean", "maximum", "T")
    assert climate.count() == 12 * 40 and climate.where("value IS NULL").count() == 0
    june = t.subspace(T=q.month(6))
    assert june.axis("T").size == 10
    want = june.collapse("maximum", ["T"]).df.where("i_lat = 0 AND i_lon = 0").first().value
    assert climate.where("i_lat = 0 AND i_lon = 0 AND within = 6").first().value == pytest.approx(want)


def test_second_order_regridding_is_exact_for_straight_lines(spark):
    src, dst = weights.regular_axis(spark, 0, 12, 2), weights.regular_axis(spark, 2, 10, 1)
    data = spark.createDataFrame([(j, i, 3.0 * (2 * i + 1) - 2 * (2 * j + 1)) for j in range(6) for i in range(6)], "y int, i int, x double")
    got = rg.regrid(data, [], "x", "conservative_2nd", {"y": (src, dst), "i": (src, dst)}).collect()
    assert len(got) == 64 and all(r.x == pytest.approx(3 * (r.i + 2.5) - 2 * (r.y + 2.5)) for r in got)
    flat = rg.regrid(data.withColumn("x", F.when(F.col("i") != 2, 7.0)), [], "x", "conservative_2nd", {"y": (src, dst), "i": (src, dst)}).collect()
    assert {r.x for r in flat if r.i not in (2, 3)} == {7.0} and {r.x for r in flat if r.i in (2, 3)} == {None}


def test_regridding_cells_of_any_shape(spark):
    box = lambda x, y, n, m: [{"x": a, "y": b} for a, b in ((x, y), (x + n, y), (x + n, y + m), (x, y + m))]
    kind = "i int, vertices array<struct<x:double,y:double>>"
    src = spark.createDataFrame([(4 * j + i, box(i * 1.0, j * 1.0, 1.0, 1.0)) for j in range(4) for i in range(4)], kind)
    diamond = [{"x": a, "y": b} for a, b in ((2.0, 1.0), (3.0, 2.0), (2.0, 3.0), (1.0, 2.0))]
    dst = spark.createDataFrame([(0, diamond), (1, box(0.5, 0.5, 2.0, 1.0)), (2, diamond[::-1]), (3, box(9.0, 9.0, 1.0, 1.0))], kind)
    w = rg.polygon_weights(src, dst, 1.5)
    got = {(r.dst, r.src): r.w for r in w.collect()}
    assert {k: v for k, v in got.items() if k[0] == 0} == {(0, s): pytest.approx(0.25) for s in (5, 6, 9, 10)}
    assert sum(v for k, v in got.items() if k[0] == 1) == pytest.approx(1) and got[1, 5] == pytest.approx(0.25) and got[1, 0] == pytest.approx(0.125)
    assert {s: v for (d, s), v in got.items() if d == 2} == {s: v for (d, s), v in got.items() if d == 0}
    data = spark.createDataFrame([(s, None if s == 5 else float(s)) for s in range(16)], "cell int, x double")
    out_ = {r.cell: r.x for r in rg.RegridOperator("conservative", {"cell": w}).apply(data, [], "x").collect()}
    assert out_[0] == pytest.approx((6 + 9 + 10) / 3) and 3 not in out_
    lat = spark.createDataFrame([(k, box(0.0, -90.0 + 30 * k, 90.0, 30.0)) for k in range(6)], kind)
    one = spark.createDataFrame([(0, box(0.0, -30.0, 90.0, 90.0))], kind)
    share = {r.src: r.w for r in rg.polygon_weights(lat, one, 0.5, spherical=True).collect()}
    total = math.sin(math.radians(60)) + 0.5
    assert share == {2: pytest.approx(0.5 / total), 3: pytest.approx(0.5 / total), 4: pytest.approx((math.sin(math.radians(60)) - 0.5) / total)}


def test_more_of_cubes(cube, spark):
    area = cube.cell_area(radius=1.0)
    assert area.collapse("sum").df.first().value == pytest.approx(4 * math.pi) and area.units == Units.of("m2")
    counts = Cube.histogram({"t": (cube, [0, 5, 15, 30])})
    assert {r.t: r["count"] for r in counts.collect()} == {0: 4, 1: 4, 2: 4}
    got = {r.t: r.value for r in cube.bin("maximum", {"t": (cube, [0, 5, 15, 30])}).collect()}
    assert got == {0: 3, 1: 13, 2: 23}
    assert cube.extreme_positions().first()[:2] == (2, 3) and cube.extreme_positions(["lat"]).count() == 4
    assert cube.unique().count() == 12 and cube.coarsen("mean", lon=2).axis("lon").size == 2
    levels = Cube(spark.createDataFrame([(0, 0.0), (1, 1.0)], "i_z int, value double"), {"z": Axis("z", 2)})
    full = Cube(cube.df.crossJoin(levels.df.select("i_z")), {**cube.axes, **levels.axes})
    p = full.with_vertical("atmosphere_sigma_coordinate", {"ptop": 10.0, "sigma": levels, "ps": cube})
    assert p.name == "air_pressure" and p.df.where("i_z = 1 AND i_lat = 2 AND i_lon = 3").first().value == 23 and p.df.where("i_z = 0").agg(F.max("value")).first()[0] == 10


def test_bins_against_plain_python(spark):
    import random

    from gridloom.operators.binning import digitize

    def plain(v, e, upper, open_ends, closed_ends):
        if v is None or v != v:
            return None
        k, last = sum((b < v) if upper else (b <= v) for b in e), len(e) - 1
        if closed_ends and v in (e[0], e[-1]):
            k = 1 if v == e[0] else last
        return k if open_ends else (k - 1 if 1 <= k <= last else None)

    random.seed(4)
    few, many = [0.0, 1.0, 2.5, 4.0], [k / 20 for k in range(81)]
    values = [*(random.uniform(-1, 5) for _ in range(200)), *few, *many, float("nan"), None, float("inf"), float("-inf")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    options = [(e, u, o, c) for e in (few, many) for u in (False, True) for o, c in ((False, False), (True, False), (False, True))]
    rows = df.select("k", *[digitize(F.col("x"), *a).alias(f"b{n}") for n, a in enumerate(options)]).collect()
    for r in rows:
        assert [r[f"b{n}"] for n in range(len(options))] == [plain(values[r.k], *a) for a in options]


def test_cubes_of_other_coordinates_do_not_combine(spark):
    from gridloom.operators.cube import Cube

    df = spark.createDataFrame([(float(10 * k), float(k)) for k in range(8)], "lon double, v double")
    c = Cube.from_table(df, {"lon": "lon"}, "v", "K")
    part = c.subspace(lon=slice(2, 6))
    with pytest.raises(ValueError, match="cells"):
        c - part
    with pytest.raises(ValueError, match="coordinates"):
        c.subspace(lon=slice(0, 4)) - part
    assert [r.value for r in (part - c.subspace(lon=slice(2, 6))).df.collect()] == [0.0] * 4
    one = c.subspace(lon=slice(3, 4))
    assert sorted(r.value for r in (c - one).df.collect()) == [k - 3.0 for k in range(8)] and (one - c).axis("lon").size == 8


def test_moving_windows_go_on_beyond_the_ends(spark):
    from gridloom.operators import windows

    line = spark.createDataFrame([(k, float(k * k)) for k in range(6)], "i int, x double")
    at = {"reflect": lambda j, n: -1 - j if j < 0 else 2 * n - 1 - j if j >= n else j, "mirror": lambda j, n: -j if j < 0 else 2 * (n - 1) - j if j >= n else j, "nearest": lambda j, n: min(max(j, 0), n - 1), "wrap": lambda j, n: j % n}
    for mode, f in at.items():
        got = {r.i: r.x for r in windows.moving_window(line, [], "i", "x", "sum", 5, mode=mode).collect()}
        assert got == {i: float(sum(f(j, 6) ** 2 for j in range(i - 2, i + 3))) for i in range(6)}, mode
    with pytest.raises(ValueError):
        windows.moving_window(line, [], "i", "x", "sum", 3, mode="other")


@pytest.mark.parametrize("block", [3, 7])
def test_lines_in_blocks_are_like_lines_in_one(spark, monkeypatch, block):
    """Every operator along an axis, with blocks far shorter than the lines, against blocks longer than them."""
    rows = [(g, i, None if i % 11 == 5 else float((i * 37 + (g or 0)) % 19), float(i * 2 + i % 3), 1.0 + i % 4) for g, n in ((0, 50), (1, 9), (2, 1), (None, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int, x double, c double, w double")
    one = df.where("g = 0").drop("g")

    def everything():
        made = {}
        for name, d, by in (("many", df, ["g"]), ("one", one, [])):
            made["cumsum", name] = windows.cumsum(d, by, "i", "x")
            made["zero", name] = windows.cumsum(d, by, "i", "x", True)
            for n in (1, 2, 4):
                made["diff", n, name] = windows.diff(d, by, "i", "x", n)
            for mode in ("constant", "wrap", "reflect", "nearest"):
                made["conv", mode, name] = windows.convolution_filter(d, by, "i", "x", [0.5, 0.25, 0.1, 0.1, 0.05], mode, cval=2.0, origin=1)
            made["mean", name] = windows.moving_window(d, by, "i", "x", "mean", 6, weights="w")
            made["ends", name] = windows.derivative(d, by, "i", "x", "c", one_sided_at_boundary=True)
            made["centred", name] = windows.derivative(d, by, "i", "x", "c")
            made["wrapped", name] = windows.moving_window(d.where("g IS NULL OR g <> 2") if by else d, by, "i", "x", "sum", 5, mode="wrap")
        return {k: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in v.collect()], key=str) for k, v in made.items()}

    whole = everything()
    monkeypatch.setattr(windows, "BLOCK", block)
    cut = everything()
    assert cut.keys() == whole.keys() and all(cut[k] == whole[k] for k in whole), [k for k in whole if cut[k] != whole[k]]
    # By hand: a wrapped line shorter than the filter's reach.
    short = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i int, x double")
    got = {r.i: r.x for r in windows.convolution_filter(short, [], "i", "x", [1.0] * 7, "wrap").collect()}
    assert got == {0: 1.0 * 3 + 2.0 * 4, 1: 2.0 * 3 + 1.0 * 4}


def test_no_window_takes_all_rows_of_one_axis(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "i int, x double")
    for got in (windows.cumsum(df, [], "i", "x"), windows.diff(df, [], "i", "x", 2), windows.moving_window(df, [], "i", "x", "mean", 3), windows.convolution_filter(df, [], "i", "x", [1.0, 1.0, 1.0], "reflect")):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        found = [line for line in plan.splitlines() if "Window [" in line]
        assert found and all("__blk" in line for line in found)


@pytest.mark.parametrize("level", [0, 1, 2, 3, 6])
def test_healpix_cells_as_a_mesh_share_their_nodes(spark, level):
    """Euler's formula, an even number of faces at each edge, nodes where the cells' corners are, and areas that add up to the sphere."""
    cells = hp.cells(spark, level).select("healpix_index")
    edges, nodes = hp.to_faces(cells, "healpix_index", level)
    faces = edges.withColumnRenamed("healpix_index", "face")
    made = weights.mesh_edges(faces).agg(F.count("*").alias("n"), F.min("faces").alias("low"), F.max("faces").alias("high")).first()
    f, v = 12 * 4**level, nodes.count()
    assert (v - made.n + f, v, made.low, made.high) == (2, 12 * 4**level + 2, 2, 2)
    at = cells.select("healpix_index", F.posexplode(hp.corners(F.col("healpix_index"), level)).alias("corner", "p"))
    far = at.join(edges, ["healpix_index", "corner"]).join(nodes, "node").select(F.abs(F.col("lat") - F.col("p.lat")).alias("y"), (F.abs(F.sin(F.radians(F.col("lon") - F.col("p.lon")) / 2)) * F.cos(F.radians("lat"))).alias("x")).agg(F.max("x"), F.max("y"), F.count("*")).first()
    assert far[0] < 1e-12 and far[1] < 1e-10 and far[2] == 4 * f
    total = weights.mesh_area(faces, nodes).agg(F.sum("area"), F.min("area"), F.max("area")).first()
    assert abs(total[0] - 4 * math.pi) < 1e-9 and total[2] / total[1] < 1.6


def test_aggregates_of_the_users_own(spark):
    """Third central moment by states of power sums: many partitions and groups, missing values, weights, null keys and odd names."""
    from gridloom.operators import custom

    moment = custom.Aggregate(("n", "a", "b", "c"), lambda x, w: {"n": w.sum(), "a": (w * x).sum(), "b": (w * x**2).sum(), "c": (w * x**3).sum()}, lambda s: {k: v.sum() for k, v in s.items()}, lambda s: s["c"] / s["n"] - 3 * s["a"] * s["b"] / s["n"] ** 2 + 2 * (s["a"] / s["n"]) ** 3)
    rng = np.random.default_rng(0)
    rows = [(None if i % 13 == 0 else int(i % 5), "ab"[i % 2], None if i % 7 == 0 or i % 5 == 4 else float(rng.normal()), float(1 + i % 3) if i % 11 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "`g.x` int, k0 string, v double, w double").repartition(9)
    got = {(r["g.x"], r.k0): r.v for r in custom.collapse_with(df, ["g.x", "k0"], "v", moment, "w").collect()}
    keys = {(g, k) for g, k, _, _ in rows}
    assert set(got) == keys
    for g, k in keys:
        own = [(x, w) for a, b, x, w in rows if (a, b) == (g, k) and x is not None and w is not None]
        if not own:
            assert got[g, k] is None
            continue
        x, w = map(np.array, zip(*own))
        m = (w * x).sum() / w.sum()
        assert got[g, k] == pytest.approx((w * (x - m) ** 3).sum() / w.sum(), abs=1e-9)
    few = custom.collapse_with(df, ["g.x"], "v", moment, mtol=0.1)
    assert {r["g.x"] for r in few.collect() if r.v is None} == {None, 0, 1, 2, 3, 4}
    whole = custom.collapse_with(df, [], "v", moment).collect()
    assert len(whole) == 1 and whole[0].v is not None and custom.collapse_with(df.limit(0), [], "v", moment).count() == 0
    plan = custom.collapse_with(df, ["k0"], "v", moment)._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("MapInArrow", plan.index("FlatMapGroupsInArrow") + 20)


def test_healpix_work_is_done_once_and_on_all_cores(spark):
    assert str(hp.ring_to_nested(F.rand(), 3)).count("rand(") == 1
    assert str(hp.nested_to_ring(F.rand(), 3)).count("rand(") == 1
    from gridloom.plans.registry import _dealt

    assert _dealt(spark.range(100).coalesce(1)).rdd.getNumPartitions() >= 3
