import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import sphere
from gridloom.operators.sphere import areas, clipped, turned


def vectors(lon, lat):
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def lonlat(v):
    return math.degrees(math.atan2(v[1], v[0])), math.degrees(math.asin(max(-1, min(1, v[2] / np.linalg.norm(v)))))


def rotated(nj, ni, tilt=35.0):
    """A global grid about a tilted pole: (coords, bounds) rows with 2-d longitudes and latitudes."""
    t = math.radians(tilt)
    turn = np.array([[math.cos(t), 0, math.sin(t)], [0, 1, 0], [-math.sin(t), 0, math.cos(t)]])
    at = lambda j, i: lonlat(turn @ vectors(360 * i / ni, -90 + 180 * j / nj))
    coords = [(j, i, *at(j + 0.5, i + 0.5)) for j in range(nj) for i in range(ni)]
    bounds = [(j, i, k, *at(j + dj, i + di)) for j in range(nj) for i in range(ni) for k, (dj, di) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))]
    return coords, bounds


def grid(spark, nj, ni, tilt, cyclic=True):
    coords, bounds = rotated(nj, ni, tilt)
    return sphere.curvilinear(spark.createDataFrame(coords, "j int, i int, lon double, lat double"), "j", "i", ni, bounds=spark.createDataFrame(bounds, "j int, i int, k int, lon double, lat double"), cyclic=cyclic), np.array([c[2:] for c in coords])


def octahedron(levels):
    """Triangles that cover the sphere: nodes and faces."""
    nodes = [tuple(map(float, v)) for v in ((1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    faces = [(a, b, 4) for a, b in ((0, 1), (1, 2), (2, 3), (3, 0))] + [(b, a, 5) for a, b in ((0, 1), (1, 2), (2, 3), (3, 0))]
    for _ in range(levels):
        seen, out = {}, []

        def half(a, b):
            key = tuple(sorted((a, b)))
            if key not in seen:
                m = np.array(nodes[a]) + nodes[b]
                nodes.append(tuple(m / np.linalg.norm(m)))
                seen[key] = len(nodes) - 1
            return seen[key]

        for a, b, c in faces:
            x, y, z = half(a, b), half(b, c), half(c, a)
            out += [(a, x, z), (x, b, y), (z, y, c), (x, y, z)]
        faces = out
    return nodes, faces


def mesh_tables(spark, levels):
    nodes, faces = octahedron(levels)
    n = spark.createDataFrame([(k, *lonlat(v)) for k, v in enumerate(nodes)], "node long, lon double, lat double")
    f = spark.createDataFrame([(k, c, node) for k, face in enumerate(faces) for c, node in enumerate(face)], "face long, corner int, node long")
    return n, f, np.array(nodes), faces


def plain_clip(subject, window):
    """One polygon at a time, as the textbook has it."""
    for a, b in zip(window, np.roll(window, -1, axis=0)):
        n, out = np.cross(a, b), []
        for p, q in zip(subject, np.roll(subject, -1, axis=0)):
            s, t = p @ n, q @ n
            if s >= 0:
                out.append(p)
            if s * t < 0:
                m = p + (q - p) * s / (s - t)
                out.append(m / np.linalg.norm(m))
        subject = np.array(out).reshape(-1, 3)
        if len(subject) < 3:
            return 0.0
    return float(areas(subject[None], True)[0])


def test_clipping_against_one_polygon_at_a_time():
    rng = np.random.default_rng(0)
    made = []
    for _ in range(400):
        c, r, k = rng.normal(size=3), rng.uniform(0.01, 0.6), rng.integers(3, 7)
        c /= np.linalg.norm(c)
        e = np.cross(c, [1.0, 0.3, 0.2])
        e /= np.linalg.norm(e)
        angle = np.sort(rng.uniform(0, 2 * np.pi, k))
        made.append((c + r * (np.cos(angle)[:, None] * e + np.sin(angle)[:, None] * np.cross(c, e))) / np.linalg.norm(c + r * (np.cos(angle)[:, None] * e + np.sin(angle)[:, None] * np.cross(c, e)), axis=1)[:, None])
    pad = lambda p: np.concatenate([p, np.repeat(p[-1:], 6 - len(p), axis=0)])
    for shift in (1, 7, 50):
        a = turned(np.stack([pad(p) for p in made]), True)
        b = np.roll(a, shift, axis=0) * 0.3 + a  # beside one another, mostly
        b = turned(b / np.linalg.norm(b, axis=2, keepdims=True), True)
        hull = np.array([np.allclose(plain_clip(w, w), areas(w[None], True)[0]) for w in b])
        got = areas(clipped(a, b, True), True)
        for k in np.flatnonzero(hull):
            assert abs(got[k] - plain_clip(a[k], b[k])) < 1e-12


def test_areas_of_octants_and_small_cells():
    octant = vectors(np.array([0, 90, 0]), np.array([0, 0, 90]))[None]
    assert abs(areas(octant, True)[0] - np.pi / 2) < 1e-14
    d = 1e-5
    small = vectors(np.array([10, 10 + d, 10 + d, 10]), np.array([40, 40, 40 + d, 40 + d]))[None]
    assert abs(areas(small, True)[0] / (math.radians(d) * (math.sin(math.radians(40 + d)) - math.sin(math.radians(40)))) - 1) < 1e-6


def test_conservative_between_rotated_grids_keeps_the_total_and_constants(spark):
    src, _ = grid(spark, 12, 20, 35)
    dst, _ = grid(spark, 9, 14, -50)
    w = sphere.conservative_weights(src, dst).toPandas()
    area = {}
    for g, n in ((src, "src"), (dst, "dst")):
        rows = g.cells.collect()
        area[n] = {r.cell: abs(areas(np.array([[tuple(p) for p in r.v]]), True)[0]) for r in rows}
        assert abs(sum(area[n].values()) - 4 * np.pi) < 1e-11
    w["a"] = w.w * w.dst.map(area["dst"])
    assert abs(w.groupby("src").a.sum() - np.array([area["src"][k] for k in sorted(area["src"])])).max() < 1e-12
    assert abs(w.groupby("dst").w.sum() - 1).max() < 1e-10
    x = spark.createDataFrame([(c, math.sin(c)) for c in area["src"]], "cell long, x double")
    got = {r.cell: r.x for r in sphere.regrid(x, [], "x", src, dst, "conservative").collect()}
    total = lambda a, v: sum(a[c] * v[c] for c in a)
    assert abs(total(area["dst"], got) - total(area["src"], {c: math.sin(c) for c in area["src"]})) < 1e-9
    assert "CartesianProduct" not in (plan := sphere.conservative_weights(src, dst)._jdf.queryExecution().toString()) and "NestedLoop" not in plan


def test_brute_force_of_weights_with_cells_of_many_sizes(spark):
    """Large and tiny cells, at the poles too: the same pairs as of all with all."""
    n, f, nodes, faces = mesh_tables(spark, 1)
    src = sphere.mesh(f, n)
    small = [(k, c, lon + dx, lat + dy) for k, (lon, lat) in enumerate([(0.0, 89.99), (45.0, 0.0), (180.0, -0.001), (359.999, 30.0), (120.0, -89.0)] * 3) for c, (dx, dy) in enumerate(((0, 0), (10.0 ** -(k % 5), 0), (10.0 ** -(k % 5), 10.0 ** -(2 + k % 4)), (0, 10.0 ** -(2 + k % 4))))]
    cells = spark.createDataFrame([(0, k, c, x, y) for k, c, x, y in small], "j int, i int, k int, lon double, lat double")
    dst = sphere.curvilinear(cells.where("k = 0"), "j", "i", 15, bounds=cells)
    got = {(r.dst, r.src): r.w for r in sphere.conservative_weights(src, dst).collect()}
    for k in range(15):
        window = turned(vectors(np.array([x for q, _, x, _ in small if q == k]), np.array([y for q, _, _, y in small if q == k]))[None], True)[0]
        whole = areas(window[None], True)[0]
        for s, face in enumerate(faces):
            part = plain_clip(turned(nodes[list(face)][None], True)[0], window) / whole
            assert abs(got.get((k, s), 0.0) - part) < 1e-5, (k, s)


@pytest.mark.parametrize("location", ["node", "face"])
def test_linear_from_meshes(spark, location):
    n, f, nodes, faces = mesh_tables(spark, 3)
    src = sphere.mesh(f, n, location)
    dst, at = grid(spark, 6, 8, 20)
    places = nodes if location == "node" else np.array([nodes[list(x)].sum(axis=0) / np.linalg.norm(nodes[list(x)].sum(axis=0)) for x in faces])
    field = lambda v: 1 + v[..., 0] * 2 - v[..., 1] + v[..., 2] * 3
    x = spark.createDataFrame([(k, float(v)) for k, v in enumerate(field(places))], "cell long, x double")
    w = sphere.linear_weights(src, dst).toPandas()
    assert set(w.dst) == set(range(48)) and abs(w.groupby("dst").w.sum() - 1).max() < 1e-12 and w.w.min() > 0
    got = {r.cell: r.x for r in sphere.regrid(x, [], "x", src, dst, "linear").collect()}
    assert max(abs(got[k] - v) for k, v in enumerate(field(vectors(at[:, 0], at[:, 1])))) < 0.04
    back = sphere.regrid(x, [], "x", src, sphere.mesh(f, n, location), "linear").collect()
    if location == "node":
        assert all(abs(r.x - field(places[r.cell])) < 1e-9 for r in back)
    # One missing value is missing wherever it has a weight.
    gone = w.src.iloc[0]
    holes = sphere.regrid(x.withColumn("x", F.when(F.col("cell") != int(gone), F.col("x"))), [], "x", src, dst, "linear")
    assert {r.cell for r in holes.collect() if r.x is None} == set(w.dst[w.src == gone])


def test_bilinear_between_curvilinear_grids(spark):
    src, at = grid(spark, 18, 36, 30)
    dst, to = grid(spark, 7, 9, -15)
    field = lambda v: 1 + v[:, 0] * 2 - v[:, 1] + v[:, 2] * 3
    x = spark.createDataFrame([(k, float(v)) for k, v in enumerate(field(vectors(at[:, 0], at[:, 1])))], "cell long, x double")
    rows = sphere.regrid(x, [], "x", src, dst, "linear").collect()
    want = field(vectors(to[:, 0], to[:, 1]))
    # The caps around the tilted pole have no element; all else is there.
    assert sum(r.x is None for r in rows) <= 2 and all(r.x is None or abs(r.x - want[r.cell]) < 0.05 for r in rows)
    w = sphere.linear_weights(src, dst).toPandas()
    assert abs(w.groupby("dst").w.sum() - 1).max() < 1e-9


@pytest.mark.parametrize("spherical", [True, False])
def test_nearest_against_all_distances(spark, spherical):
    rng = np.random.default_rng(4)
    def some(n):
        if spherical:
            return np.concatenate([np.stack([rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))], 1), np.stack([rng.normal(10, 0.01, n), rng.normal(50, 0.01, n)], 1), [[0, 90], [77, -90], [359.9999, 0]]])
        return np.concatenate([rng.uniform(-5, 90, (n, 2)), rng.normal(20, 0.01, (n, 2))])
    a, b = some(150), some(60)
    b = np.concatenate([b, b[:5]])
    frames = [spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p)], "cell long, lon double, lat double") for p in (a, b)]
    pa, pb = (sphere.places(f, "cell", spherical=spherical) for f in frames)
    got = {r.cell: r.other for r in sphere.nearest(pa.points, pb.points, spherical).collect()}
    va, vb = (vectors(p[:, 0], p[:, 1]) if spherical else p for p in (a, b))
    d = np.linalg.norm(va[:, None] - vb[None], axis=2)
    assert len(got) == len(a) and all(d[k, got[k]] <= d[k].min() + 1e-12 for k in got)
    assert all(got[k] == np.flatnonzero(d[k] == d[k].min())[0] for k in got)
    assert sphere.nearest(pa.points, pb.points.limit(0), spherical).count() == 0 and sphere.nearest(pa.points.limit(0), pb.points, spherical).count() == 0


def plane_grid(spark, nj, ni):
    at = lambda j, i: (i + 0.3 * j, 2.0 * j - 0.2 * i)
    coords = [(j, i, *at(j, i)) for j in range(nj) for i in range(ni)]
    return sphere.curvilinear(spark.createDataFrame(coords, "j int, i int, x double, y double"), "j", "i", ni, "x", "y", spherical=False), coords


def test_patch_reproduces_a_quadratic_surface(spark):
    src, coords = plane_grid(spark, 8, 9)
    f = lambda x, y: 1 + 2 * x - y + 0.5 * x * x - 0.3 * x * y + 0.2 * y * y
    rows = spark.createDataFrame([(j * 9 + i, f(x, y)) for j, i, x, y in coords], "cell long, x double")
    rng = np.random.default_rng(2)
    to = [(k, float(i + 0.3 * j), float(2 * j - 0.2 * i)) for k, (j, i) in enumerate(rng.uniform([0, 0], [7, 8], (60, 2)))]
    dst = sphere.places(spark.createDataFrame(to + [(99, 500.0, 0.0)], "cell long, x double, y double"), "cell", "x", "y", False)
    got = {r.cell: r.x for r in sphere.regrid(rows, [], "x", src, dst, "patch").collect()}
    assert all(abs(got[k] - f(x, y)) < 1e-8 for k, x, y in to) and got[99] is None
    # On the sphere the error falls with the third power of the spacing, and linear weights' with the second.
    worst = {}
    for levels in (2, 3):
        n, fs, nodes, _ = mesh_tables(spark, levels)
        mesh, (d, at) = sphere.mesh(fs, n, "node"), grid(spark, 6, 8, 20)
        field = lambda v: v[..., 0] * v[..., 1] + v[..., 2] ** 2
        x = spark.createDataFrame([(k, float(v)) for k, v in enumerate(field(nodes))], "cell long, x double")
        want = field(vectors(at[:, 0], at[:, 1]))
        for method in ("patch", "linear"):
            worst[method, levels] = max(abs(r.x - want[r.cell]) for r in sphere.regrid(x, [], "x", mesh, d, method).collect())
    assert worst["patch", 3] < worst["linear", 3] / 3 and worst["patch", 3] < worst["patch", 2] / 4


def test_other_shapes_and_odd_input(spark):
    n, f, _, faces = mesh_tables(spark, 1)
    mesh = sphere.mesh(f, n)
    hp = sphere.healpix(spark.range(12 * 16).withColumnRenamed("id", "cell"), "cell", 2)
    w = sphere.conservative_weights(mesh, hp).toPandas()
    assert abs(w.groupby("dst").w.sum() - 1).max() < 1e-9 and set(w.dst) == set(range(192))
    axis = lambda n, low, size: spark.createDataFrame([(k, low + size * (k + 0.5), low + size * k, low + size * (k + 1)) for k in range(n)], "i int, coord double, lower double, upper double")
    rect = sphere.rectilinear(axis(8, 0.0, 45.0), axis(6, -90.0, 30.0), 8, cyclic=True)
    x = spark.createDataFrame([(g, k, float(k) if k % 3 else None) for g, k in product("ab", range(len(faces)))], "g string, cell long, x double")
    rows = sphere.regrid(x, ["g"], "x", mesh, rect, "conservative").collect()
    # A cell is missing only where all faces that it meets are.
    met = {(r.dst, r.src) for r in sphere.conservative_weights(mesh, rect).collect()}
    assert len(rows) == 96 and all((r.x is None) == all(s % 3 == 0 for d, s in met if d == r.cell) for r in rows)
    dtos = sphere.regrid(x, ["g"], "x", mesh, rect, "nearest_dtos", full=False).collect()
    assert len(dtos) > 20
    for method, bad in (("conservative", sphere.places(n, "node")), ("linear", sphere.places(n, "node"))):
        with pytest.raises(ValueError):
            sphere.operator(bad, rect, method)
    with pytest.raises(ValueError):
        sphere.operator(mesh, plane_grid(spark, 3, 3)[0], "linear")
    with pytest.raises(ValueError):
        sphere.operator(mesh, rect, "cubic")
    missing = spark.createDataFrame([(0, 0, None, 1.0), (0, 1, 5.0, 5.0)], "j int, i int, lon double, lat double")
    assert sphere.curvilinear(missing, "j", "i", 2).points.count() == 1


def test_points_in_three_dimensions(spark):
    """Soundings between levels of a curvilinear grid, linear in height and in the logarithm of pressure."""
    src, coords = plane_grid(spark, 5, 6)
    levels = [1000.0, 850.0, 500.0, 200.0, 50.0]
    field = lambda x, y, z: 2 * x - y + 3 * z
    rng = np.random.default_rng(5)
    to = [(n, float(i + 0.3 * j), float(2 * j - 0.2 * i), float(z)) for n, (j, i, z) in enumerate(rng.uniform([0, 0, 60], [4, 5, 990], (40, 3)))]
    to += [(100, 0.0, 0.0, 1000.0), (101, 0.0, 0.0, 50.0), (102, 0.0, 0.0, 500.0), (103, 0.0, 0.0, 40.0), (104, 0.0, 0.0, 1001.0), (105, 0.0, 0.0, None), (106, -9.0, 0.0, 500.0), (107, 0.0, 0.0, 700.0)]
    places = spark.createDataFrame(to, "cell long, x double, y double, z double")
    dst = sphere.places(places, "cell", "x", "y", spherical=False)
    axis = spark.createDataFrame(list(enumerate(levels)), "k int, z double")
    for ln_z in (False, True):
        up = math.log if ln_z else (lambda z: z)
        rows = spark.createDataFrame([(j * 6 + i, k, field(x, y, up(z))) for j, i, x, y in coords for k, z in enumerate(levels)], "cell long, k int, v double")
        got = {r.cell: r.v for r in sphere.regrid_levels(rows, [], "v", src, dst, axis, places.select("cell", "z"), ln_z=ln_z).collect()}
        for n, x, y, z in to:
            if n in (103, 104, 105, 106):
                assert got[n] is None
            else:
                assert abs(got[n] - field(x, y, up(z))) < 1e-9, (n, ln_z)
    # Heights that differ from place to place, and a missing value in one corner.
    own = spark.createDataFrame([(j * 6 + i, k, z + 3.0 * i) for j, i, _, _ in coords for k, z in enumerate(levels)], "cell long, k int, z double")
    rows = own.withColumn("v", F.when((F.col("cell") != 0) | (F.col("k") != 1), F.col("z") * 2))
    got = {r.cell: r.v for r in sphere.regrid_levels(rows.select("cell", "k", "v"), [], "v", src, dst, own, places.select("cell", "z")).collect()}
    assert all(got[n] is None or abs(got[n] - 2 * z) < 1e-9 for n, _, _, z in to if z is not None) and sum(v is None for v in got.values()) < 12 and got[107] is None and got[102] == 1000.0


def test_cubes_on_two_dimensional_coordinates(spark):
    from gridloom.operators.cube import Axis, Cube

    src, coords = plane_grid(spark, 5, 6)
    rows = spark.createDataFrame([(t, j, i, x + 10 * y + t) for t in (0, 1) for j, i, x, y in coords], "i_t int, i_j int, i_i int, v double")
    cube = Cube(rows, {"t": Axis("t", 2), "j": Axis("j", 5), "i": Axis("i", 6)}, "v")
    dst = sphere.places(spark.createDataFrame([(7, 1.55, 2.8)], "cell long, x double, y double"), "cell", "x", "y", False)
    got = {r.i_t: r.v for r in cube.regrid_cells(["j", "i"], src, dst).collect()}
    assert got == pytest.approx({0: 29.55, 1: 30.55})


def test_sides_that_grow_are_not_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(40).select(F.col("id").alias("cell"), sphere.vector(F.col("id") * 7 % 40, F.col("id") * 3 % 20, False).alias("p"))
    assert "Broadcast" not in plan(sphere.nearest(rows, rows, False))
    cells = spark.range(40).select(F.floor(F.col("id") / 8).alias("j"), (F.col("id") % 8).alias("i"))
    corners = F.array(*[F.struct((F.col("i") + b).alias("lon"), (F.col("j") + a).alias("lat")) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0))])
    bounds = cells.select("j", "i", F.posexplode(corners).alias("k", "e")).select("j", "i", "k", "e.*")
    grid = sphere.curvilinear(cells.select("j", "i", F.col("i").alias("lon"), F.col("j").alias("lat")), "j", "i", 8, bounds=bounds, spherical=False)
    data = spark.range(40).select(F.col("id").alias("cell"), F.col("id").cast("double").alias("v"))
    for method in ("conservative", "linear", "nearest_stod"):
        got = sphere.regrid(data, [], "v", grid, grid, method)
        assert "Broadcast" not in plan(got)
        assert {r["cell"]: r["v"] for r in got.collect()} == pytest.approx({k: float(k) for k in range(40)})


def test_a_file_of_one_partition_is_dealt_out(spark):
    rows = spark.range(40).coalesce(1).select(F.col("id").alias("cell"), F.array(sphere.vector(F.col("id"), F.col("id"), False)).alias("v"))
    assert sphere._spread(rows).rdd.getNumPartitions() >= 3


def test_zeros_need_no_rows(spark, monkeypatch):
    """As regrid of every brand's zeros gives it; each weight is met once and by the rows that there are, not once for every brand."""
    w = spark.createDataFrame([(0, 0, 0.25), (0, 1, 0.75), (1, 1, 0.5), (1, 2, 0.25), (2, 3, 1.0)], "dst long, src long, w double")
    monkeypatch.setattr(sphere, "operator", lambda *a: sphere.RegridOperator("conservative", {"cell": w}))
    rows = [("a", 0, 4.0), ("b", 1, 8.0), ("a", 2, None), (None, 2, 3.0)]
    df = spark.createDataFrame(rows, "brand string, cell long, v double")
    sums, real = [], sphere.written
    monkeypatch.setattr(sphere, "written", lambda t, label: sums.append(real(t, label)) or sums[-1])
    got = {(r.brand, r.cell): r.v for r in sphere.regrid_sparse(df, ["brand"], "v", None, None).collect()}
    filled = [(b, c, next((v for x, y, v in rows if (x, y) == (b, c) and v is not None), 0.0)) for b in ("a", "b", None) for c in range(4)]
    full = {(r.brand, r.cell): r.v for r in sphere.regrid(spark.createDataFrame(filled, df.schema), ["brand"], "v", None, None, "conservative", full=False).collect()}
    assert got == {k: pytest.approx(full[k]) for k in got} and {k for k, v in full.items() if v} <= set(got)
    assert sums[0].where("NOT __whole").count() == len(got) < len(full)


def test_apart_loses_no_overlap():
    rng = np.random.default_rng(3)
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    at = lambda n: np.concatenate([square * rng.uniform(0.2, 1.5, (n, 1, 2)) + rng.uniform(-1.5, 1.5, (n, 1, 2)), np.ones((n, 4, 1))], axis=2)
    v, window = at(500), at(500)
    flat = np.abs(sphere.areas(sphere.clipped(v, window, False), False))
    unit = lambda x: x / np.linalg.norm(x, axis=2, keepdims=True)
    round_ = np.abs(sphere.areas(sphere.clipped(unit(v), unit(window), True), True))
    gone = sphere.apart(v, window)
    assert 50 < gone.sum() and flat[gone].max() < 1e-15 and round_[sphere.apart(unit(v), unit(window))].max() < 1e-15
