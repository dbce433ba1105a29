import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import overlap, sphere


def padded(polygons, k):
    v = np.stack([np.concatenate([p, np.repeat(p[-1:], k - len(p), axis=0)]) for p in polygons])
    return np.concatenate([v, np.zeros((len(v), k, 1))], axis=2)


@pytest.mark.parametrize("spherical", [True, False])
def test_blocks_give_what_clipping_gives(spherical):
    """Random polygons, equal ones, such as share a line or part of it, tiny ones, and one that isn't convex."""
    rng = np.random.default_rng(1)
    made = []
    for _ in range(60):
        angle = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 6)))
        shape = np.stack([np.cos(angle), np.sin(angle)], axis=1) * rng.choice([1e-7, 0.01, 0.1], 1) * [1, rng.choice([1, 0.02])]
        made.append(shape + rng.uniform(-0.15, 0.15, 2))
    box = np.array([[0, 0], [0.1, 0], [0.1, 0.1], [0, 0.1]])
    made += [box, box + [0.1, 0], box + [0.05, 0], box + [0, 0.03], box * 0.5, box @ np.array([[1, 1e-13], [0, 1]]), box + [0, -0.1]]
    bent = np.array([[0, 0], [0.1, 0], [0.02, 0.02], [0, 0.1]]) - 0.01
    p, q = overlap.Block(padded([*made, bent], 5)), overlap.Block(padded(made, 5))
    assert not p.convex[-1] and q.convex.all()
    got = np.zeros((len(p.v), len(q.v)))
    for few in (0, 1 << 14):
        overlap.FEW, kept = few, overlap.FEW
        try:
            for pi, qi, part in overlap.shared(p, q, [(0, 40, 0, len(q.v)), (40, len(p.v), 0, len(q.v))], spherical, False):
                got[pi, qi] = part
        finally:
            overlap.FEW = kept
        pi, qi = (a.ravel() for a in np.indices(got.shape))
        flat = [np.concatenate([b.v[i][:, :, :2], np.ones((len(i), 5, 1))], axis=2) for b, i in ((p, pi), (q, qi))]
        cut = sphere.clipped(*flat, False)
        want = sphere.areas(cut / np.linalg.norm(cut, axis=2, keepdims=True) if spherical else cut, spherical)
        assert (want > 1e-12).sum() > 200 and np.abs(got.ravel() - want).max() < 1e-14
        tiny = np.minimum(p.area[pi], q.area[qi])
        assert (np.abs(got.ravel() - want) / tiny).max() < 1e-6


def test_thin_cells_that_cross_meet_little_more_than_they_overlap():
    """Cells of 18 degrees by 0.3 to a grid about a tilted pole: areas are whole, and pairs that are looked at are in proportion to overlaps."""
    rows, width, sides = 600, 20, []
    j, i = np.divmod(np.arange(rows * width), width)
    for tilt in (0.0, 35.0):
        s, c, corners = np.sin(np.radians(tilt)), np.cos(np.radians(tilt)), []
        for a, b in ((0, 0), (0, 1), (1, 1), (1, 0)):
            lon, lat = np.radians((i + b) * 360 / width), np.radians((j + a) * 180 / rows - 90)
            x, y, z = np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)
            corners.append(np.stack([c * x + s * z, y, c * z - s * x], axis=1))
        cells = sphere.turned(np.stack(corners, axis=1), True)
        row, r, b, part, side = overlap.pieces(cells, True, 90.0, 5)
        count, places = overlap._marked(part, side)
        start = np.cumsum(count) - count
        tile = r * (1 << overlap.FINEST) + b
        order = np.argsort(tile, kind="stable")
        v = places[start[:, None] + np.minimum(np.arange(count.max()), count[:, None] - 1)][order]
        sides.append((overlap.Block(v), tile[order], row[order], np.abs(sphere.areas(cells, True))))
    (p, tp, rp, ap), (q, tq, rq, aq) = sides
    tiles = np.intersect1d(tp, tq)
    blocks = [tuple(int(n) for n in (*np.searchsorted(tp, [t, t + 1]), *np.searchsorted(tq, [t, t + 1]))) for t in tiles]
    by_p, by_q, found = np.zeros(len(ap)), np.zeros(len(aq)), 0
    for pi, qi, part in overlap.shared(p, q, blocks, True, False):
        np.add.at(by_p, rp[pi], part)
        np.add.at(by_q, rq[qi], part)
        found += (part > 1e-14).sum()
    assert np.abs(by_p - ap).max() < 1e-13 and np.abs(by_q - aq).max() < 1e-13
    assert sum((b - a) * (e - d) for a, b, d, e in blocks) < 8 * found


def test_sums_taken_where_cells_meet(spark):
    """As regrid of every brand's zeros gives it, with several rows of a cell and missing brands and values, and without a table of weights."""
    def grid(width, rows, dx, dy, low):
        cells = spark.range(width * rows).select(F.floor(F.col("id") / width).alias("j"), (F.col("id") % width).alias("i"))
        corners = F.array(*[F.struct(((F.col("i") + b) * dx + low).alias("lon"), ((F.col("j") + a) * dy + low).alias("lat")) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0))])
        bounds = cells.select("j", "i", F.posexplode(corners).alias("k", "e")).select("j", "i", "k", "e.*")
        return sphere.curvilinear(cells.select("j", "i", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat")), "j", "i", width, bounds=bounds)

    src, dst = grid(4, 6, 5.0, 0.5, 1.0), grid(3, 5, 2.0, 0.7, 1.3)
    rows = [(b, 7, c, None if c == 3 else c + 0.5 * len(b or "")) for b in ("a", "bb", None) for c in range(24) if c % 3 != len(b or "")] + [("a", 7, 2, 4.0)]
    df = spark.createDataFrame(rows, "brand string, n int, cell long, v double")
    got = {(r.brand, r.n, r.cell): r.v for r in sphere.regrid_sparse(df, ["brand", "n"], "v", src, dst).collect()}
    share = {(r.dst, r.src): r.w for r in sphere.conservative_weights(src, dst).collect()}
    want = {(b, 7, d): sum(w * sum(v or 0.0 for x, _, c, v in rows if (x, c) == (b, s)) for (e, s), w in share.items() if e == d) / sum(w for (e, _), w in share.items() if e == d) for b in ("a", "bb", None) for d in {d for d, _ in share}}
    assert len(share) > 20 and len(got) > 20 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got) and {k for k, v in want.items() if v} <= set(got)
    plan = sphere.regrid_sparse(df, ["brand"], "v", src, dst)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan
