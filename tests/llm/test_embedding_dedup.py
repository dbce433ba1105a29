import math

import numpy as np

from gridloom.llm.embedding_dedup import near_duplicates, sketch_distance, tables_and_bits


def test_against_brute_force_with_hot_groups(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 24))
    vectors = [*base, *(base[rng.integers(0, 60, 200)] + 0.12 * rng.standard_normal((200, 24))), *(base[0] * rng.uniform(0.1, 9, (300, 1)) + 0.05 * rng.standard_normal((300, 24))), *[base[1]] * 40]
    ids = rng.permutation(len(vectors)).tolist()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, n_links int")
    rows = {r.vec_id: r for r in near_duplicates(df, block=64).collect()}
    order = np.argsort(ids)
    x = np.array(vectors)[order]
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(label, np.where(near, label[None], len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    for i in range(len(x)):
        assert (rows[i].n_links, rows[i].component_id, rows[i].kept) == (near[i].sum(), label[i], label[i] == i)


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e300, 0.0]), (2, [3.0, 0.0])]
    rows = near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows if r.vec_id is not None)
    assert got == [(1, 3, 1, True), (2, 4, 1, False), (2, 4, 1, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)], (10, 3, 1, False)]
    assert [(r.n_links, r.component_id, r.kept) for r in rows if r.vec_id is None] == [(0, None, False)]
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_copies_are_one_item(spark):
    """5,000 copies of one vector and rows of one repeated id: counted, and never paired with one another."""
    v, w = [1.0, 0.5, 0.25, 0.0], [1.0, 0.5, 0.26, 0.0]
    data = [(i, v) for i in range(5000)] + [(-1, w)] + [(-5, v)] * 3000 + [(7000, [0.0, 0.0, 0.0, 1.0])]
    rows = near_duplicates(spark.createDataFrame(data, "`a.id` long, `v.v` array<float>").selectExpr("*", "1 AS mark", "2 AS cell"), id_col="a.id", vector_col="v.v", block=64).collect()
    assert len(rows) == len(data)
    for r in rows:
        if r.vec_id == 7000:
            assert (r.n_links, r.component_id, r.kept) == (0, 7000, True)
        else:
            want = {-1: 8000, -5: 3000 * 5001}.get(r.vec_id, 4999 + 1 + 3000)
            assert (r.n_links, r.component_id, r.kept) == (want, -5, r.vec_id == -5)


def test_missed_pairs_stay_rare():
    assert sum(math.comb(128, k) * (p := math.acos(0.95) / math.pi) ** k * (1 - p) ** (128 - k) for k in range(sketch_distance() + 1)) > 1 - 1e-5
    assert sketch_distance() < 40
    for n in (10, 10**5, 10**9):
        tables, bits = tables_and_bits(n)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= 5e-4
