import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from gridloom.llm.katz import K, discounts, score


def brute(docs):
    """A plain model: docs (id, text, train) -> rows, and the sums of probabilities after each history."""
    texts = [(i, (t or "").encode().lower().split() + [b""], bool(f)) for i, t, f in docs]
    one, two = Counter(), Counter()
    for _, w, f in texts:
        if f:
            one.update(w)
            two.update(zip([b""] + w[:-1], w))
    n, counts = sum(one.values()), lambda c: [0, *[Counter(c.values())[r] for r in range(1, K + 2)]]
    d1, d2 = discounts(counts(one)), discounts(counts(two))
    cut = lambda d, c: d[c] * c if c <= K else c
    freed = n - sum(cut(d1, c) for c in one.values())
    whole, freed = (n, freed) if any(c <= K and d1[c] < 1 for c in one.values()) else (n + 1, 1)
    low = lambda w: cut(d1, one[w]) / whole if w in one else freed / whole
    after = defaultdict(dict)
    for (v, w), c in two.items():
        after[v][w] = c
    level = {}
    for v, f in after.items():
        left, all_ = one[v] - sum(cut(d2, c) for c in f.values()), one[v]
        if not any(c <= K and d2[c] < 1 for c in f.values()):
            left, all_ = 1, one[v] + 1
        level[v] = (all_, left / all_ / (1 - sum(low(w) for w in f)))

    def p(v, w):
        if v not in level:
            return low(w)
        return cut(d2, after[v][w]) / level[v][0] if w in after[v] else level[v][1] * low(w)

    rows = sorted((str(i), not f, len(w), sum(x in one for x in w), n, sum(math.log10((one[x] + 1) / (n + len(one) + 1)) for x in w), sum(math.log10(p(v, x)) for v, x in zip([b""] + w[:-1], w))) for i, w, f in texts)
    return rows, [sum(p(v, w) for w in one) + p(v, b"\0never") for v in [*after, b"\0never"]]


def agree(spark, docs):
    df = spark.createDataFrame([(i, t, f, 0.0) for i, t, f in docs], "doc_id long, text string, train boolean, score double")
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in score(df).collect())
    want, sums = brute(docs)
    assert all(abs(s - 1) < 1e-9 for s in sums)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-6


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_model(spark, seed):
    random.seed(seed)
    words = [f"W{int(random.paretovariate(0.6))}" for _ in range(3000)] + ["hot"] * 3000
    docs = [(i, " ".join(random.choices(words, k=random.randint(0, 80))), zlib.crc32(str(i).encode()) % 7 != 2) for i in range(300)]
    agree(spark, [*docs, (None, "hot x", False), (3, "hot HOT\x0bhot", True), (900, None, True), (901, "", None)])


def test_tiny_and_empty(spark):
    agree(spark, [(1, "a", True), (2, "b a", False)])
    agree(spark, [(1, "a a a a a a a a a a a a", True)] * 8)
    df = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, train boolean")
    r = score(df).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert score(df.limit(0)).count() == 0


def brute3(docs):
    """The plain model with triples: docs -> (id, score) rows, and the sums of probabilities after seen and unseen histories."""
    texts = [(i, (t or "").encode().lower().split() + [b""], bool(f)) for i, t, f in docs]
    one, two, three = Counter(), Counter(), Counter()
    for _, w, f in texts:
        if f:
            one.update(w)
            two.update(zip([b""] + w[:-1], w))
            three.update(zip([b""] + w[:-2], w[:-1], w[1:]))
    counts = lambda c: [0, *[Counter(c.values())[r] for r in range(1, K + 2)]]
    d1, d2, d3 = (discounts(counts(c)) for c in (one, two, three))
    cut = lambda d, c: d[c] * c if c <= K else c

    def level(total, seen, d, lower):
        """(what counts are divided by, alpha)"""
        left = total - sum(cut(d, c) for c in seen.values())
        if not any(c <= K and d[c] < 1 for c in seen.values()):
            left, total = 1, total + 1
        return total, left / total / (1 - sum(map(lower, seen)))

    whole, free = sum(one.values()), sum(one.values()) - sum(cut(d1, c) for c in one.values())
    if not any(c <= K and d1[c] < 1 for c in one.values()):
        whole, free = whole + 1, 1
    low = lambda w: cut(d1, one[w]) / whole if w in one else free / whole
    after, after2 = defaultdict(dict), defaultdict(dict)
    for (v, w), c in two.items():
        after[v][w] = c
    for (u, v, w), c in three.items():
        after2[u, v][w] = c
    levels = {v: level(one[v], f, d2, low) for v, f in after.items()}

    def mid(v, w):
        if v not in after:
            return low(w)
        return cut(d2, after[v][w]) / levels[v][0] if w in after[v] else levels[v][1] * low(w)

    levels2 = {(u, v): level(two[u, v], f, d3, lambda w, v=v: mid(v, w)) for (u, v), f in after2.items()}

    def p(u, v, w):
        if (u, v) not in after2:
            return mid(v, w)
        return cut(d3, after2[u, v][w]) / levels2[u, v][0] if w in after2[u, v] else levels2[u, v][1] * mid(v, w)

    rows = sorted((str(i), sum(math.log10(p(*x) if k else mid(*x[1:])) for k, x in enumerate(zip([b"", b""] + w[:-2], [b""] + w[:-1], w)))) for i, w, f in texts)
    some = [*after2][:300]
    return rows, [sum(p(u, v, w) for w in one) + p(u, v, b"\0never") for u, v in [*some, (b"\0never", b"hot")]]


@pytest.mark.parametrize("seed", [1, 2])
def test_triples_against_plain_model(spark, seed):
    random.seed(seed)
    words = [f"W{int(random.paretovariate(0.6))}" for _ in range(3000)] + ["hot", "pair"] * 2000
    docs = [(i, " ".join(random.choices(words, k=random.randint(0, 80))), zlib.crc32(str(i).encode()) % 7 != 2) for i in range(300)]
    docs += [(None, "hot x", False), (3, "hot HOT\x0bhot", True), (900, None, True), (901, "", None), (902, "hot pair hot pair hot", False)]
    for some in (docs, [(1, "a", True), (2, "b a", False)], [(1, "a a a a a a a a a a a a", True)] * 8, [(1, "a b c", False)]):
        got = sorted((str(r.doc_id), r.score) for r in score(spark.createDataFrame(some, "doc_id long, text string, train boolean"), order=3).collect())
        want, sums = brute3(some) if any(f for _, _, f in some) else ([("1", 0.0)], [])
        assert all(abs(s - 1) < 1e-9 for s in sums)
        assert len(got) == len(want) and all(g[0] == w[0] and abs(g[1] - w[1]) < 1e-6 for g, w in zip(got, want))
    assert score(spark.createDataFrame([], "doc_id long, text string, train boolean"), order=3).count() == 0
