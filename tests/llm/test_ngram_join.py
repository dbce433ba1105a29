import collections
import random

import numpy as np
import pytest

from gridloom.llm import ngram_join
from gridloom.llm.ngram_join import near_duplicate_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets, where = collections.defaultdict(list), collections.defaultdict(set)
    for i, t in docs:
        sets[i].append(shingles(t))
        for x in sets[i][-1]:
            where[x].add(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in {j for s in sets[i] for x in s for j in where[x] if j > i}:
            if any(100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j] if a and b):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}, {i: {len(s) for s in x} for i, x in sets.items()}


def agree(spark, docs):
    rows = near_duplicate_components(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, component_id int")).collect()
    component, sizes = brute(docs)
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    for r in rows:
        assert r.component_id == component[r.doc_id] and r.n_shingles in sizes[r.doc_id]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(40)]
    base = [[random.choice(words) for _ in range(random.randint(3, 60))] for _ in range(25)]
    common, docs = [random.choice(words) for _ in range(30)], []
    for k in range(500):
        b = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, 5])):
            if b:
                b[random.randrange(len(b))] = random.choice(words)
        if random.random() < 0.3:
            b += common
        if random.random() < 0.2:
            b = b[: random.randint(0, len(b))]
        docs.append((k, " ".join(b)))
    docs += [(5000, None), (5001, ""), (5002, "  \n"), (5003, "One two"), (5004, "one TWO"), (3, docs[77][1]), (3, docs[3][1])]
    agree(spark, docs)


def test_hot_groups(spark):
    random.seed(4)
    text = [f"a{i}" for i in range(120)]
    docs = [(i, " ".join(text)) for i in range(150)]
    for i in range(150, 300):
        t = list(text)
        t[random.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(t)))
    docs.append((400, " ".join(f"b{i}" for i in range(3000))))
    agree(spark, docs)


def test_chain_that_only_the_matrix_finds(spark):
    """Two halves that share exactly three quarters with a document between them, over many seeds of words."""
    docs = []
    for k in range(40):
        w = [f"{k}-{i}" for i in range(104)]
        docs += [(3 * k, " ".join(w[:84])), (3 * k + 1, " ".join(w[:104])), (3 * k + 2, " ".join(w[20:104]))]
    agree(spark, docs)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in near_duplicate_components(df).collect()), key=str) == [(1, 1), (None, None)]
    assert near_duplicate_components(df.limit(0)).count() == 0


def _step4(spark, monkeypatch, families, **room):
    """Links across families of two sets that share a common line, and how many sets the opened pairs of blocks are sent."""
    rng = np.random.default_rng(5)
    new = lambda k: rng.integers(0, 2**63, k, dtype=np.uint64)
    line, rows = new(10), []
    for f in range(families):
        own = new(30)
        rows += [(2 * f + k, np.unique(np.concatenate([own, line, new(2)]))) for k in (0, 1)]
    sets = spark.createDataFrame([(i, len(t), i, bytearray(ngram_join.pack(np.diff(t, prepend=np.uint64(0))))) for i, t in rows], "id long, n long, lo long, tokens binary")
    tables, real = {}, ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, label: tables.setdefault(label, []).append(real(df, label)) or tables[label][-1])
    links = ngram_join._across(sets.selectExpr("id", "id AS component"), sets, 75, **room)
    size = {r["block"]: r["count"] for r in tables["blocks"][0].groupBy("block").count().collect()}
    sent = sum(size[r["block"]] + (size[r["other"]] if r["block"] != r["other"] else 0) for r in tables["pairs"][-1].collect())
    return {tuple(sorted(r)) for r in links.collect()}, sent, len(tables.get("across", []))


def test_a_common_line_does_not_make_all_blocks_meet(spark, monkeypatch):
    links, sent, _ = _step4(spark, monkeypatch, 400)
    assert links == {(2 * f, 2 * f + 1) for f in range(400)}
    assert sent <= 2 * 800


def test_rounds_find_what_one_round_finds(spark, monkeypatch):
    links, _, rounds = _step4(spark, monkeypatch, 40, room=500)
    assert links == {(2 * f, 2 * f + 1) for f in range(40)}
    assert rounds > 3
