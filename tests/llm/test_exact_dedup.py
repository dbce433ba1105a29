import hashlib
from collections import defaultdict

from gridloom.llm.common import components
from gridloom.llm.exact_dedup import exact_dedup


def test_groups_ties_and_nulls(spark):
    data = [(i, "hot " * 50) for i in range(200)] + [(300, "a"), (301, "A"), (302, "a "), (303, None), (304, ""), (305, "long" * 50_000), (306, "long" * 50_000), (300, "a"), (None, "n"), (None, "a")]
    df = spark.createDataFrame([(i, t, 7) for i, t in data], "doc_id long, text string, kept int")
    rows = exact_dedup(df).collect()
    groups = defaultdict(list)
    for i, t in data:
        groups[t or ""].append(i)
    assert len(rows) == len(data)
    for r in rows:
        own = groups[r.text or ""]
        keep = max((i for i in own if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (keep, len(own))
        assert r.kept == (r.doc_id == keep if keep is not None else True)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert exact_dedup(df.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    hub = [(1, i) for i in range(200, 400)] + [(999, i) for i in range(390, 500)]
    edges = spark.createDataFrame([*chain, *hub, (5, 5), (None, 3), (100, 101)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert set(got) == {*range(100, 181), 1, 999, *range(200, 500)}
    assert all(c == (100 if 100 <= i < 181 else 1) for i, c in got.items())
    assert components(edges.limit(0)).count() == 0


def test_any_column_name_and_long_texts(spark):
    long = "x" * 1_000_000
    df = spark.createDataFrame([(1, long, 5, 6, 7), (2, long, 5, 6, 7), (3, long + "y", 5, 6, 7)], "doc_id long, `a.text` string, __n int, size int, `row` int")
    out = exact_dedup(df, text_col="a.text")
    assert out.columns == [*df.columns, "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r["__n"], r["size"], r["row"]) for r in out.collect()) == [(1, 2, 2, False, 5, 6, 7), (2, 2, 2, True, 5, 6, 7), (3, 3, 1, True, 5, 6, 7)]
