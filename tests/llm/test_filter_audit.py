from collections import Counter
from itertools import permutations

import pytest

from gridloom.llm.filter_audit import FILTERS, failed, failures, interactions

COPIES = [(i, "the same text " * 30, "en") for i in range(400)]
ODD = [
    (1000, "", "en"), (1001, None, None), (1002, "", ""), (None, "", "en"), (None, "the same text " * 30, "de"), (None, "only here", "de"), (None, "only here", "de"),
    (0, "the same text " * 30, "fr"), (0, "the same text " * 30, None), (1003, "a b é$ " * 90, "fr"), (1004, "X" * 300_000, "de"), (1004, "X" * 300_000, "de"), (1005, "X" * 300_000 + "y", "de"),
    (1006, " ".join(f"w{i}" for i in range(120)), "en"), (1007, " ".join(f"W{i}" for i in range(120)), "en"), (1008, "w " * 100 + "\x0b\x0c", "fr"),
]
LABELS = [(0, 1, 1), (0, 0, 0), (5, 1, 0), (6, 0, 1), (None, 1, 1), (1002, None, 1), (1006, 1, None), (10**9, 1, 1)]


def plain(rows):
    """The definition, row by row."""
    found = []
    for i, text, part in rows:
        t = text or ""
        copies = [j for j, u, _ in rows if (u or "") == t and j is not None and (i is None or j < i)]
        found.append((i, part or "", failed(t) + ("E" if copies else "")))
    return found


def audit(marks, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p for _, p, _ in marks}:
        rows = [(i, f) for i, p, f in marks if p == part]
        removed = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                removed[letter] += len(gone)
                failing = sum(letter in f for _, f in rows)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(f == letter for _, f in rows), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return out


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_against_every_order_played_through(spark, partitions):
    rows = COPIES + ODD
    docs = spark.createDataFrame([(*r, 9, 8, 7) for r in rows], "doc_id long, text string, lang string, fp int, `a.b` int, run int").repartition(7)
    labels = spark.createDataFrame([(*r, 5) for r in LABELS], "doc_id long, quality int, toxic int, n int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        marks = failures(docs)
        assert Counter((r.id, r.part, r.fails) for r in marks.collect()) == Counter(plain(rows))
        got = interactions(marks, labels, "ABCDE").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = audit(plain(rows), LABELS)
    assert len(got) == len(want) == 120 * 5 * 4
    assert all([r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step] for r in got)


def test_texts_that_share_a_fingerprint_are_told_apart():
    import pyarrow as pa

    from gridloom.llm.filter_audit import _marker

    rows = [(7, "a", 1), (7, "a", 2), (7, "b", 1), (7, "b", 1), (7, "b", 5), (9, "c", 4), (9, "c", 4), (9, "d", 2), (9, "d", 3)]
    names = ["fp", "text", "null_id", "id", "part", "pid"]
    for cut in range(1, len(rows) + 1):
        batches = [pa.RecordBatch.from_pylist([{"fp": f, "text": t, "null_id": False, "id": i, "part": "", "pid": 3} for f, t, i in part]).select(names) for part in (rows[:cut], rows[cut:]) if part]
        out = [r for b in _marker({}, "E")(batches) for r in b.to_pylist()]
        assert [(r["id"], r["fails"]) for r in out if not r["end"]] == [(i, "E" if k in (1, 4, 8) else "") for k, (_, _, i) in enumerate(rows)]
        assert [(r["fp"], r["text"], r["id"]) for r in out if r["end"]] == [(7, "a", 1), (7, "b", 1), (9, "c", 4), (9, "d", 2)]
        assert [r["run"] for r in out if not r["end"]] == [0, None, 1, 1, None, None, None, None, None]


def test_edges_of_the_filters():
    words = [f"w{i}" for i in range(100)]
    assert failed(" ".join(words)) == "" and failed(" ".join(words[:99])) == "A"
    assert failed(" ".join(words[:80] + words[:20])) == "" and failed(" ".join(words[:79] + words[:21])) == "B"
    assert failed("") == "A" and failed("ÉÀ|" * 5) == "AD" and failed(" ".join(["Abcdefgh"] + words)) == ""
    assert "C" in failed("A" + "b" * 8) and "C" not in failed("A" + "b" * 9)
    assert list(FILTERS) == ["A", "B", "C", "D"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions(failures(docs), labels, "ABCDE").count() == 0
    one = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")
    assert {(r.part, r.removed, r.good_lost) for r in interactions(failures(one), labels, "ABCDE").where("step = 1").collect()} == {("", 1, 0), ("", 0, 0)}
