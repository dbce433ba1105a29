from collections import Counter
from itertools import accumulate

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from gridloom.llm.common import written
from gridloom.llm.mixing import OUT_SHARDS, mix

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as score", "2 as room", "3 as `a.b`", "4 as __dropped", "5 as dropped", "6 as copy", "7 as Size", "8 as own_0", "9 as row", "10 as `Lang_Pred`", "11 as ids")
    junk = spark.createDataFrame([(10**6, None), (10**6 + 1, "!!! 42")], "doc_id long, text string")
    docs = docs.unionByName(junk, allowMissingColumns=True)
    before, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, SF), "test")
        assert after.columns == docs.columns, name
        ids, old = Counter(r.doc_id for r in after.collect()), Counter(r.doc_id for r in before.collect())
        assert set(ids) <= set(old)
        counts.append((name, sum(ids.values())))
        if name == "language_id":
            assert 10**6 not in ids and 10**6 + 1 not in ids and len(ids) >= 0.97 * (len(old) - 2)
        if name == "exact_dedup":
            assert len(ids) == after.select("text").distinct().count() == before.select("text").distinct().count()
        if name == "mixing":
            assert max(ids.values()) <= 2 and abs(sum(len(r.text.split()) for r in after.collect()) / sum(len(r.text.split()) for r in before.collect()) - 1.5) < 0.05
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert len(last) == counts[-1][1] and all(len(r.ids) == r.n_tokens for r in last)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test")
        assert docs.count() == 0


def test_exact_stage_leaves_one_row_of_ties(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (2, "a", "y"), (2, "a", "y"), (None, "a", "z"), (None, "n", "x"), (None, "n", "x"), (None, "n", "y"), (None, None, "x"), (None, "", "x"), (7, "b", "x"), (7, "c", "x"), (None, "d", "x")]
    docs = spark.createDataFrame([(*r, True) for r in rows * 3], "doc_id long, text string, source string, kept boolean")
    after = corpus_pipeline.exact(spark, docs, SF)
    assert after.columns == docs.columns
    got = [(r.doc_id, r.text or "") for r in after.collect()]
    assert sorted(got, key=str) == sorted([(2, "a"), (None, "n"), (None, ""), (7, "b"), (7, "c"), (None, "d")], key=str)
    assert sorted(map(str, after.collect())) == sorted(map(str, corpus_pipeline.exact(spark, docs.repartition(5), SF).collect()))


@pytest.mark.parametrize("count", ["4", "20"])
def test_files_of_the_mix_hold_one_shard_in_key_order(spark, tmp_path, count):
    docs = spark.createDataFrame([(i, f"s{i % 3}", " ".join(["w"] * (i % 40))) for i in range(900)], "doc_id long, source string, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", count)
    try:
        corpus_pipeline.mixed(spark, docs, SF).write.parquet(f"{tmp_path}/out")
        copies = sorted((c.shard, c.key, r.doc_id) for r in mix(docs).collect() for c in r.copies)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    files = [pq.read_table(f).column("doc_id").to_pylist() for f in sorted((tmp_path / "out").glob("part-*.parquet"))]
    files = [f for f in files if f]
    assert [i for f in files for i in f] == [i for _, _, i in copies]
    ends = set(accumulate(map(len, files)))
    assert {c[0] for c in copies} == set(range(OUT_SHARDS)) and set(accumulate(Counter(c[0] for c in copies)[s] for s in range(OUT_SHARDS))) <= ends
    assert len(files) == OUT_SHARDS * -(-int(count) // OUT_SHARDS)
