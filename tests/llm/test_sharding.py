import math
import zlib

from pyspark.sql import functions as F

from gridloom.llm.sharding import SEED, grown_shard, one_more, shard, tree_of, tree_shard


def test_slots_sizes_and_growth(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"), F.lit(1).alias("slot"))
    df = df.unionByName(spark.createDataFrame([(None, None, 0), (None, "x", 0), (1, "é1", 0), (1, "other", 0), (2, "long " * 100_000, 0)], "doc_id long, text string, slot int"))
    df = df.selectExpr("*", "1 AS s", "2 AS bucket", "3 AS `a.b`", "4 AS `row`", "5 AS `__bucket`")
    out = shard(df)
    assert out.columns == [c for c in df.columns if c != "slot"] + ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = out.collect()
    assert len(rows) == 4005
    taken = {}
    for r in rows:
        text = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 16, zlib.crc32(text), "key")
        assert r.grown_shard in (r.shard, 40)
        taken.setdefault(r.shard, []).append(r.slot)
    assert set(taken) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in taken.values())
    assert 60 < sum(r.grown_shard == 40 for r in rows) < 150
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert shard(df.limit(0)).count() == 0


def test_against_a_plain_descent(spark):
    tree = one_more(tree_of([1.0 + i % 3 for i in range(17)] + [0.0, 4.0]), 2.5)
    nodes = [[], [], []]
    hashed = lambda level, n: F.xxhash64(F.lit(SEED), F.lit(level), F.lit(n), F.col("id"))
    n_racks, n_shards = sum(map(len, tree)), sum(len(k) for r in tree for k in r)
    for level, n in enumerate((len(tree), n_racks, n_shards)):
        nodes[level] = [hashed(level, i) for i in range(n)]
    rows = spark.range(500).select(*[F.array(*n).alias(f"l{i}") for i, n in enumerate(nodes)], tree_shard(F.col("id"), tree).alias("got")).collect()

    def descend(r):
        draw = lambda level, n, w: -math.log((((r[level][n] % 2**64) >> 11) + 0.5) / 2**53) / w if w else math.inf
        region = min(range(len(tree)), key=lambda i: draw(0, i, sum(map(sum, tree[i]))))
        first = sum(map(len, tree[:region]))
        rack = min(range(len(tree[region])), key=lambda i: draw(1, first + i, sum(tree[region][i])))
        start = sum(len(k) for x in tree[:region] for k in x) + sum(map(len, tree[region][:rack]))
        return start + min(range(len(tree[region][rack])), key=lambda i: draw(2, start + i, tree[region][rack][i]))

    assert [r.got for r in rows] == [descend(r) for r in rows]


def test_weights_and_movement(spark):
    keys, k = spark.range(20000), F.col("id")
    tree = tree_of([1.0] * 13)
    for n in range(13, 17):
        more = one_more(tree)
        moved = keys.select(tree_shard(k, tree).alias("a"), tree_shard(k, more).alias("b"), grown_shard(tree_shard(k, tree), k, tree).alias("g"))
        assert moved.where("b <> g").count() == 0
        moved = moved.where("a <> b").groupBy("b").count().collect()
        assert [r.b for r in moved] == [n] and abs(moved[0]["count"] / 20000 - 1 / (n + 1)) < 0.02
        tree = more
    w = [1.0, 2.0, 0.0, 5.0]
    got = {r.s: r["count"] for r in keys.groupBy(tree_shard(k, [[w]]).alias("s")).count().collect()}
    assert set(got) == {0, 1, 3} and abs(got[3] / 20000 - 5 / 8) < 0.02


def test_a_weight_moves_keys_into_its_own_subtrees_alone(spark):
    old = tree_of([1.0] * 40)
    new = [[[*rack] for rack in region] for region in old]
    new[1][2][0] = 3.0  # shard 20: region 1 (shards 12 to 23), rack 5 (20 to 23)
    moved = spark.range(30000).select(tree_shard(F.col("id"), old).alias("a"), tree_shard(F.col("id"), new).alias("b")).where("a <> b").collect()
    region, rack = (lambda s: s // 12), (lambda s: s // 4)
    assert moved
    for r in moved:
        if region(r.a) != region(r.b):
            assert region(r.b) == 1
        elif rack(r.a) != rack(r.b):
            assert rack(r.b) == 5
        else:
            assert r.b == 20
