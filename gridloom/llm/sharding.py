"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. A key descends level by level: at each node, every child holds a hash draw of the
key, an exponential waiting time with the child's weight (that of all shards below it) as its rate, and the least draw
wins. A child so wins with probability weight / sum of weights. A change of a shard's weight changes the weights on the
path above it alone: keys only move into the subtrees on that path (weight up) or out of them (weight down), and none moves
between two others. A shard that joins as a region of its own takes keys only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS, RACK, REGION = 40, 4, 3  # shards in all, shards in a rack, racks in a region
SEED = 20240229
#: Slots are numbered in buckets of about so many bytes of input.
BUCKET_BYTES = 64 << 20

#: Regions of racks of the weights of shards, which are numbered from 0 on through all of them.
Tree = Sequence[Sequence[Sequence[float]]]


def tree_of(weights: Sequence[float], rack: int = RACK, region: int = REGION) -> Tree:
    racks = [[*weights[i : i + rack]] for i in range(0, len(weights), rack)]
    return [racks[i : i + region] for i in range(0, len(racks), region)]


def one_more(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, the last by number, as a region of its own."""
    return [*tree, [[weight]]]


def _draw(seed: int, level: int, node: Column, weight: Column, key: Column) -> Column:
    # (h + 0.5) / 2^53 lies strictly between 0 and 1, so that every draw is finite and positive; one of weight 0 never wins.
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), node, key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.when(weight > 0, -F.ln(u) / weight).otherwise(F.lit(float("inf")))


def _winner(children: Column, level: int, key: Column, seed: int) -> Column:
    """Of an array of (node, weight), the struct (draw, node) with the least draw."""
    return F.array_min(F.transform(children, lambda c: F.struct(_draw(seed, level, c["node"], c["weight"], key).alias("draw"), c["node"].alias("node"))))


def _children(rows: Sequence[tuple[int, float]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("node"), F.lit(float(w)).alias("weight")) for n, w in rows])


def _numbered(tree: Tree) -> tuple[list, list[list], list[list]]:
    """Children (node, weight): regions of the root, racks of each region, and shards of each rack."""
    regions, racks, shards, n = [], [], [], 0
    for region in tree:
        own = []
        for rack in region:
            own.append((len(shards), sum(rack)))
            shards.append([(n + i, w) for i, w in enumerate(rack)])
            n += len(rack)
        regions.append((len(racks), sum(w for _, w in own)))
        racks.append(own)
    return regions, racks, shards


def tree_shard(key: Column, tree: Tree, seed: int = SEED) -> Column:
    """The shard of a key column. A shard of weight 0 takes nothing; a null key is a key like any other."""
    weights = [w for region in tree for rack in region for w in rack]
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, and one at least positive")
    regions, racks, shards = _numbered(tree)
    below = lambda parts, node: F.array(*map(_children, parts))[node]
    rack = lambda k, r: _winner(below(racks, r), 1, k, seed)["node"]
    rest = lambda k: _bound(_bound(_winner(_children(regions), 0, k, seed)["node"], lambda r: rack(k, r)), lambda r: _winner(below(shards, r), 2, k, seed)["node"])
    return _bound(key, rest)


def _bound(x: Column, f) -> Column:
    """f(x) with x evaluated once. A lambda's body is better without columns of the input, which the optimizer overlooks there."""
    return F.transform(F.array(x), f)[0]


def grown_shard(shard: Column, key: Column, tree: Tree, weight: float = 1.0, seed: int = SEED) -> Column:
    """The shard of a key after one_more(tree, weight), given the one in tree: the new region's draw against the least so far."""
    regions, _, shards = _numbered(tree)
    least = _bound(key, lambda k: _winner(_children(regions), 0, k, seed)["draw"])
    return F.when(_draw(seed, 0, F.lit(len(regions)), F.lit(float(weight)), key) < least, F.lit(sum(map(len, shards)))).otherwise(shard)


def shard(docs: DataFrame, shards: int = SHARDS, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", sub_buckets: int | None = None) -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard to every row of docs.

    size: UTF-8 bytes of the text (null: none) plus 16. shard: by the tree (default: `shards` of weight 1) over the id, and so
    by id and tree alone. slot: 0, 1, … without gaps within a shard, in the order of a hash bucket of id and text, then id,
    size and checksum; it is numbered bucket by bucket from a table of bucket counts, whose number follows the input's bytes.
    grown_shard: the shard when one more shard of weight 1 joins. Rows that repeat an id share its shard and
    have slots of their own, rows that tie in all of these in any order; a null id is an id like any other. Very long texts count like
    others. An empty table gives an empty result. Columns of the added names are replaced, others may have any name.
    """
    tree = tree or tree_of([1.0] * shards)
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    named = lambda c: F.col(f"`{c}`")
    if sub_buckets is None:
        sub_buckets = max(32, min(1 << 20, int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // BUCKET_BYTES // max(1, shards)))
    key, text = named(id_col).cast("long"), F.coalesce(named(text_col), F.lit(""))
    # Every column of docs is in one struct, so that no name can clash.
    rows = docs.select(
        F.struct(*[named(c) for c in docs.columns if c.lower() not in added]).alias("row"), key.alias("id"), F.octet_length(text).cast("long").alias("size"), F.crc32(text).alias("crc"),
        tree_shard(key, tree).alias("shard"), F.pmod(F.xxhash64(F.lit(SEED + 1), key, text), F.lit(sub_buckets)).cast("int").alias("bucket"),
    ).withColumn("grown", grown_shard(F.col("shard"), F.col("id"), tree))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "size", "crc")) - 1
    out = rows.withColumn("place", place).join(starts, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    return out.select("row.*", (F.col("size") + 16).alias("size"), F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), F.col("grown").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).drop("text")


ORACLE: dict[str, str] = {}
