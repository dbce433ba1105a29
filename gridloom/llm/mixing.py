"""Mixing sources to target weights, in DataFrame functions only.

Targets: sources share 150% of all words by weight; a target stops at twice its source's words and the excess is
reshared by weight until none is above. Every source's documents fall into blocks by a hash; a source's quota is
the exact list of blocks it gives: all blocks once for each whole pass over it, then blocks in a permuted order
until the rest of the target is reached, the last of them in part. A splitting tree deals the quotas to the output
shards: at each node the left half gets a multivariate hypergeometric draw (selection sampling without
replacement) of the node's blocks and the right half the remainder, so that no block is lost or dealt twice.
A shard then takes the next disjoint run of each source's permuted blocks and shuffles its own documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import word_count, written

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCKS, SUB_BLOCKS, OUT_SHARDS, SEED = 2048, 4096, 8, 90210
#: Blocks of all sources together, besides one for each; rows of sources or blocks up to which a table is broadcast.
MOST_BLOCKS, BROADCAST_ROWS = 1 << 17, 1 << 18
#: A small source has fewer blocks, of about so many documents or more each (up to twice as many), and a small block fewer sub-blocks.
DOCS_IN_BLOCK, DOCS_IN_SUB_BLOCK = 48, 64


def _u(*parts) -> Column:
    """A hash of the parts as a number from 0 up to 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11).cast("double") / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with idx (rank by code point, null last), weight and target.

    Resharing ends where target = min(most x size, level x weight), with one level for all: sources are put in the
    order in which they stop, and the level is the first that no later source stops below. One row per source.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    t = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("stop", F.col("cap") / F.col("weight"))
    by_stop = Window.orderBy("stop", "idx")
    stopped = F.coalesce(F.sum("cap").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - stopped) / open_weight)
    level = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "idx", "level"))).over(everything)["level"]
    return t.select("source", "source_size", "idx", "weight", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight"))).alias("target"))


def splitting_tree(quotas: DataFrame, shards: int) -> DataFrame:
    """(idx, quota) -> (idx, shard, start, n): how many of a source's draws, and from which on, a shard gets."""
    def draw(node: Column, q: Column, left: Column) -> Column:
        """Per source, how many of its q blocks are among `left` blocks drawn from all without replacement."""
        total = F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x["quota"])

        def source(acc, x):
            def block(a, i):
                chosen = _u(node, x["idx"], i) * a["rest"] < a["need"]
                return F.struct((a["need"] - F.when(chosen, 1).otherwise(0)).cast("long").alias("need"), (a["rest"] - 1).cast("long").alias("rest"), (a["n"] + F.when(chosen, 1).otherwise(0)).cast("long").alias("n"))

            got = F.aggregate(F.when(x["quota"] > 0, F.sequence(F.lit(1).cast("long"), x["quota"])).otherwise(F.array().cast("array<long>")), F.struct(acc["need"].alias("need"), acc["rest"].alias("rest"), F.lit(0).cast("long").alias("n")), block)
            return F.struct(got["need"].alias("need"), got["rest"].alias("rest"), F.concat(acc["out"], F.array(F.struct(x["idx"].alias("idx"), got["n"].alias("quota")))).alias("out"))

        start = F.struct(F.round(total * left).cast("long").alias("need"), total.alias("rest"), F.array().cast("array<struct<idx:int,quota:bigint>>").alias("out"))
        return F.aggregate(q, start, source, lambda a: a["out"])

    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("idx", F.col("quota").cast("long").alias("quota")))).alias("q")).select(F.lit(0).alias("lo"), F.lit(shards).alias("m"), "q")
    for _ in range(max(0, (shards - 1).bit_length())):
        half = F.floor(F.col("m") / 2).cast("int")
        nodes = nodes.withColumn("left", F.when(F.col("m") > 1, draw(F.col("lo") * 4096 + F.col("m"), F.col("q"), half / F.col("m"))))
        right = F.zip_with("q", "left", lambda a, b: F.struct(a["idx"].alias("idx"), (a["quota"] - b["quota"]).alias("quota")))
        kids = F.when(F.col("m") > 1, F.array(F.struct(F.col("lo"), half.alias("m"), F.col("left").alias("q")), F.struct((F.col("lo") + half).alias("lo"), (F.col("m") - half).alias("m"), right.alias("q")))).otherwise(F.array(F.struct("lo", "m", "q")))
        nodes = nodes.select(F.explode(kids).alias("k")).select("k.*")
    dealt = nodes.select(F.col("lo").alias("shard"), F.explode("q").alias("x")).select("x.idx", "shard", F.col("x.quota").alias("n"))
    before = Window.partitionBy("idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, blocks: int = BLOCKS, shards: int = OUT_SHARDS) -> DataFrame:
    """Add size, source_size, target and copies to every row of docs.

    size: words of the text (null: 0). copies: one (pass, shard, key) for each time the mix takes the document,
    empty if never; shard is the output shard that drew the document's block in that pass and key the document's place in that
    shard's local shuffle. Documents are taken whole, very long ones too. Of the block that is taken in part, sub-blocks are taken as far as
    they fit, of the next one documents in a hashed order, each that still fits; then one is added, left out or exchanged if that comes nearer. A
    source's taken words so miss its target by far less than half a document of middle size, unless the sub-block has hardly any. Sources go by code point, null last, and get the weights
    in turn. A document's block follows from its id and text: rows that repeat one of them are like any others, rows that repeat both
    share a block but are taken one by one; empty texts take part with size 0;
    an empty table gives an empty result; columns of the added names are replaced, others may have any name. Reruns agree.

    Tables per source and block have `blocks` rows for each source at most, those per block that all rows are joined with MOST_BLOCKS. Of the one block of a source that is taken in part,
    ids, sizes and hashes are written, and only the sub-block in which the cut falls is put in order, as one list for each source: about 64 to 128
    documents, more only from 2,048 x 4,096 x 64 documents of a source on.
    """
    added = ("size", "source_size", "target", "copies")
    own = [c for c in docs.columns if c.lower() not in added]
    named = lambda c: F.col(f"`{c}`")
    # Every column of docs is in one struct, so that no name can clash.
    rows = docs.select(F.struct(*map(named, own)).alias("row"), named(id_col).cast("long").alias("id"), named(source_col).alias("source"), named(text_col).alias("text"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "id", "text"), 1))
    rows = rows.withColumns({"size": word_count(F.col("text")), "hashed": (F.col("h") % blocks).cast("int")})
    counts = written(rows.groupBy("source", "hashed").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "blocks")
    sizes = counts.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"))
    plan = targets(sizes.select("source", "source_size"), weights, share, most).join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    # All sources together have MOST_BLOCKS blocks at most, besides one for each.
    total = F.sum("n").over(Window.partitionBy())
    plan = plan.withColumn("many", F.greatest(F.lit(1), F.least(F.lit(blocks), F.floor(F.col("n") / DOCS_IN_BLOCK), F.floor(F.col("n") / total * MOST_BLOCKS))).cast("int"))
    plan = plan.withColumn("subs", F.greatest(F.lit(1), F.least(F.lit(SUB_BLOCKS), F.floor(F.col("n") / F.col("many") / DOCS_IN_SUB_BLOCK))).cast("int")).drop("n")
    plan = written(plan, "plan")
    known = counts.join(plan, counts["source"].eqNullSafe(plan["source"])).drop(plan["source"]).withColumn("block", F.pmod(F.col("hashed"), F.col("many")))
    joined = known.groupBy("source", "idx", "source_size", "target", "whole", "rest", "block").agg(F.sum("words").alias("words"))
    per_pass = joined.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    permuted = Window.partitionBy("idx", "pass").orderBy(_u("idx", "block", "pass"), "block")
    before = F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_pass = per_pass.withColumn("before", before).where((F.col("pass") < F.col("whole")) | ((F.col("before") < F.col("rest")) & (F.col("rest") > 0.5)))
    per_pass = per_pass.withColumn("room", F.when((F.col("pass") == F.col("whole")) & (F.col("before") + F.col("words") > F.col("rest")), F.col("rest") - F.col("before")))
    draws = per_pass.withColumn("j", F.row_number().over(Window.partitionBy("idx").orderBy("pass", "before", _u("idx", "block", "pass"), "block")) - 1)
    draws = written(draws.select("idx", "block", "pass", "room", "j"), "draws")
    dealt = splitting_tree(draws.groupBy("idx").agg(F.count("*").alias("quota")), shards).where("n > 0").select("idx", "shard", F.explode(F.sequence(F.col("start").cast("long"), (F.col("start") + F.col("n") - 1).cast("long"))).alias("j"))
    # A block is taken as often as shards drew it: what no shard has drawn isn't in the mix.
    placed = draws.join(dealt, ["idx", "j"]).groupBy("idx", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", F.col("room").isNotNull().alias("part")))).alias("draws"), F.max("room").alias("room"))
    placed = written(placed.select("idx", "block", "draws", "room"), "placed")
    known = _few(plan.select(F.col("source").alias("s"), "idx", "many", "subs", "source_size", "target"))
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rows = rows.withColumns({"block": F.pmod(F.col("hashed"), F.col("many")), "sub": (F.shiftright("h", 40) % F.col("subs")).cast("int")})
    ends, listed = _cut(rows.join(_few(placed.where("room IS NOT NULL").select("idx", "block", "room")), ["idx", "block"]).select("idx", "id", "h", "sub", "size", "room"))
    placed = written(placed.join(ends, "idx", "left").withColumn("at", F.when(F.col("room").isNotNull(), F.col("at"))), "lookup")
    rows = rows.join(_few(placed), ["idx", "block"], "left")
    key = lambda d: F.xxhash64(F.lit(SEED + 1), "id", "h", d["pass"], d["shard"])
    some = lambda c: F.coalesce(F.transform(c, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), key(d).alias("key"))), F.array().cast("array<struct<pass:int,shard:int,key:bigint>>"))
    cut = _few(listed).select(*[F.col(c).alias(f"c_{c}") for c in ("idx", "id", "h", "size")], "k", "m")
    at_end = F.col("room").isNotNull() & (F.col("sub") == F.col("at"))
    rows = rows.join(cut, at_end & (F.col("idx") == F.col("c_idx")) & F.col("id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")) & (F.col("size") == F.col("c_size")), "left")
    fits = F.coalesce((F.col("sub") < F.col("at")) | (F.col("k") == F.col("m")), F.lit(False))
    names = ["row.*", "size", "source_size", "target"]
    copies = lambda part: some(F.filter("draws", lambda d: ~d["part"] | part)).alias("copies")
    if listed.where("k < m").isEmpty():
        return rows.select(*names, copies(fits))
    # Rows that repeat both id and text, of which only some are taken: they are numbered.
    split = F.coalesce(F.col("k") < F.col("m"), F.lit(False))
    numbered = rows.where(split).withColumn("place", F.row_number().over(Window.partitionBy("idx", "id", "h", "size").orderBy("h")))
    return rows.where(~split).select(*names, copies(fits)).unionByName(numbered.select(*names, copies(F.col("place") <= F.col("k"))))


def _few(table: DataFrame) -> DataFrame:
    """A table of sources or blocks, broadcast if it is found to have BROADCAST_ROWS rows at most (about 100 bytes each)."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _cut(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (idx, id, h, sub, size, room) of the blocks that are taken in part -> (idx, at) and (idx, id, h, size, m, k), both written.

    Sub-blocks before `at` are taken whole and those after it not. In it, documents are taken in a hashed order, each that fits what is left; then
    one more is taken, one left out, or one exchanged for another, if the words come nearer to the room: k of m equal rows, listed if any.
    """
    rows = written(rows.groupBy("idx", "room", "sub", "id", "h", "size").agg(F.count("*").alias("m")), "part")
    subs = rows.groupBy("idx", "room", "sub").agg(F.sum(F.col("size") * F.col("m")).alias("words"))
    subs = subs.withColumn("end", F.sum("words").over(Window.partitionBy("idx").orderBy("sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = subs.where(F.col("end") > F.col("room")).groupBy("idx").agg(F.min(F.struct("sub", (F.col("room") - F.col("end") + F.col("words")).alias("left"))).alias("e"))
    ends = written(first.select("idx", F.col("e.sub").alias("at"), F.col("e.left").alias("left")), "ends")
    one = F.struct(_u("h", F.lit("cut")).alias("u"), "h", "id", "size", "m")
    part = rows.join(ends, "idx").where(F.col("sub") == F.col("at")).groupBy("idx", "left").agg(F.sort_array(F.collect_list(one)).alias("docs"))

    def fit(acc: Column, d: Column) -> Column:
        k = F.when(d["size"] == 0, d["m"]).otherwise(F.least(d["m"], F.floor(acc["free"] / d["size"])))
        return F.struct((acc["free"] - k * d["size"]).alias("free"), F.concat(acc["ks"], F.array(k)).alias("ks"))

    part = part.withColumn("fit", F.aggregate("docs", F.struct(F.col("left").alias("free"), F.array().cast("array<bigint>").alias("ks")), fit))
    part = part.select("idx", F.col("fit.free").alias("free"), F.zip_with("docs", "fit.ks", lambda d, k: F.struct(d["h"].alias("h"), d["id"].alias("id"), d["size"].alias("size"), d["m"].alias("m"), k.alias("k"))).alias("docs"))
    sizes = lambda which: F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.transform(F.filter("docs", which), lambda d: d["size"])))
    part = part.withColumns({"more": sizes(lambda d: d["k"] < d["m"]), "fewer": sizes(lambda d: d["k"] > 0)})
    changes = F.flatten(F.transform("more", lambda a: F.transform("fewer", lambda b: F.struct(F.abs(F.col("free") - a + b).alias("miss"), a.alias("a"), b.alias("b")))))
    part = part.withColumn("best", F.array_min(changes))
    place = lambda which: F.array_position(F.transform("docs", which), True)
    part = part.withColumns({"added": place(lambda d: (d["size"] == F.col("best.a")) & (d["k"] < d["m"]) & (d["size"] > 0)), "gone": place(lambda d: (d["size"] == F.col("best.b")) & (d["k"] > 0) & (d["size"] > 0))})
    part = part.select("idx", "added", "gone", F.posexplode("docs").alias("at", "d"))
    turn = lambda c: F.when(F.col(c) == F.col("at") + 1, 1).otherwise(0)
    part = part.select("idx", "d.id", "d.h", "d.size", "d.m", (F.col("d.k") + turn("added") - turn("gone")).cast("long").alias("k"))
    return ends.drop("left"), written(part.where("k > 0"), "cut")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    shards = F.transform("copies", lambda c: c["shard"]).alias("shards")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).cast("long").alias("taken"), shards)


ORACLE: dict[str, str] = {}
