"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are one item with a count. Items meet in a table's bucket if their signs agree on all of its hyperplanes. Bits
per table grow with the number of items, so that a bucket of unrelated vectors stays small, and the number of tables
follows from the bits: a pair at the threshold is missed with probability `miss` at most, closer pairs far more rarely. A bucket
of more than `block` items is cut into blocks, and each pair of blocks is a cell, compared by a task of its own, so that no
bucket is capped and none is held whole by one task.

Only an id and a sketch of 128 more signs go into every table's cells. Items whose sketch is near that of another one in the cell
(a pair at the threshold is overlooked with probability 1e-5 in all) fetch their vectors, and are compared exactly. A pair counts in
the first table that brings it together. Of a cell only each item's number of links and one edge to the least id it is joined
to leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import components, release, written
from gridloom.llm.packed import bounded_batches

THRESHOLD, MISS, BLOCK, SEED = 0.95, 5e-4, 1024, 7


def tables_and_bits(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    bits = max(8, math.ceil(math.log2(max(n, 2))) - 6)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log(1 - same))), bits


def _unit(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.float64)
    # Scaled first: squares of very large or small components neither overflow nor vanish.
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def sketch_distance(threshold: float = THRESHOLD) -> int:
    """Signs of a sketch in which a pair at the threshold differs at most, but for a share of 1e-5 of these."""
    p, tail, k = math.acos(threshold) / math.pi, 1.0, -1
    while tail > 1e-5 and k < 2 * 64:
        k += 1
        tail -= math.comb(128, k) * p**k * (1 - p) ** (128 - k)
    return k


def _signer(tables: int, bits: int):
    """(id, mark, m, embedding) -> the same with signs: one long per table and two of the sketch."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights, all_bits = (np.int64(1) << np.arange(bits, dtype=np.int64)), (np.int64(1) << np.arange(64, dtype=np.int64))
        for batch in batches:
            lists = batch.column(3)
            lens = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lens) - lens
            out = np.empty((batch.num_rows, tables + 2), np.int64)
            for d in np.unique(lens).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, tables * bits + 128))
                rows = np.flatnonzero(lens == d)
                above = _unit(values[starts[rows][:, None] + np.arange(d)]) @ planes[d] >= 0
                out[rows, :tables] = (above[:, :-128].reshape(len(rows), tables, bits) * weights).sum(axis=2)
                out[rows, tables:] = (above[:, -128:].reshape(len(rows), 2, 64) * all_bits).sum(axis=2)
            signs = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * (tables + 2), pa.int32()), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists, signs], names=["id", "mark", "m", "embedding", "signs"])

    return run


def _cells(batches: Iterable[pa.RecordBatch], columns: int) -> Iterator[list]:
    """Rows sorted by the cell in their first column -> cell by cell, the parts of batches (first `columns` columns as arrays, batch, start, end)."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        cuts = (np.flatnonzero(np.diff(arrays[0])) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if held and arrays[0][a] != last:
                yield held
                held = []
            last = arrays[0][a]
            held.append(([x[a:b] for x in arrays], batch, a, b))
    if held:
        yield held


def _candidates(distance: int):
    """Rows (cell, table, single, block, id, mark, s, t) sorted by cell -> without s and t, the rows that have a near sketch in their cell."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _cells(batches, 8):
            cell, table, single, block, ids, mark, s, t = (np.concatenate([h[0][k] for h in held]) for k in range(8))
            one = bool(single[0])
            if len(ids) < 2 or not one and block.min() == block.max():
                continue
            first, second = (np.flatnonzero(block == b) for b in (block.min(), block.max()))
            near = sum(np.bitwise_count(x[first][:, None] ^ x[second][None]) for x in (s.view(np.uint64), t.view(np.uint64))) <= distance
            if one:
                np.fill_diagonal(near, False)
            keep = np.unique(np.concatenate([first[near.any(axis=1)], second[near.any(axis=0)]]))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (cell, table, single, block, ids, mark)], names=["cell", "table", "single", "block", "id", "mark"])

    return run


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes in order and edges (a, b), the least node each is connected to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_OUT = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])


def _compare(threshold: float):
    """Rows (cell, table, single, block, id, mark, m, embedding, signs) sorted by cell: each cell's links."""
    def links(ids, marks, m, vectors, signs, table, blocks) -> pa.RecordBatch | None:
        order = np.lexsort((marks, ids))
        ids, marks, m, vectors, signs, blocks = (x[order] for x in (ids, marks, m, vectors, signs, blocks))
        unit = _unit(vectors)
        first, second = (np.flatnonzero(blocks == b) for b in (blocks.min(), blocks.max()))
        near = unit[first] @ unit[second].T >= threshold
        i, j = np.nonzero(near)
        i, j = first[i], second[j]
        keep = ids[i] != ids[j]
        if blocks.min() == blocks.max():
            keep &= i < j
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        new = np.ones(len(i), bool)
        for t in range(table):
            new &= signs[i, t] != signs[j, t]
        n = np.bincount(np.concatenate([i[new], j[new]]), weights=np.concatenate([m[j[new]], m[i[new]]]).astype(float), minlength=len(ids)).astype(np.int64)
        label = _joined(i, j, len(ids))
        touched = np.unique(np.concatenate([i, j]))
        return pa.RecordBatch.from_arrays([pa.array(ids[touched]), pa.array(marks[touched]), pa.array(n[touched]), pa.array(ids[label[touched]])], schema=_OUT)

    def rows_of(column: pa.ListArray, a: int, b: int) -> np.ndarray:
        return column.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _cells(batches, 7):
            _, table, single, blocks, ids, marks, m = (np.concatenate([h[0][k] for h in held]) for k in range(7))
            if len(ids) < 2 or not single[0] and blocks.min() == blocks.max():
                continue
            vectors, signs = (np.concatenate([rows_of(batch.column(k), a, b) for _, batch, a, b in held]) for k in (7, 8))
            found = links(ids, marks, m, vectors, signs, int(table[0]), blocks)
            if found is not None:
                yield found

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other vectors linked directly), component_id, kept (vec_id = component_id).

    Vectors link if their cosine in double precision is at least threshold; vectors of different lengths don't.
    A vector that is null, empty or zero, or holds a null or a non-finite number, and one with a null id, links
    with nothing; a null id has a null component and is not kept. Rows that repeat an id never link with one
    another and share the links of all of them. Equal vectors of different ids link like others (told by 128 bits of hash). Other
    columns aren't used, whatever their names. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = base.where(F.col("vec_id").isNotNull()).where(sound).withColumns({"mark": F.xxhash64("embedding"), "more": F.xxhash64(F.lit(SEED), "embedding")})
    # Rows of a repeated id are items by themselves, as they don't link with one another.
    twice = usable.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id", F.col("vec_id").alias("own"))
    members = written(usable.select("vec_id", "mark", "more").join(twice, "vec_id", "left"), "members")
    items = written(members.groupBy("mark", "more", "own").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")), "items")
    heads = usable.join(items.select(F.col("id").alias("vec_id"), "mark", "more", "m"), ["vec_id", "mark", "more"]).select(F.col("vec_id").alias("id"), "mark", "m", "embedding").dropDuplicates(["id", "mark"])
    tables, bits = tables_and_bits(items.count(), threshold, miss)
    kind = base.schema["embedding"].dataType.simpleString()
    signed = written(heads.mapInArrow(_signer(tables, bits), f"id long, mark long, m long, embedding {kind}, signs array<long>"), "signs")
    keyed = signed.select("id", "mark", F.col("signs")[tables].alias("s"), F.col("signs")[tables + 1].alias("t"), F.size("embedding").alias("d"), F.posexplode(F.slice("signs", 1, tables)).alias("table", "sign"))
    keyed = keyed.withColumn("bucket", F.xxhash64("table", "sign", "d"))
    size = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = written(size.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("parts")), "large")
    rows = keyed.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "mark", F.lit(SEED)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
    rows = rows.select(cell.alias("cell"), "table", (F.col("block") == F.col("other")).alias("single"), "block", "id", "mark", "s", "t")
    near = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_candidates(sketch_distance(threshold)), "cell long, table int, single boolean, block int, id long, mark long")
    near = written(near, "near")
    found = near.join(signed, ["id", "mark"]).select("cell", "table", "single", "block", "id", "mark", "m", "embedding", "signs")
    found = found.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(threshold), "id long, mark long, n long, to long")
    found = written(found.groupBy("id", "mark", "to").agg(F.sum("n").alias("n")), "links")
    release(signed, near, large)
    counts = found.groupBy("id", "mark").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    judged = items.join(counts, ["id", "mark"], "left").join(parts, "id", "left")
    n = F.coalesce("n", F.lit(0)) + F.when(F.col("own").isNull(), F.col("m") - 1).otherwise(0)
    judged = written(judged.select("mark", "more", F.col("own").alias("o"), n.alias("n"), F.coalesce("component", "id").alias("component")), "judged")
    of_row = members.join(judged.hint("merge"), ["mark", "more"]).where(F.col("own").eqNullSafe(F.col("o")))
    of_id = of_row.groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("component").alias("component"))
    out = base.select("vec_id").join(of_id, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = {
    "op7_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
k AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1),
r(vec_id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.seen FROM r JOIN l ON l.x = r.vec_id AND r.seen < l.y),
c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e LEFT JOIN k USING (vec_id) JOIN c USING (vec_id)""",
}
