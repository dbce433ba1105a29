"""N-gram Jaccard self-join by a token-group matrix.

A document's set holds the 64-bit hashes of its distinct word shingles. Two documents link if their sets' Jaccard
similarity is at least PERCENT / 100, which asks each to share ceil(PERCENT n / 100) of its n tokens with the other.
Equal sets are one class throughout; a class is stood for by its least id.

1.  Groups are first the classes. Each document's smallest tokens (a prefix that must hold a twentieth of its tokens
    from any partner) meet by token, and only documents that share enough of them with another group go on.
2.  These are partitioned into groups of similar documents: equal min-hashes lead to a leader, the pair is compared,
    and the connected components of what links are the groups.
3.  The token-group matrix over whole sets tells how many of a document's tokens occur in any other group. Below
    the bound it cannot link outside its group, and within its group nothing more is to be gained for components.
4.  The rest is dealt into blocks of PART documents or so that share a rare token, not one that is merely frequent, large
    groups apart. The matrix of blocks over each document's rarest tokens, of which any partner has one, tells which pairs of
    blocks can hold a link; only these are opened, and their documents compared by whole sets. Pairs are opened in rounds
    that send no more tokens than all sets hold, so that disk stays in proportion to the input.

Steps 1, 3 and 4 lose no link; step 2 only has to find groups, not all links. In steps 1 and 3 a chunk sends each of
its distinct tokens once with the least group that has it, so that no token gathers more than a row for each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridloom.llm.common import components, drop_shuffles, partitions, release, written
from gridloom.llm.packed import CHUNK_POSITIONS, LAST, bounded_batches, by_chunk, give_back, pack, unpack

WORDS, PERCENT, HASHES, PART = 5, 75, 6, 64
#: Ids up to this many (8 MB) are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of `words` words of the A-Z lower-cased text; of the whole if it has fewer; none without words."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), _U, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, _U)
    for i in range(n):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def least_shared(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def _share(n: int) -> int:
    return -(-n // 20)


def prefix_and_need(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Length of the prefix, and how many of it any partner must have in its own prefix."""
    return n - least_shared(n, percent) + _share(n), _share(least_shared(n, percent))


_POSTINGS = "chunk long, bucket int, tokens binary, groups binary, mixed binary, runs binary, docs binary, ids array<long>, ns array<long>, needs array<long>, hi array<long>, lo array<long>"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _postings(source: Callable, buckets: int) -> Callable:
    """For mapInArrow: source(batch) yields (id, n, need, group, tokens, hi, lo); the rows of _POSTINGS."""
    schema = _arrow(_POSTINGS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, docs, held = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            chunk, rows = (task << 24) + seq, []
            token = np.concatenate([d[4] for d in docs])
            doc = np.repeat(np.arange(len(docs)), [len(d[4]) for d in docs])
            group = np.array([d[3] for d in docs], _U) & _U((1 << 40) - 1)
            order = np.lexsort((token, token % _U(buckets)))
            token, doc = token[order], doc[order]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
            if len(token):
                own = group[doc]
                low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
                runs, distinct = np.diff(np.append(first, len(token))), token[first]
                bucket = (distinct % _U(buckets)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(distinct)]):
                    end = first[b] if b < len(first) else len(token)
                    rows.append({"chunk": chunk, "bucket": int(bucket[a]), "tokens": pack(np.diff(distinct[a:b], prepend=_U(0))), "groups": pack(low[a:b]), "mixed": np.packbits(low[a:b] != high[a:b]).tobytes(), "runs": pack(runs[a:b]), "docs": pack(doc[first[a] : end])})
            rows.append({"chunk": chunk, "bucket": LAST, "ids": [d[0] for d in docs], "ns": [d[1] for d in docs], "needs": [d[2] for d in docs], "hi": [d[5] for d in docs], "lo": [d[6] for d in docs]})
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for d in source(batch):
                docs.append(d)
                held += len(d[4]) + 1
                if held >= CHUNK_POSITIONS // 8:
                    yield close()
                    seq, held, docs = seq + 1, 0, []
                    give_back()
        if docs:
            yield close()
        docs = []
        give_back()

    return run


def _in_other_groups(table: pa.Table) -> pa.Table:
    """One bucket's tokens of all chunks -> for each chunk, in order, whether another group has the token."""
    rows = table.to_pylist()
    tokens = [np.cumsum(unpack(r["tokens"]), dtype=_U) for r in rows]
    group = np.concatenate([unpack(r["groups"]) for r in rows])
    mixed = np.concatenate([np.unpackbits(np.frombuffer(r["mixed"], np.uint8), count=len(t)) for r, t in zip(rows, tokens)]).astype(bool)
    flat = np.concatenate(tokens)
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.append(True, flat[order][1:] != flat[order][:-1]))
    other = (np.minimum.reduceat(group[order], first) != np.maximum.reduceat(group[order], first)) | np.logical_or.reduceat(mixed[order], first)
    shared = np.empty(len(flat), bool)
    shared[order] = np.repeat(other, np.diff(np.append(first, len(flat))))
    ends = np.cumsum([len(t) for t in tokens])
    bits = [np.packbits(shared[e - len(t) : e]).tobytes() for e, t in zip(ends, tokens)]
    return pa.Table.from_pylist([{"chunk": r["chunk"], "bucket": r["bucket"], "bits": b} for r, b in zip(rows, bits)], schema=_arrow("chunk long, bucket int, bits binary"))


def _enough(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's rows -> its documents with as many tokens in other groups as they need."""
    schema, bits, postings = _arrow("id long, n long, hi long, lo long"), {}, {}
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if r["bucket"] < LAST:
                if r["bits"] is not None:
                    bits[r["bucket"]] = r["bits"]
                else:
                    postings[r["bucket"]] = (r["runs"], r["docs"])
                continue
            count = np.zeros(len(r["ids"]), np.int64)
            for bucket, (runs, docs) in postings.items():
                runs = unpack(runs, np.uint32)
                shared = np.repeat(np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=len(runs)).astype(bool), runs)
                count += np.bincount(unpack(docs, np.uint32)[shared], minlength=len(count))
            bits, postings = {}, {}
            needs = np.array(r["needs"])
            keep = np.flatnonzero((count >= needs) & (needs > 0)).tolist()
            if keep:
                yield pa.RecordBatch.from_pylist([{"id": r["ids"][k], "n": r["ns"][k], "hi": r["hi"][k], "lo": r["lo"][k]} for k in keep], schema=schema)


def _reaching(rows: DataFrame, source: Callable, label: str) -> tuple[DataFrame, DataFrame]:
    """(all documents' id, n, hi, lo; those that share enough tokens with other groups), both written."""
    buckets = partitions(rows.sparkSession)
    made = written(rows.mapInArrow(_postings(source, buckets), _POSTINGS), label)
    part = made.where(F.col("bucket") < LAST)
    bits = part.select("chunk", "bucket", "tokens", "groups", "mixed").repartition("bucket").groupBy("bucket").applyInArrow(_in_other_groups, "chunk long, bucket int, bits binary")
    last = made.where(F.col("bucket") == LAST)
    every = written(last.select(F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("ns").alias("n"), "hi", "lo")).alias("x")).select("x.*"), "documents")
    lined = by_chunk(bits, part.select("chunk", "bucket", "runs", "docs"), last.select("chunk", "bucket", "ids", "ns", "needs", "hi", "lo"))
    found = written(lined.mapInArrow(_enough, "id long, n long, hi long, lo long"), "reaching")
    del part, bits, last, lined
    release(made)
    return every, found


def _text_source(words: int, percent: int, whole: bool) -> Callable:
    def source(batch: pa.RecordBatch):
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = shingles(text.as_py(), words)
            hi, lo = np.frombuffer(hashlib.blake2b(t.tobytes(), digest_size=16).digest(), np.int64).tolist()
            p, need = prefix_and_need(len(t), percent) if len(t) else (0, 0)
            yield i, len(t), need, hi & ((1 << 63) - 1), t if whole else t[:p], hi, lo

    return source


def _sets(words: int, percent: int) -> Callable:
    """(id, text) -> (id, n, hi, lo, tokens, marks): the packed set and its min-hashes."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("tokens", pa.binary()), ("marks", pa.list_(pa.int64()))])
    source = _text_source(words, percent, True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _mix(np.arange(1, HASHES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
        for batch in batches:
            rows = [{"id": i, "n": n, "hi": hi, "lo": lo, "tokens": pack(np.diff(t, prepend=_U(0))), "marks": [int(_mix(t ^ s).min().view(np.int64)) for s in seeds]} for i, n, _, _, t, hi, lo in source(batch) if n]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _tokens(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=_U)


def _set_source(percent: int) -> Callable:
    """Rows (id, n, tokens, component) for the whole matrix."""
    def source(batch: pa.RecordBatch):
        ids, ns, tokens, component = (batch.column(k).to_pylist() for k in range(4))
        groups = _mix(np.array(component, np.int64).view(_U) + _U(1)).tolist()
        for i, n, t, g in zip(ids, ns, tokens, groups):
            yield i, n, least_shared(n, percent), g, _tokens(t), 0, 0

    return source


def _linked(percent: int) -> Callable:
    """Rows (a, b, ta, tb) -> the pairs that link."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            a, b, ta, tb = (batch.column(k) for k in range(4))
            keep = []
            for i in range(batch.num_rows):
                x, raw = _tokens(ta[i].as_py()), tb[i].as_py()
                if last[0] != raw:
                    last = (raw, _tokens(raw))
                y = last[1]
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))

    return run


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, na, b, nb) -> those that link, by their whole sets; sizes that rule a link out are left out first.

    Nothing but the comparison follows the joins, so that adaptive skew handling can split the rows of a set b that many are
    compared with; both joins share one exchange of the sets.
    """
    near = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    fit = written(pairs.where(near).select("a", "b").distinct(), "pairs")
    x = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    y = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    return fit.join(x, "a").join(y, "b").select("a", "b", "ta", "tb").mapInArrow(_linked(percent), "a long, b long")


def _open_blocks(percent: int) -> Callable:
    """Rows (pair, side, id, component, tokens) sorted by pair -> links between the sides (within the one side there is), one for
    each two components."""
    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        sides = [[r for r in rows if r[0] == k] for k in (0, 1)]
        left, right = sides[0], sides[1] or sides[0]
        sets = [_tokens(r[3]) for r in right]
        words, at = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        starts, seen, out = np.cumsum(sizes) - sizes, set(), []
        for _, a, ca, raw in left:
            own = _tokens(raw)
            place = np.searchsorted(words, own)
            place = place[(place < len(words)) & (words[np.minimum(place, len(words) - 1)] == own)]
            has = np.zeros(len(words), bool)
            has[place] = True
            both = np.add.reduceat(has[at].astype(np.int64), starts)
            for j in np.flatnonzero(100 * both >= percent * (len(own) + sizes - both)).tolist():
                _, b, cb, _ = right[j]
                key = (min(ca, cb), max(ca, cb))
                if ca != cb and key not in seen:
                    seen.add(key)
                    out.append((a, b))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def close() -> Iterator[pa.RecordBatch]:
            found = links(held) if len(held) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for pair, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if pair != last:
                    yield from close()
                    held, last = [], pair
                held.append(tuple(row))
        yield from close()

    return run


def _dealt(kept: DataFrame) -> DataFrame:
    """kept (id, lo, component, n, prefix) with its block, written: at most PART documents or so, near in the matrix.

    A document goes with the least id that has one of its prefix tokens. A component with PART documents or more there has blocks of its own.
    """
    posts = kept.select("id", "lo", F.explode("prefix").alias("token"))
    least = posts.groupBy("token").agg(F.min("id").alias("least"))
    key = posts.join(least.hint("merge"), "token").groupBy("id", "lo").agg(F.min("least").alias("key"))
    keyed = written(kept.join(key.hint("merge"), ["id", "lo"]), "keyed")
    cells = keyed.groupBy("key", "component").agg(F.count("*").alias("rows")).withColumn("cell", F.xxhash64("key", F.when(F.col("rows") >= PART, F.col("component"))))
    clusters = cells.groupBy("cell").agg(F.ceil(F.sum("rows") / PART).cast("int").alias("parts"))
    placed = keyed.join(cells.drop("rows").hint("merge"), ["key", "component"]).join(clusters.hint("merge"), "cell")
    return written(placed.select("id", "lo", "component", "n", "prefix", F.xxhash64("cell", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")), "blocks")


def _across(rest: DataFrame, sets: DataFrame, percent: int, room: int | None = None) -> DataFrame:
    """Step 4: links between documents of different components among rest (id, component), written. A round of pairs sends `room` tokens
    or so, as many as all sets hold if it isn't given."""
    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, lo, raw, c in zip(*(batch.column(k).to_pylist() for k in range(5))):
                t = _tokens(raw).view(np.int64)
                k = len(t)
                yield pa.RecordBatch.from_arrays([pa.array([i] * k), pa.array([n] * k), pa.array([lo] * k), pa.array(t), pa.array([c] * k)], names=["id", "n", "lo", "token", "component"])

    whole = written(sets.join(rest, "id").select("id", "n", "lo", "tokens", "component"), "whole")
    posts = written(whole.mapInArrow(listed, "id long, n long, lo long, token long, component long"), "posts")
    # A token of one component only can't link across, but has its place in the order of rarity.
    rare = written(posts.groupBy("token").agg(F.count("*").alias("df"), (F.min("component") != F.max("component")).alias("across")), "rare")
    ranked = posts.join(rare, "token").withColumn("r", F.row_number().over(Window.partitionBy("id", "lo").orderBy("df", "token")))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    kept = written(ranked.where(F.col("across") & (F.col("r") <= first)).groupBy("id", "lo").agg(F.min("component").alias("component"), F.max("n").alias("n"), F.collect_list("token").alias("prefix")), "kept")
    release(posts, rare)
    dealt = _dealt(kept)
    blocks = written(dealt.groupBy("block").agg(F.sum("n").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")), "sizes")
    matrix = written(dealt.select("block", F.explode("prefix").alias("token")).distinct(), "matrix")
    met = matrix.join(matrix.withColumnRenamed("block", "other"), "token").where("block <= other").select("block", "other").distinct()
    sized = met.join(blocks.hint("merge"), "block").join(blocks.toDF("other", "size2", "low2", "high2").hint("merge"), "other")
    # Two blocks of one and the same component have nothing to link.
    sized = sized.where("least(low, low2) <> greatest(high, high2)")
    pairs = written(sized.select("block", "other", F.xxhash64("block", "other").alias("pair"), (F.col("size") + F.when(F.col("block") != F.col("other"), F.col("size2")).otherwise(0)).alias("size")), "pairs")
    member = dealt.select("id", "lo", F.col("block").alias("own"))
    room = room or sets.agg(F.sum("n")).first()[0] or 1
    rounds, found = max(1, -(-(pairs.agg(F.sum("size")).first()[0] or 0) // room)), []
    for k in range(rounds):
        some = pairs.where(F.pmod(F.xxhash64("pair"), F.lit(rounds)) == k)
        one = some.join(member, F.col("block") == F.col("own")).select("pair", F.lit(0).alias("side"), "id", "lo")
        two = some.where("block <> other").join(member, F.col("other") == F.col("own")).select("pair", F.lit(1).alias("side"), "id", "lo")
        rows = one.unionByName(two).join(whole, ["id", "lo"]).select("pair", "side", "id", "component", "tokens")
        found.append(written(rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(_open_blocks(percent), "a long, b long"), "across"))
        del some, one, two, rows
        drop_shuffles(sets.sparkSession)
    release(whole)
    return reduce(DataFrame.unionByName, found)


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least id reachable by links, its own included).

    A text that is null or has no words links with nothing. Rows that repeat an id are one node with the links of
    all its texts. A null id links with nothing and has a null component. Very long texts are compared by all their shingles, held by one
    task as a set of 8 bytes each. Of ties for the least id there are none; equal sets are one class. Other columns aren't used, whatever
    their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    every, reaching = _reaching(texts, _text_source(words, percent, False), "prefixes")
    classes = written(every.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("rep")).where("rep IS NOT NULL"), "classes")
    reached = written(reaching.where("id IS NOT NULL").groupBy("hi", "lo").agg(F.min("id").alias("id")), "reached")
    size = reached.count()
    component = None
    if size:
        small = (lambda t: F.broadcast(t)) if size <= BROADCAST_IDS else (lambda t: t)
        own = texts.join(small(reached.select("id").distinct()), "id", "left_semi")
        made = own.select("id", "text").mapInArrow(_sets(words, percent), "id long, n long, hi long, lo long, tokens binary, marks array<long>")
        sets = written(made.join(small(reached), ["id", "hi", "lo"], "left_semi"), "sets")
        if sets.count() > size:  # rows that are repeated as a whole
            sets = written(sets.dropDuplicates(["id", "hi", "lo"]), "sets")
        marks = sets.select("id", "n", F.posexplode("marks").alias("i", "mark"))
        leaders = written(marks.groupBy("i", "mark").agg(F.min(F.struct("id", "n")).alias("leader")), "leaders")
        pairs = marks.join(leaders.hint("merge"), ["i", "mark"]).where(F.col("id") != F.col("leader.id")).select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("leader.id").alias("b"), F.col("leader.n").alias("nb"))
        links = written(_compare(pairs, sets, percent), "links")
        del marks, pairs, made, own
        release(leaders)
        component = written(components(links), "groups")
        grouped = F.coalesce("component", "id").alias("component")
        _, rest = _reaching(sets.join(component, "id", "left").select("id", "n", "tokens", grouped), _set_source(percent), "matrix")
        rest = written(rest.select("id").distinct().join(component, "id", "left").select("id", grouped), "rest")
        if not rest.isEmpty():
            more = _across(rest, sets, percent)
            component = written(components(links.unionByName(more)), "groups")
        release(sets)
    table = classes if component is None else classes.join(component.select(F.col("id").alias("rep"), "component"), "rep", "left")
    table = written(table.select(F.col("hi").alias("__hi"), F.col("lo").alias("__lo"), "rep", F.col("rep").alias("component") if component is None else F.coalesce("component", "rep").alias("component")), "lookup")
    out = every.join(table.hint("merge"), (F.col("hi") == F.col("__hi")) & (F.col("lo") == F.col("__lo")), "left")
    found = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("id"))).alias("component_id"))
    return found


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.seen FROM r JOIN e ON e.x = r.doc_id AND r.seen < e.y),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
}
