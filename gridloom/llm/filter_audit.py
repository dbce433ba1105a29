"""Filter interaction audit: what each filter removes in every order of application.

Duplicates are found by sorting: rows are range-partitioned by a fingerprint of the text and the id, so that a large
group of copies is spread over as many partitions as it fills, and sorted by fingerprint, whole text and id inside each
partition. A row is compared with its predecessor. A run of equal texts that may have begun in an earlier partition
is left open; the runs at both ends of every partition are written with their texts and least ids, and the open ones
are decided from these. Every row then has a mask of the filters it fails; rows are counted by part and mask, and the
orders are worked out on these counts, which are additive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import written
from gridloom.llm.packed import bounded_batches

#: A filter tells from a text and its words (runs of anything but space and tab to carriage return, as bytes) whether the text fails.
Filter = Callable[[str, list[bytes]], bool]

UPPER = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = frozenset("#$%&*|")

FILTERS: dict[str, Filter] = {
    "A": lambda text, words: len(words) < 100,
    "B": lambda text, words: 100 * len(set(words)) < 80 * len(words),
    "C": lambda text, words: 100 * _upper(text) > 10 * len(text),
    "D": lambda text, words: not SIGNS.isdisjoint(text),
}
#: The letter of the filter that a text fails if a row with a smaller id has the same text.
DUPLICATE = "E"

_MARKS = pa.schema([("end", pa.bool_()), ("id", pa.int64()), ("part", pa.string()), ("fails", pa.string()), ("pid", pa.int32()), ("run", pa.int64()), ("fp", pa.int64()), ("text", pa.string()), ("null_id", pa.bool_())])
_MARKS_SQL = "end boolean, id long, part string, fails string, pid int, run long, fp long, text string, null_id boolean"


def _upper(text: str) -> int:
    raw = text.encode()
    return len(raw) - len(raw.translate(None, UPPER))


def failed(text: str, filters: Mapping[str, Filter] = FILTERS) -> str:
    """Letters of the filters that a text fails. bytes.split() parts at just the six characters that aren't in words."""
    words = text.encode().split()
    return "".join(k for k, f in filters.items() if f(text, words))


def failures(docs: DataFrame, filters: Mapping[str, Filter] = FILTERS, duplicate: str = DUPLICATE, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, fails): the letters of the filters that each row of docs fails, `duplicate` last; written.

    A null text counts as empty, a null part too. A row fails `duplicate` if a row with a smaller id has the same
    text; rows that repeat both are equal and don't fail for one another. A null id counts as larger than any other. Rows that repeat
    both id and text stay in one partition, and stream through it. Very long texts are compared whole; other columns don't matter; an empty
    table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    named = lambda c: F.col(f"`{c}`")
    text, key = F.coalesce(named(text_col).cast("string"), F.lit("")), named(id_col).cast("long")
    rows = docs.select(F.xxhash64(text).alias("fp"), text.alias("text"), key.isNull().alias("null_id"), F.coalesce(key, F.lit(0)).alias("id"), F.coalesce(named(part_col).cast("string"), F.lit("")).alias("part"))
    rows = rows.repartitionByRange("fp", "null_id", "id").sortWithinPartitions("fp", "text", "null_id", "id").withColumn("pid", F.spark_partition_id())
    marks = written(rows.mapInArrow(_marker(dict(filters), duplicate), _MARKS_SQL), "marks")
    # Of the runs at both ends of all partitions (two for each partition, but for colliding fingerprints), the least id of each text.
    ends = marks.where("end").select("pid", "run", "fp", "text", F.struct("null_id", "id").alias("least"))
    first = ends.groupBy("fp", "text").agg(F.min("least").alias("first"))
    begun = ends.join(first, ["fp", "text"]).where("first < least").select(F.col("pid").alias("b_pid"), F.col("run").alias("b_run")).distinct()
    rows = marks.where("NOT end").select(F.when(~F.col("null_id"), F.col("id")).alias("id"), "part", "fails", "pid", "run")
    open_rows = rows.where("run IS NOT NULL").join(begun, (F.col("pid") == F.col("b_pid")) & (F.col("run") == F.col("b_run")), "left")
    closed = open_rows.withColumn("fails", F.when(F.col("b_run").isNotNull(), F.concat("fails", F.lit(duplicate))).otherwise(F.col("fails")))
    return rows.where("run IS NULL").select("id", "part", "fails").unionByName(closed.select("id", "part", "fails"))


def _marker(filters: Mapping[str, Filter], duplicate: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For the sorted rows of a partition: their failures, and a row (end) for each run of equal texts at either end of it.

    `run` numbers the runs that share the partition's first fingerprint, on the rows that are first in them (all with the run's least id).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = last = None  # the partition's first fingerprint; of the last row: (fp, text, first key of its run, run, failures)
        runs, tail, pid = 0, [], 0  # runs begun so far; the runs of the last fingerprint that weren't written yet
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fp, null_id, ids = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in (0, 2, 3))
            texts, pid = batch.column(1), batch.column(5)[0].as_py()
            head = fp[0] if head is None else head
            new = np.ones(n, bool)
            new[1:] = (fp[1:] != fp[:-1]) | ~np.asarray(pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False), bool)
            if last is not None and last[0] == fp[0] and last[1] == texts[0].as_py():
                new[0] = False
            starts = np.flatnonzero(new)
            found = [failed(t.as_py(), filters) for t in (texts[int(i)] for i in starts)]
            own = np.cumsum(new)  # 0: the run goes on from the batch before
            keys = [last[2] if last else None, *((bool(null_id[i]), int(ids[i])) for i in starts)]
            numbers = [last[3] if last else None, *range(runs, runs + len(starts))]
            fails = [last[4] if last else None, *found]
            prints = [last[0] if last else None, *fp[starts].tolist()]
            ends = []
            for k, at in enumerate(starts.tolist(), 1):
                if tail and tail[0][2] != prints[k]:
                    tail = []
                record = (pid, numbers[k], prints[k], at, keys[k])
                if prints[k] == head:
                    ends.append((*record[:3], texts[at].as_py(), keys[k]))
                else:  # written only if no other fingerprint follows in the partition
                    tail.append((*record[:3], texts[at].as_py() if prints[k] == fp[-1] else None, keys[k]))
            least_null, least_id = (np.array([k[j] if k else 0 for k in keys])[own] for j in (0, 1))
            first = (null_id == least_null) & (ids == least_id)
            is_head = np.array([p == head for p in prints])[own]
            which = np.array(numbers[1:] if numbers[0] is None else numbers, dtype=np.int64)[own - (numbers[0] is None)]
            letters = np.array([f or "" for f in fails], dtype=object)[own]
            letters = np.where(first, letters, letters + duplicate)
            yield _marked(False, ids, batch.column(4), letters, pid, pa.array(which, mask=~(first & is_head)), fp, pa.nulls(n, pa.string()), null_id)
            if ends:
                yield _ends(ends)
            runs += len(starts)
            last = (int(fp[-1]), texts[n - 1].as_py(), keys[-1], numbers[-1], fails[-1])
        if tail:
            yield _ends(tail)

    return run


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    pid, run, fp, text, key = zip(*rows)
    return _marked(True, [k[1] for k in key], pa.nulls(len(rows), pa.string()), [None] * len(rows), pid[0], list(run), list(fp), list(text), [k[0] for k in key])


def _marked(end, ids, part, fails, pid, run, fp, text, null_id) -> pa.RecordBatch:
    n = len(ids)
    cols = [pa.array(np.full(n, end)), ids, part, fails, pa.array(np.full(n, pid, np.int32)), run, fp, text, null_id]
    return pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(t.type) for c, t in zip(cols, _MARKS)], schema=_MARKS)


def interactions(failures: DataFrame, labels: DataFrame, letters: str, id_col: str = "doc_id", good: Column | None = None, toxic: Column | None = None) -> DataFrame:
    """(id, part, fails) and labels -> a row for each part, order of the letters and step, with the counts of that step.

    kept, removed, redundant (fails here, removed earlier), unique_fails (fails nothing else), good_lost and toxic_lost (removed here with
    such a label), shapley (removed by the step's filter, over all orders). A document has a label if any row of its id has it; rows with a
    null id have none. Equal rows are combined before the labels are joined, so that an id that repeats is no hot key. The work on orders
    is on 2^letters counts for each part, letters! x letters rows for each.
    """
    orders = ["".join(p) for p in permutations(letters)]
    good = F.col("quality") == 1 if good is None else good
    toxic = F.col("toxic") == 1 if toxic is None else toxic
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("l_id"), F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(toxic, F.lit(False)).alias("toxic"))
    known = known.where("l_id IS NOT NULL").groupBy("l_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = failures.groupBy("id", "part", "fails").agg(F.count("*").alias("n"))
    labelled = rows.where("id IS NOT NULL").join(known, F.col("id") == F.col("l_id"), "left").select("part", "fails", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    bare = rows.where("id IS NULL").select("part", "fails", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    only = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    counts = labelled.unionByName(bare).groupBy("part", "fails").agg(F.sum("n").alias("n"), only(F.col("good")).alias("good"), only(F.col("toxic")).alias("toxic"))
    steps = counts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    steps = steps.withColumns({"letter": F.expr("substring(filter_order, step, 1)"), "earlier": F.expr("substring(filter_order, 1, step - 1)")})
    fails, gone = F.expr("instr(fails, letter) > 0"), F.expr("translate(earlier, fails, '') <> earlier")
    here = fails & ~gone
    share = F.expr(f"n * ({len(orders)} div greatest(length(fails), 1))")
    some = lambda c, x="n": F.sum(F.when(c, F.col(x)).otherwise(0)).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        some(~fails & ~gone).alias("kept"), some(here).alias("removed"), some(fails & gone).alias("redundant"), some(F.col("fails") == F.col("letter")).alias("unique_fails"),
        some(here, "good").alias("good_lost"), some(here, "toxic").alias("toxic_lost"), F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return interactions(failures(docs), labels, "".join(FILTERS) + DUPLICATE)


ORACLE = {
    "op13_filter_audit": r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
           || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
    FROM texts LEFT JOIN known USING (doc_id)),
counts AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, fails),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
    SELECT *, filter_order[step] AS letter, contains(fails, filter_order[step]) AS failing,
           len(list_filter(string_split(fails, ''), lambda c: c <> '' AND contains(filter_order[1:step - 1], c))) > 0 AS gone
    FROM counts, orders, (SELECT unnest(range(1, 6))::INT AS step))
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * (120 // greatest(length(fails), 1))) FILTER (failing), 0)::BIGINT AS shapley
FROM steps GROUP BY part, filter_order, step""",
}
