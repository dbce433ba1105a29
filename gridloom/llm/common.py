"""Helpers that the operators share: the shared work folder, written tables, and connected components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one that setCheckpointDir was given; a folder of our own only where both are unset in
    local mode (tests), as executors of a cluster don't see one another's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = chosen.get() if chosen.isDefined() else None
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="gridloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    The folder is deleted by release(), or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, fs = _place(spark, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(table: DataFrame) -> None:
    place, fs = _place(table.sparkSession, table.written_path)
    fs.delete(place, True)


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop the shuffle files of plans that are gone."""
    for t in tables:
        delete(t)
    if tables:
        drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are gone. The scheduler holds on to the last job's until another has run."""
    spark.range(0, 1, 1, 1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(c):
    """Number of words in a text column; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def _towards_minimum(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """rows (k, other): for each row, (k, other, m) with m the least of k and all of k's others; and the written table of minima.

    The minima are map-side combined and written, so that both sides of the join arrive by a plain
    exchange and a hub's rows can be split by adaptive skew handling.
    """
    least = written(rows.groupBy("k").agg(F.min("other").alias("m")).select("k", F.least("k", "m").alias("m")), label)
    return rows.join(least.hint("merge"), "k"), least


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components of edges (a, b) of long ids by alternating large-star and small-star rounds.

    Returns (id, component) for every id that has an edge, component being the smallest id reachable.
    Every round is a fixed number of joins and combinable minima, and its tables are deleted after it; nothing is collected but two
    counters. Rounds grow with the square of the logarithm of the ids at most. Null ends and loops are ignored; repeated edges do no
    harm; no edges give an empty table.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, last = written(e, "edges"), None
    for _ in range(max_rounds):
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last or not mark[0]:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
        last = mark
        both = e.select(F.col("a").alias("k"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("k"), F.col("a").alias("other")))
        large, least = _towards_minimum(both, "large")
        large = written(large.where("other > k").select(F.col("other").alias("k"), F.col("m").alias("other")).distinct(), "star")
        small, most = _towards_minimum(large, "small")
        small = small.select(F.explode(F.array(F.struct(F.col("other").alias("a"), F.col("m").alias("b")), F.struct(F.col("k").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        old, e = e, written(small.where("a <> b").distinct(), "edges")
        for t in (old, least, large, most):
            delete(t)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
