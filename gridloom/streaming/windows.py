"""Grouped collapses over a stream of events: fixed and sliding periods, sessions, and appending to a stored field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.folders import new_folder


def read_events(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """The events table as a stream of files, with ts as an event time."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _collapsed(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))


def tumbling(events: DataFrame, period: str, by: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Statistics of fixed periods; events later than `late` are too late for a period that was closed."""
    got = _collapsed(events.withWatermark("ts", late).groupBy(F.window("ts", period), *by))
    return got.select(F.col("window.start").alias("start"), *by, "n", "total", "minimum", "maximum")


def sliding(events: DataFrame, period: str, step: str, by: Sequence[str], late: str = "1 hour") -> DataFrame:
    """A moving window in time."""
    got = _collapsed(events.withWatermark("ts", late).groupBy(F.window("ts", period, step), *by))
    return got.select(F.col("window.start").alias("start"), *by, "n", "total", "minimum", "maximum")


def sessions(events: DataFrame, gap: str, by: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Runs of events without a gap: not the same as runs of a condition, which are a batch operator."""
    got = _collapsed(events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *by))
    return got.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n", "total", "minimum", "maximum")


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is into a table in the shared folder, which each batch writes from its tasks: nothing goes through the driver.

    A complete result replaces that of the batch before; otherwise a batch has a folder of its own, so that one that runs twice counts once.
    """
    folder = new_folder(stream.sparkSession, name)

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={0 if mode == 'complete' else batch}")

    stream.writeStream.outputMode(mode).foreachBatch(store).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(folder)


def append_to_field(stream: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ()):
    """Append a stream's rows to a stored field, once and only once; returns the running query."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(*by) if by else writer).start()
