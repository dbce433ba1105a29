"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder under spark.checkpoint.dir (or the one given to setCheckpointDir), deleted when the session's JVM ends.

    Only in local mode, where neither is set, a folder of this machine; on a cluster executors don't see one another's disks.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = chosen.get() if chosen.isDefined() else None
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = f"file://{own}"
    uri = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return uri


def as_file(uri: str) -> str:
    """The path of a folder that every task can open as files, such as a mounted one; formats that aren't Spark's own need that."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri} can't be opened as files: netCDF and Zarr need a spark.checkpoint.dir that is mounted on all machines (file://...)")
    return uri


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in a new folder, read back: what several steps read is computed once, and lost executors lose nothing."""
    uri = f"{new_folder(df.sparkSession, name)}/table"
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)
