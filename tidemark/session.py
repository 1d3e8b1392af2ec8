"""Session settings and the shared working folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    # the Python call site of every expression is for error messages; collecting it takes longer than building the plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def shuffle_partitions(data_gb: float, target_mb: int = 128) -> int:
    """``spark.sql.shuffle.partitions`` for the data that passes a shuffle; AQE merges what is too many."""
    return max(200, int(data_gb * 1024 / target_mb))


def build_session(app_name: str = "tidemark", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above. ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_BASE: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting gets a temporary folder; a cluster session without
    it is an error, since a folder of one machine is lost with that machine.
    """
    global _LOCAL_BASE
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _LOCAL_BASE is None or not os.path.isdir(_LOCAL_BASE):
        _LOCAL_BASE = tempfile.mkdtemp(prefix="tidemark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_LOCAL_BASE)
    return _LOCAL_BASE


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end_with_it(spark: SparkSession):
    """Writes in this block delete their shuffle files when they are through; else those stay until the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back (an action).

    Cuts lineage so that later passes re-read columns instead of recomputing joins, and survives the
    loss of any executor. The write's shuffle files go with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    with shuffles_end_with_it(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def make_path(spark: SparkSession, path: str) -> None:
    """Makes a folder, and those above it, if it is not there."""
    fs, place = _file_system(spark, path)
    fs.mkdirs(place)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file with all below it, if it is there."""
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def publish_path(spark: SparkSession, staged: str, path: str) -> None:
    """Puts a finished folder in the place of another; readers see the old one, for a moment none, then the new one."""
    fs, place = _file_system(spark, path)
    fs.delete(place, True)
    if not fs.rename(_file_system(spark, staged)[1], place):
        raise OSError(f"cannot move {staged} to {path}")


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Folders and files that match a pattern such as ``/log/kind=*/date=*``; the contents of folders are not listed."""
    fs, place = _file_system(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(place) or []))


def release(*written: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote, once nothing that is still to run reads them.

    Shuffle files of finished jobs go with them: Spark frees those when the driver collects its garbage, which a driver with room to spare
    would do too late for the disks of the executors.
    """
    for df in written:
        remove_path(df.sparkSession, df._written_at)
    if written:
        gc.collect()
        written[0].sparkSession._jvm.System.gc()


class Scratch:
    """Tables that ``materialize`` writes for one operator, released together when it is through."""

    def __init__(self):
        self.written: list[DataFrame] = []

    def write(self, df: DataFrame, purpose: str) -> DataFrame:
        self.written.append(materialize(df, purpose))
        return self.written[-1]

    def release(self, *some: DataFrame) -> None:
        """Releases these tables, or all."""
        gone = list(some) or self.written
        self.written = [df for df in self.written if not any(df is g for g in gone)]
        release(*gone)


class Steps:
    """Rows written step by step below one folder; all of them are one scan, however many steps there are."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.path, self.count, self.schema = spark, scratch_path(spark, purpose), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Write the next step (counted from 0) and read it back (an action)."""
        self.schema = df.schema
        path = f"{self.path}/_step={self.count}"
        with shuffles_end_with_it(self.spark):
            df.write.parquet(path)
        self.count += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        """All rows so far, with their ``_step``."""
        schema = StructType([*self.schema.fields, StructField("_step", IntegerType())])
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(f"{self.path}/_step=*")
