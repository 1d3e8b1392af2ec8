"""File readers."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import quote

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.sets import union_evolving


def read_drifting(
    spark: SparkSession,
    paths: Sequence[str],
    casts: Mapping[str, str] | None = None,
    on_skip: Callable[[str, Exception], None] | None = None,
) -> DataFrame:
    """Read Parquet files whose schemas drift: cast per file, union by name, skip unreadable files.

    Only schemas are resolved here; no rows are read. Raises ValueError when no file can be read.
    """
    frames = []
    for path in paths:
        try:
            frame = spark.read.parquet(path)
        except AnalysisException as exc:
            if on_skip:
                on_skip(path, exc)
            continue
        casts_here = {c: F.col(c).cast(t) for c, t in (casts or {}).items() if c in frame.columns}
        frames.append(frame.withColumns(casts_here) if casts_here else frame)
    if not frames:
        raise ValueError("no file could be read")
    return union_evolving(frames)


def read_partitions(spark: SparkSession, base: str, pattern: str = "") -> DataFrame:
    """Hive-style folders (``year=*/month=*``) with their partition columns kept."""
    return spark.read.option("basePath", base).parquet(f"{base}/{pattern}" if pattern else base)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """All columns of all files, from every footer."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def schema_from_json(text: str) -> StructType:
    """A schema given as JSON text."""
    return StructType.fromJson(json.loads(text))


def parse_events(raw: DataFrame, schema: StructType | str, processing_time: bool = True) -> DataFrame:
    """(key, value bytes, ...) rows to flat event rows; static and streaming frames alike."""
    parsed = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("event")).select("event.*")
    return parsed.withColumn("processing_time", F.current_timestamp()) if processing_time else parsed


def events_of_day(raw: DataFrame, schema: StructType | str, ts: str, day: str) -> DataFrame:
    """A bounded read of an event log: the events of one date."""
    return parse_events(raw, schema, processing_time=False).filter(F.to_date(ts) == F.lit(day).cast("date"))


def file_system(path: str) -> tuple[FileSystem, str]:
    """The file system of a path that Spark listed, for tasks that read parts of files, and the path there."""
    if path.startswith("file:"):
        return LocalFileSystem(), "/" + path[5:].lstrip("/")
    return FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe="/:@"))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Spark's own JSON event logs below ``path`` as (app_id, event, executor_id, time).

    A log is one file, or a folder of rolled ``events_N_...`` or ``part-...`` files. Only its start names the application, so its id
    is carried to the other lines of the log; lines of other events are dropped while they are read.
    """
    schema = "Event string, Timestamp long, `App ID` string, `Executor ID` string"
    lines = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    log = F.regexp_replace(F.col("_metadata.file_path"), r"/(events_[0-9]+_|part-)[^/]*$", "")
    kept = lines.select(log.alias("log"), F.regexp_replace("Event", "^SparkListener", "").alias("event"), "Timestamp", "App ID", "Executor ID")
    kept = kept.filter(F.col("event").isin("ApplicationStart", "ExecutorAdded"))
    ids = kept.filter("event = 'ApplicationStart'").groupBy("log").agg(F.max("App ID").alias("app_id"))
    return kept.join(ids, "log").select(
        "app_id", "event", F.col("Executor ID").alias("executor_id"), F.timestamp_millis("Timestamp").alias("time")
    )


def read_bytes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as (path, length, content); keep ``content`` out of a select and it is not read. Spark's reader leaves out empty files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
