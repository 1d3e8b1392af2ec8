"""File and table writers. All of them run a job."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import estimated_bytes
from tidemark.session import make_path
from tidemark.sources.files import file_system


def with_calendar(df: DataFrame, ts: str, day: bool = False) -> DataFrame:
    parts = {"year": F.year(ts), "month": F.month(ts)}
    return df.withColumns({**parts, "day": F.dayofmonth(ts)} if day else parts)


def write_by_calendar(df: DataFrame, ts: str, path: str, day: bool = False, files_per_part: int | None = None) -> None:
    """Partitioned by year and month (and day).

    Rows are rebalanced by partition first: a task writes few partitions, and Spark splits a hot month among
    tasks. With ``files_per_part`` they are spread over that many buckets per partition instead,
    which bounds the file count.
    """
    cut = with_calendar(df, ts, day)
    parts = ["year", "month", "day"] if day else ["year", "month"]
    if files_per_part:
        spread = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_part))
        cut = cut.repartition(*parts, spread)
    else:
        cut = cut.hint("rebalance", *parts)
    cut.write.mode("overwrite").partitionBy(*parts).parquet(path)


def write_line_folders(df: DataFrame, name: str, value: str, path: str) -> int:
    """One folder ``name=...`` with one text file for each value of ``name``, a line per row; returns the number of folders.

    For very many small folders: tasks make the files themselves, where Spark's writer takes several milliseconds for each. A file gets its name
    once it is whole, and a repeated task puts the same file in its place; unfinished ones start with ``_``, which readers skip.
    """

    def run(batches):
        fs, root = file_system(path)
        count, last, out, begun, done = 0, None, None, "", ""

        def finish():
            out.close()
            fs.move(begun, done)

        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None or key != last:
                    if out is not None:
                        finish()
                    folder = f"{root}/{name}={'__HIVE_DEFAULT_PARTITION__' if key is None else quote(key, safe='')}"
                    fs.create_dir(folder)
                    begun, done, last, count = f"{folder}/_{uuid.uuid4().hex}", f"{folder}/part-00000.txt", key, count + 1
                    out = fs.open_output_stream(begun)
                out.write((line or "").encode() + b"\n")
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["folders"])

    make_path(df.sparkSession, path)  # also if there are no rows
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(value).alias("value")).repartition("name").sortWithinPartitions("name")
    return rows.mapInArrow(run, "folders long").agg(F.coalesce(F.sum("folders"), F.lit(0))).first()[0]


def buckets_for(df: DataFrame, target_mb: int = 256, least: int = 8) -> int:
    """A bucket count (a power of two) that keeps buckets of ``df`` near ``target_mb`` by the optimizer's estimate."""
    wanted = estimated_bytes(df) / (target_mb << 20)
    return max(least, 1 << max(0, math.ceil(math.log2(max(wanted, 1)))))


def write_files(df: DataFrame, path: str, files: int, shuffle: bool = True) -> None:
    """Exactly ``files`` files by repartition, or at most that many by coalesce."""
    (df.repartition(files) if shuffle else df.coalesce(files)).write.mode("overwrite").parquet(path)


def write_lines(df: DataFrame, path: str, separator: str = "|") -> None:
    line = F.concat_ws(separator, *[F.col(c).cast("string") for c in df.columns])
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def save_table(df: DataFrame, name: str, partition_by: Sequence[str] = (), path: str | None = None) -> None:
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """Bucketed and sorted by ``key``: two tables cut alike join on it without a shuffle.

    The frame is first hash-partitioned into the buckets so that each bucket becomes one sorted file.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def export_forecast(forecast: DataFrame, base: str, version: str) -> str:
    path = f"{base}/v{version}"
    forecast.write.mode("overwrite").option("header", "true").csv(path)
    return path
