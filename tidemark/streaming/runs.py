"""Starting streams, sinks and micro-batch handlers."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from tidemark.session import matching, remove_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parquet_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _started(writer, trigger: str | None) -> StreamingQuery:
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def to_parquet(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), trigger: str | None = None) -> StreamingQuery:
    """Append to Parquet files, exactly once. Without ``trigger`` the query takes what is there and ends."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return _started(writer.partitionBy(*partition_by) if partition_by else writer, trigger)


def to_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", trigger: str | None = None) -> StreamingQuery:
    return _started(df.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint), trigger)


def batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch into its own folder; a repeated batch overwrites its folder."""

    def handle(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return handle


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last update per key over all batch folders."""
    rows = spark.read.option("basePath", path).parquet(path)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("_last", last).filter("_last = 1").drop("_last", "batch")


def last_batch(spark: SparkSession, path: str) -> DataFrame:
    """The newest batch folder, with or without rows: the whole result in complete mode."""
    rows = spark.read.option("basePath", path).parquet(path)
    newest = max(int(name) for file in rows.inputFiles() for name in re.findall(r"/batch=([0-9]+)/", file))
    return rows.filter(F.col("batch") == newest).drop("batch")


class ChangeLog:
    """The latest row per key of a stream, as one folder per micro-batch and a copy that folds the older ones.

    A repeated batch overwrites its own folder, so a replay changes nothing; a folder counts once Spark has marked it complete. Every
    ``fold_every`` batches what is known is folded into one copy; folders that the copy before already held are
    removed, so a reader that began with that one still finds its files. Within a batch the largest ``order`` wins (of equals
    the row with the larger digest), between batches the later one. NULL keys are one key. Picking the winner is an aggregate, combined before
    its shuffle, however often a key comes. ``schema`` names the columns of the stream; ``batch_id`` and ``written_at`` are added.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, schema: StructType, fold_every: int = 16):
        self.spark, self.path, self.key, self.order, self.fold_every = spark, path, key, order, fold_every
        self.schema = StructType([*schema.fields, StructField("batch_id", LongType()), StructField("written_at", TimestampType())])

    def __call__(self, rows: DataFrame, batch: int) -> None:
        """The handler for ``to_batches``."""
        names = [f.name for f in self.schema.fields if f.name not in ("batch_id", "written_at")]
        newest = self._winner(rows.select(*names), F.struct(self.order, F.xxhash64(*names)))
        stamped = newest.withColumns({"batch_id": F.lit(batch).cast("long"), "written_at": F.current_timestamp()})
        stamped.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if (batch + 1) % self.fold_every == 0:
            self.fold(batch)

    def read(self) -> DataFrame:
        folded = self._complete("upto")
        start = max(folded, default=-1)
        parts = [f"{self.path}/upto={start}"] if folded else []
        parts += [f"{self.path}/batch={b}" for b in self._complete("batch") if b > start]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*parts)
        return self._winner(rows, F.col("batch_id"))

    def fold(self, batch: int) -> None:
        """Writes the latest rows up to ``batch`` as one copy."""
        before = max((b for b in self._complete("upto") if b < batch), default=-1)
        parts = [f"{self.path}/upto={before}"] if before >= 0 else []
        parts += [f"{self.path}/batch={b}" for b in self._complete("batch") if before < b <= batch]
        rows = self.spark.read.schema(self.schema).parquet(*parts)
        self._winner(rows, F.col("batch_id")).write.mode("overwrite").parquet(f"{self.path}/upto={batch}")
        for kind, numbers in (("batch", self._complete("batch")), ("upto", self._complete("upto"))):
            for number in numbers:
                if number < before or (kind == "batch" and number == before):
                    remove_path(self.spark, f"{self.path}/{kind}={number}")

    def _winner(self, rows: DataFrame, by: Column) -> DataFrame:
        best = rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), by).alias("_row"))
        return best.select("_row.*")

    def _complete(self, kind: str) -> list[int]:
        return sorted(int(re.search(rf"{kind}=([0-9]+)/", f)[1]) for f in matching(self.spark, f"{self.path}/{kind}=*/_SUCCESS"))


def batch_totals(path: str, value: str) -> Callable[[DataFrame, int], None]:
    """One metrics row per micro-batch."""

    def handle(rows: DataFrame, batch: int) -> None:
        totals = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.round(F.sum(value), 2), F.lit(0.0)).alias("total"))
        totals.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return handle


class ProgressLog(StreamingQueryListener):
    """Notes every progress report of the queries that start while it listens, one small row per micro-batch."""

    def __init__(self):
        self.rows: dict[tuple[str, int], tuple[int, int, float, float]] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        old = self.rows.get((str(p.id), p.batchId))
        if old is None or p.numInputRows > old[1]:  # an idle report repeats its batch id
            self.rows[str(p.id), p.batchId] = (p.batchId, p.numInputRows, float(p.inputRowsPerSecond or 0.0), float(p.processedRowsPerSecond or 0.0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def table(self, spark: SparkSession, query: StreamingQuery) -> DataFrame:
        """Batch id, input rows and rates of all batches of a query that has ended, over all its runs here."""
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(60):  # reports arrive in order, its end last
            raise TimeoutError(f"the end of query {query.id} has not been reported; rows of its last batches may be missing")
        rows = [r for (id, _), r in sorted(self.rows.items()) if id == str(query.id)]
        return spark.createDataFrame(rows, "batch_id long, input_rows long, input_rate double, processed_rate double")


@contextmanager
def progress_log(spark: SparkSession):
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        yield log
    finally:
        spark.streams.removeListener(log)


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKSDB):
    """Queries started inside use the given state store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.set(key, before)
