"""Sources and sinks: each query writes a given table in one form and returns what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.plans.inputs import table
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources import files, generate, sinks

ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


@query("src_01_parquet_glob", "SELECT o_orderkey, o_orderstatus FROM orders")
def parquet_glob(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/order[s].parquet").select("o_orderkey", "o_orderstatus")


@query("src_02_drifting_files", ORDERS_SQL)
def drifting_files(spark: SparkSession, d: str) -> DataFrame:
    """Yearly folders as the monthly files; the folders of years without data are skipped."""
    base = scratch_path(spark, "yearly")
    _orders(spark, d).withColumn("year", F.year("o_orderdate")).write.partitionBy("year").parquet(base)
    paths = [f"{base}/year={year}" for year in range(1990, 2010)]
    return files.read_drifting(spark, paths, {"o_custkey": "bigint"})


@query(
    "src_03_partition_pruning",
    f"SELECT *, year(o_orderdate) AS year, month(o_orderdate) AS month FROM ({ORDERS_SQL}) WHERE year(o_orderdate) = 1997 AND month(o_orderdate) IN (1, 2)",
)
def partition_pruning(spark: SparkSession, d: str) -> DataFrame:
    base = scratch_path(spark, "calendar")
    sinks.write_by_calendar(_orders(spark, d), "o_orderdate", base)
    return files.read_partitions(spark, base).filter((F.col("year") == 1997) & F.col("month").isin(1, 2))


@query("src_04_csv", ORDERS_SQL)
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, orders = scratch_path(spark, "csv"), _orders(spark, d)
    orders.write.option("header", "true").csv(path)
    return spark.read.schema(orders.schema).option("header", "true").csv(path)


@query("src_05_json", ORDERS_SQL)
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, orders = scratch_path(spark, "json"), _orders(spark, d)
    orders.write.json(path)
    return spark.read.schema(orders.schema).json(path)


@query("src_06_text", "SELECT event_id || '|' || event_type AS value FROM events")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "text")
    sinks.write_lines(table(spark, d, "events").select("event_id", "event_type"), path)
    return spark.read.text(path)


@query("src_10_pandas_round_trip", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def pandas_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Through pandas by Arrow; only the handful of groups passes the driver."""
    small = table(spark, d, "events").groupBy("event_type").agg(agg.n_rows("n"), F.round(F.sum("value"), 2).alias("total"))
    return spark.createDataFrame(small.toPandas())


@query(
    "src_11_id_modes",
    """SELECT o_orderkey % 10 AS skew_key, count(*) AS n, sum(o_orderkey)::BIGINT AS id_sum,
              count(CASE WHEN o_orderkey % 100 <> 0 THEN 1 END) AS values FROM orders GROUP BY 1""",
)
def id_modes(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    moded = generate.with_mode(generate.with_mode(ids, "skew"), "nulls")
    return moded.groupBy("skew_key").agg(agg.n_rows("n"), F.sum("id").alias("id_sum"), F.count("value").alias("values"))


EVENT_SCHEMA = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, ts TIMESTAMP_NTZ"


def envelopes(events: DataFrame) -> DataFrame:
    """The event table as a message log: key, JSON bytes and arrival time."""
    body = F.to_json(F.struct("event_id", "user_id", "event_type", "value", "ts"))
    return events.select(
        F.col("event_id").cast("string").cast("binary").alias("key"), body.cast("binary").alias("value"),
        F.col("ts").alias("timestamp"),
    )


@query("src_13_json_messages", "SELECT event_id, user_id, event_type, value, date_trunc('millisecond', ts)::TIMESTAMP AS ts FROM events")
def json_messages(spark: SparkSession, d: str) -> DataFrame:
    raw = envelopes(table(spark, d, "events"))
    return files.parse_events(raw, EVENT_SCHEMA).drop("processing_time")


@query("src_14_events_of_day", "SELECT event_id, user_id, event_type, value FROM events WHERE ts::DATE = DATE '2024-01-15'")
def events_of_day(spark: SparkSession, d: str) -> DataFrame:
    log = scratch_path(spark, "log")
    envelopes(table(spark, d, "events")).select(F.col("value").cast("string")).write.text(log)
    return files.events_of_day(spark.read.text(log), EVENT_SCHEMA, "ts", "2024-01-15").drop("ts")


@query("src_15_file_bytes")
def file_bytes(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "bytes")
    sinks.write_files(_orders(spark, d), path, 4)
    return files.read_bytes(spark, path, "*.parquet").select("length", F.md5("content").alias("md5"))


@query("src_15_text_bytes", "SELECT n_nationkey, length(n_name) + 1 AS length, md5(n_name || chr(10)) AS md5 FROM nation")
def text_bytes(spark: SparkSession, d: str) -> DataFrame:
    """One text file per nation, read as bytes."""
    path = scratch_path(spark, "names")
    table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(path)
    found = files.read_bytes(spark, path, "*.txt")
    key = F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int")
    return found.select(key.alias("n_nationkey"), "length", F.md5("content").alias("md5"))


@query("snk_03_overwrite", f"{ORDERS_SQL} WHERE o_totalprice > 100000")
def overwrite(spark: SparkSession, d: str) -> DataFrame:
    path, orders = scratch_path(spark, "overwrite"), _orders(spark, d)
    orders.write.mode("overwrite").parquet(path)
    orders.filter("o_totalprice > 100000").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query(
    "snk_04_calendar_partitions",
    "SELECT year(ts) AS year, month(ts) AS month, dayofmonth(ts) AS day, count(*) AS n FROM events GROUP BY 1, 2, 3",
)
def calendar_partitions(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "days")
    sinks.write_by_calendar(table(spark, d, "events"), "ts", path, day=True)
    return files.read_partitions(spark, path).groupBy("year", "month", "day").agg(agg.n_rows("n"))


@query("snk_05_catalog_table", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def catalog_table(spark: SparkSession, d: str) -> DataFrame:
    name = f"tidemark_events_{uuid.uuid4().hex[:12]}"
    events = table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    sinks.save_table(events, name, ["event_type"], path=scratch_path(spark, "table"))
    return spark.table(name).groupBy("event_type").agg(agg.n_rows("n"))


@query("snk_06_file_count", "SELECT 5 AS files, count(*) AS n FROM orders")
def file_count(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "five")
    sinks.write_files(_orders(spark, d), path, 5)
    rows = spark.read.parquet(path).withColumn("file", F.input_file_name())
    return rows.agg(F.countDistinct("file").cast("int").alias("files"), agg.n_rows("n"))


@query(
    "snk_07_merged_schema",
    """SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS o_orderpriority
       FROM orders""",
)
def merged_schema(spark: SparkSession, d: str) -> DataFrame:
    path, orders = scratch_path(spark, "merge"), table(spark, d, "orders")
    old = ["o_orderkey", "o_custkey", "o_totalprice"]
    orders.filter("o_orderstatus <> 'F'").select(*old).write.parquet(path)
    orders.filter("o_orderstatus = 'F'").select(*old, "o_orderpriority").write.mode("append").parquet(path)
    return files.read_merged(spark, path)


@query(
    "snk_09_bucketed_join",
    """SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def bucketed_join(spark: SparkSession, d: str) -> DataFrame:
    tag = uuid.uuid4().hex[:12]
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_extendedprice")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_orderpriority")
    buckets = sinks.buckets_for(lines)  # both tables need the same number
    sinks.save_bucketed(lines, f"tidemark_lines_{tag}", "orderkey", buckets, scratch_path(spark, "bucket"))
    sinks.save_bucketed(orders, f"tidemark_orders_{tag}", "orderkey", buckets, scratch_path(spark, "bucket"))
    joined = spark.table(f"tidemark_lines_{tag}").join(spark.table(f"tidemark_orders_{tag}").hint("merge"), "orderkey")
    return joined.groupBy("o_orderpriority").agg(agg.n_rows("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
