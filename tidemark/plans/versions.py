"""Versioned tables over the orders and events tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.versioned import VersionedTable
from tidemark.plans.inputs import table
from tidemark.plans.registry import query
from tidemark.session import scratch_path

BASE_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _new(spark: SparkSession, df: DataFrame, partition_by=("o_orderstatus",), at="2024-01-01 00:00:00") -> VersionedTable:
    out = VersionedTable(spark, scratch_path(spark, "versioned"))
    out.create(df, partition_by, at=at)
    return out


def _open(spark: SparkSession, d: str) -> VersionedTable:
    """Version 0 holds the settled orders, version 1 the pending ones as well."""
    orders = _orders(spark, d)
    out = _new(spark, orders.filter("o_orderstatus <> 'P'"))
    out.append(orders.filter("o_orderstatus = 'P'"), at="2024-01-02 00:00:00")
    return out


@query("tbl_01_create_partitioned", "SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1, 2")
def create_partitioned(spark: SparkSession, d: str) -> DataFrame:
    """By day, then replaced with a frame partitioned by day and type."""
    events = table(spark, d, "events").select("event_id", "ts", "event_type")
    t = _new(spark, events.limit(0), [("days", "ts")])
    t.create(events, [("days", "ts"), "event_type"])
    return t.read().groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("tbl_02_append", BASE_SQL)
def append(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).read()


@query("tbl_03_insert_from_itself", f"{BASE_SQL} UNION ALL {BASE_SQL} WHERE o_orderstatus = 'F'")
def insert_from_itself(spark: SparkSession, d: str) -> DataFrame:
    t = _open(spark, d)
    t.append(t.read().filter("o_orderstatus = 'F'"))
    return t.read()


@query(
    "tbl_04_update",
    """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN o_totalprice + o_custkey ELSE o_totalprice END
       AS o_totalprice FROM orders""",
)
def update(spark: SparkSession, d: str) -> DataFrame:
    t = _open(spark, d)
    t.update({"o_totalprice": F.col("o_totalprice") + F.col("o_custkey")}, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000))
    return t.read()


@query("tbl_04_update_map_key", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'home' END AS page, json_extract(props, '$.k')::INT AS k FROM events""")
def update_map_key(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.versioned import put_key

    events = table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("props"))
    t = _new(spark, events, ["event_type"])
    t.update({"props": put_key(F.col("props"), "page", F.lit("home"))}, F.col("event_type") == "click")
    props = F.col("props")
    return t.read().select("event_id", F.try_element_at(props, F.lit("page")).alias("page"), F.try_element_at(props, F.lit("k")).cast("int").alias("k"))


@query("tbl_05_delete", f"{BASE_SQL} WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 200000)")
def delete(spark: SparkSession, d: str) -> DataFrame:
    t = _open(spark, d)
    t.delete((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 200000))
    return t.read()


@query("tbl_06_time_travel", """SELECT 'version 0' AS at, count(*) FILTER (o_orderstatus <> 'P') AS n FROM orders
    UNION ALL SELECT 'version 1', count(*) FROM orders UNION ALL SELECT 'noon', count(*) FILTER (o_orderstatus <> 'P') FROM orders""")
def time_travel(spark: SparkSession, d: str) -> DataFrame:
    t = _open(spark, d)
    t.delete(F.col("o_totalprice") > 0, at="2024-01-03 00:00:00")
    views = {"version 0": t.read(version=0), "version 1": t.read(version=1), "noon": t.read(as_of="2024-01-01 12:00:00")}
    parts = [v.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("at"), "n") for name, v in views.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


MERGED_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority = '1-URGENT'"""


@query("tbl_07_merge", MERGED_SQL)
def merge(spark: SparkSession, d: str) -> DataFrame:
    """The urgent orders at twice their price: updates of settled orders, inserts of pending ones."""
    orders = table(spark, d, "orders")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    t = _new(spark, _orders(spark, d).filter("o_orderstatus <> 'P'"))
    t.merge(urgent, ["o_orderkey"])
    return t.read()


@query("tbl_08_history", """SELECT 0 AS version, 'create' AS operation, 2 AS live_folders UNION ALL SELECT 1, 'append', 3 UNION ALL SELECT 2, 'delete', 3 FROM (SELECT count(*) FROM orders)""")
def history(spark: SparkSession, d: str) -> DataFrame:
    t = _open(spark, d)
    t.delete((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 200000))
    return t.history().select("version", "operation", "live_folders")


@query("tbl_08_partitions", "SELECT 'p0=' || o_orderstatus AS partition, count(*) AS n FROM orders GROUP BY 1")
def partitions(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).partitions()


@query("tbl_09_rollback", f"{BASE_SQL} WHERE o_orderstatus <> 'P'")
def rollback(spark: SparkSession, d: str) -> DataFrame:
    """Back to version 0, forward to 1, and back to the state at noon of the first day."""
    t = _open(spark, d)
    t.rollback(version=0, at="2024-01-03 00:00:00")
    t.rollback(version=1, at="2024-01-04 00:00:00")
    t.rollback(as_of="2024-01-01 12:00:00")
    return t.read()


@query("tbl_10_cherry_pick", BASE_SQL)
def cherry_pick(spark: SparkSession, d: str) -> DataFrame:
    t = _open(spark, d)
    t.rollback(version=0)
    t.cherry_pick(1)
    return t.read()


@query(
    "tbl_11_add_drop_column",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'EUR' ELSE 'USD' END AS currency, NULL::INT AS note FROM orders""",
)
def add_drop_column(spark: SparkSession, d: str) -> DataFrame:
    t = _new(spark, _orders(spark, d).filter("o_orderstatus <> 'P'"))
    t.add_column("currency", "string", default="'USD'")
    t.add_column("note", "int")
    t.drop_column("o_custkey")
    t.append(_orders(spark, d).filter("o_orderstatus = 'P'").drop("o_custkey").withColumn("currency", F.lit("EUR")))
    return t.read()


@query("tbl_12_rename_column", "SELECT o_orderkey, o_custkey, o_orderstatus AS state, o_totalprice AS amount FROM orders")
def rename_column(spark: SparkSession, d: str) -> DataFrame:
    t = _open(spark, d)
    t.rename_column("o_totalprice", "amount")
    t.rename_column("o_orderstatus", "state")
    return t.read()


@query("tbl_13_widen_type", "SELECT p_partkey, (p_size + CASE WHEN p_size > 25 THEN 3000000000 ELSE 0 END)::BIGINT AS p_size FROM part")
def widen_type(spark: SparkSession, d: str) -> DataFrame:
    t = _new(spark, table(spark, d, "part").select("p_partkey", "p_size"), ())
    t.widen_column("p_size", "bigint")
    t.update({"p_size": F.col("p_size") + F.lit(3000000000)}, F.col("p_size") > 25)
    return t.read()


@query("tbl_14_partition_evolution", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1")
def partition_evolution(spark: SparkSession, d: str) -> DataFrame:
    """By status first, then by status and customer bucket, then by bucket alone."""
    orders = _orders(spark, d)
    t = _new(spark, orders.filter("o_orderstatus = 'F'"))
    t.set_partitions(["o_orderstatus", ("bucket", "o_custkey", 4)])
    t.append(orders.filter("o_orderstatus = 'O'"))
    t.set_partitions([("bucket", "o_custkey", 4)])
    t.append(orders.filter("o_orderstatus = 'P'"))
    return t.read().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("tbl_15_expire", f"{BASE_SQL} WHERE o_orderstatus <> 'F'")
def expire(spark: SparkSession, d: str) -> DataFrame:
    t = _open(spark, d)
    t.delete(F.col("o_orderstatus") == "F", at="2024-01-03 00:00:00")
    t.expire(keep_last=1, older_than="2024-01-05 00:00:00")
    return t.read()


@query("tbl_16_compact", BASE_SQL)
def compact(spark: SparkSession, d: str) -> DataFrame:
    t = _open(spark, d)
    t.set_partitions([])
    t.compact()
    return t.read()
