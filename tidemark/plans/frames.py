"""The pandas API on Spark, caching and plan control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import control as ops
from tidemark.operators import frames
from tidemark.plans.inputs import table
from tidemark.plans.registry import query
from tidemark.session import shared_folder


def _events(spark: SparkSession, d: str):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value").pandas_api()


@query("pd_01_mask", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 100")
def mask(spark: SparkSession, d: str) -> DataFrame:
    return frames.masked(_events(spark, d), "click", 100.0)[["event_id", "value"]].to_spark()


@query(
    "pd_02_groupby_agg",
    """SELECT event_type, count(value) AS value_count, round(sum(value), 2) AS value_sum, max(value) AS value_max,
              count(DISTINCT user_id) AS user_id_nunique FROM events GROUP BY 1""",
)
def groupby_agg(spark: SparkSession, d: str) -> DataFrame:
    out = frames.flat_agg(_events(spark, d), "event_type", {"value": ["count", "sum", "max"], "user_id": ["nunique"]})
    return out.to_spark().withColumn("value_sum", F.round("value_sum", 2))


@query(
    "pd_03_describe",
    """SELECT 'count' AS stat, count(value)::DOUBLE AS value FROM events UNION ALL SELECT 'mean', round(avg(value), 6) FROM events
       UNION ALL SELECT 'std', round(stddev_samp(value), 6) FROM events UNION ALL SELECT 'min', min(value) FROM events
       UNION ALL SELECT 'max', max(value) FROM events""",
)
def describe(spark: SparkSession, d: str) -> DataFrame:
    """Without the quartiles, which describe() only approximates."""
    out = frames.described(_events(spark, d)[["value"]]).to_spark()
    return out.filter(~F.col("stat").isin("25%", "50%", "75%")).withColumn("value", F.round("value", 6))


@query("pd_04_groupby_sum_sorted", "SELECT event_type, round(sum(value), 2) AS value FROM events GROUP BY 1")
def groupby_sum_sorted(spark: SparkSession, d: str) -> DataFrame:
    return frames.sums_by(_events(spark, d), "event_type", "value").to_spark().withColumn("value", F.round("value", 2))


@query("pd_05_conversions", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def conversions(spark: SparkSession, d: str) -> DataFrame:
    """Spark to pandas-on-Spark and back; the handful of groups also goes through pandas."""
    counts = _events(spark, d).to_spark().groupBy("event_type").agg(agg.n_rows("n"))
    return spark.createDataFrame(counts.pandas_api().to_pandas())


CACHE_SQL = """SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 20 GROUP BY 1"""


@query("ctl_01_persist", CACHE_SQL)
def persist(spark: SparkSession, d: str) -> DataFrame:
    kept = ops.keep(table(spark, d, "events").filter("value > 20"))
    return kept.attach(kept.df.groupBy("event_type").agg(agg.n_rows("n"), F.round(F.sum("value"), 2).alias("total")))


@query("ctl_02_sql_cache", CACHE_SQL)
def sql_cache(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "events").createOrReplaceTempView("tidemark_cache_source")
    kept = ops.keep_table(spark, "tidemark_big", "SELECT * FROM tidemark_cache_source WHERE value > 20", lazy=True)
    return kept.attach(kept.df.groupBy("event_type").agg(agg.n_rows("n"), F.round(F.sum("value"), 2).alias("total")))


@query("ctl_03_explain", "SELECT true AS pushes_filter, true AS prunes_columns, count(*) AS rows FROM events WHERE value > 20")
def explain(spark: SparkSession, d: str) -> DataFrame:
    """The plan text of a filtered scan shows the pushed filter and the two columns read."""
    df = table(spark, d, "events").filter("value > 20").select("event_id", "value")
    text = ops.plan_text(df)
    pushed, pruned = "GreaterThan(value,20.0)" in text, "ReadSchema: struct<event_id:bigint,value:double>" in text
    return df.agg(F.lit(pushed).alias("pushes_filter"), F.lit(pruned).alias("prunes_columns"), F.count(F.lit(1)).alias("rows"))


@query("ctl_04_partition_hints", "SELECT o_orderkey FROM orders")
def partition_hints(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("tidemark_orders")
    return spark.sql("SELECT /*+ COALESCE(2) */ o_orderkey FROM (SELECT /*+ REPARTITION(6, o_custkey) */ * FROM tidemark_orders)")


@query("ctl_05_checkpoint", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def checkpoint(spark: SparkSession, d: str) -> DataFrame:
    shared_folder(spark)
    return table(spark, d, "orders").groupBy("o_custkey").agg(agg.n_rows("n")).checkpoint()
