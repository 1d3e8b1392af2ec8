"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import aggregates as ops
from tidemark.plans.inputs import WITH_TRIPS, table, trips
from tidemark.plans.registry import query
from tidemark.plans.rows import BOROUGH_SQL


@query(
    "agg_01_global_summary",
    f"""{WITH_TRIPS} SELECT count(*) AS trip_count, round(avg(distance), 4) AS avg_distance,
        round(avg(fare), 4) AS avg_fare, round(avg(tip), 4) AS avg_tip, round(avg(total), 4) AS avg_total,
        round(sum(total) / 1000000, 6) AS revenue_m FROM trips""",
)
def global_summary(spark: SparkSession, d: str) -> DataFrame:
    return ops.global_summary(trips(spark, d))


@query(
    "agg_02_column_profile",
    """SELECT "column", count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS stddev, min(v) AS min,
              max(v) AS max, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50,
              round(quantile_cont(v, 0.75), 4) AS p75
       FROM (SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem
             UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
             UNION ALL SELECT 'l_discount', l_discount FROM lineitem) GROUP BY 1""",
)
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return ops.column_profile(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], stored=True)


@query(
    "agg_03_calendar_zone",
    f"""{WITH_TRIPS} SELECT year(pickup_ts) AS year, month(pickup_ts) AS month, dayofmonth(pickup_ts) AS day,
        hour(pickup_ts) AS hour, pu_zone, count(*) AS trip_count, round(sum(fare), 2) AS sum_fare,
        round(sum(fare), 4) / count(fare) AS avg_fare, max(fare) AS max_fare, min(fare) AS min_fare
        FROM trips GROUP BY 1, 2, 3, 4, 5""",
)
def calendar_zone(spark: SparkSession, d: str) -> DataFrame:
    return ops.calendar_zone_rollup(trips(spark, d))


@query(
    "agg_04_by_passengers",
    f"""{WITH_TRIPS} SELECT passengers, count(*) AS trip_count, round(avg(fare), 4) AS avg_fare,
        round(avg(distance), 4) AS avg_distance, round(sum(total), 4) AS revenue
        FROM trips WHERE passengers BETWEEN 1 AND 6 AND total > 0 GROUP BY 1 ORDER BY 1""",
)
def by_passengers(spark: SparkSession, d: str) -> DataFrame:
    return ops.by_passengers(trips(spark, d), 1, 6)


@query(
    "agg_05_monthly",
    f"""{WITH_TRIPS} SELECT month(pickup_ts) AS month, count(*) AS trip_count,
        round(sum(total) / 1000000, 6) AS revenue_m, round(avg(distance), 4) AS avg_distance,
        round(avg(fare), 4) AS avg_fare, round(avg(tip), 4) AS avg_tip FROM trips GROUP BY 1""",
)
def monthly(spark: SparkSession, d: str) -> DataFrame:
    return ops.monthly(trips(spark, d))


@query(
    "agg_06_hourly",
    f"""{WITH_TRIPS} SELECT hour(pickup_ts) AS hour, count(*) AS trip_count, round(avg(fare), 4) AS avg_fare,
        round(avg(distance), 4) AS avg_distance FROM trips GROUP BY 1""",
)
def hourly(spark: SparkSession, d: str) -> DataFrame:
    return ops.hourly_profile(trips(spark, d))


@query(
    "agg_07_weekday",
    f"""{WITH_TRIPS} SELECT dayofweek(pickup_ts) + 1 AS day_of_week, count(*) AS trip_count,
        round(avg(total), 4) AS avg_total, round(avg(tip), 4) AS avg_tip FROM trips GROUP BY 1""",
)
def weekday(spark: SparkSession, d: str) -> DataFrame:
    return ops.weekday_profile(trips(spark, d))


@query(
    "agg_08_payment",
    f"""{WITH_TRIPS} SELECT payment_type, count(*) AS trip_count, round(sum(total) / 1000000, 6) AS revenue_m,
        round(avg(tip), 4) AS avg_tip, round(avg(tip) / avg(fare) * 100, 4) AS tip_pct,
        CASE payment_type WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'Cash' WHEN 3 THEN 'No Charge'
             WHEN 4 THEN 'Dispute' ELSE 'Other' END AS payment_name FROM trips GROUP BY 1""",
)
def payment(spark: SparkSession, d: str) -> DataFrame:
    return ops.payment_profile(trips(spark, d))


@query(
    "agg_09_zone_summary",
    f"""{WITH_TRIPS} SELECT pu_zone, count(*) AS trip_count, sum(passengers)::BIGINT AS total_passengers,
        round(sum(distance), 4) / count(distance) AS avg_distance, round(sum(fare), 2) AS total_fare FROM trips GROUP BY 1""",
)
def zone_summary(spark: SparkSession, d: str) -> DataFrame:
    return ops.zone_summary(trips(spark, d))


@query(
    "agg_10_having",
    """SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 4) / count(l_extendedprice) AS avg_price FROM lineitem
       GROUP BY 1 HAVING count(*) > 10 AND avg(l_extendedprice) > 38000""",
)
def having(spark: SparkSession, d: str) -> DataFrame:
    found = ops.having(
        table(spark, d, "lineitem"), ["l_suppkey"],
        [F.count(F.lit(1)).alias("n"), ops.steady_mean("l_extendedprice", "avg_price")],
        (F.col("n") > 10) & (F.col("avg_price") > 38000),
    )
    return found


@query(
    "agg_11_stddev",
    """SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean,
              round(stddev_samp(l_extendedprice), 4) AS stddev, min(l_extendedprice) AS min,
              max(l_extendedprice) AS max FROM lineitem GROUP BY 1""",
)
def stddev(spark: SparkSession, d: str) -> DataFrame:
    return ops.spread(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query(
    "agg_12_median",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, count(l_extendedprice) AS n
       FROM lineitem GROUP BY 1""",
)
def median(spark: SparkSession, d: str) -> DataFrame:
    return ops.median(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", stored=True)


@query(
    "agg_13_count_distinct",
    """SELECT l_returnflag, count(l_partkey) AS n, count(DISTINCT l_partkey) AS n_distinct,
              count(l_partkey) - count(DISTINCT l_partkey) AS gap FROM lineitem GROUP BY 1""",
)
def count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return ops.uniqueness_gap(table(spark, d, "lineitem"), ["l_returnflag"], "l_partkey")


@query("agg_14_approx_distinct")
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query("agg_14_approx_error", "SELECT event_type, count(DISTINCT user_id) AS users, true AS within_5_percent FROM events GROUP BY 1")
def approx_error(spark: SparkSession, d: str) -> DataFrame:
    """The approximate count (relative deviation 1%) next to the exact one."""
    both = ops.distinct_both_ways(table(spark, d, "events"), "event_type", "user_id", 0.01).withColumnRenamed("exact", "users")
    return both.select("event_type", "users", (F.abs(F.col("near") - F.col("users")) <= 0.05 * F.col("users")).alias("within_5_percent"))


@query(
    "agg_15_day_zone_borough",
    f"""{WITH_TRIPS} SELECT pickup_ts::DATE AS pickup_date, pu_zone, {BOROUGH_SQL} AS borough,
        round(sum(total), 4) AS daily_revenue, count(*) AS daily_trips, round(sum(distance), 4) / count(distance) AS avg_distance,
        round(avg((epoch(dropoff_ts) - epoch(pickup_ts)) / 60), 6) AS avg_duration
        FROM trips GROUP BY 1, 2, 3""",
)
def day_zone_borough(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.features import daily_zone

    out = daily_zone(trips(spark, d))
    return out.select(
        "pickup_date", "pu_zone", "borough", F.round("daily_revenue", 4).alias("daily_revenue"), "daily_trips",
        "avg_distance", F.round("avg_duration", 6).alias("avg_duration"),
    )


@query(
    "agg_16_day_borough_model_table",
    f"""{WITH_TRIPS} SELECT pickup_ts::DATE AS pickup_date, {BOROUGH_SQL} AS borough, count(*) AS trip_count,
        round(sum(total), 4) AS revenue, round(sum(distance), 4) / count(distance) AS avg_distance,
        sum(CASE WHEN hour(pickup_ts) BETWEEN 7 AND 9 OR hour(pickup_ts) BETWEEN 17 AND 19 THEN 1 ELSE 0 END)::BIGINT
            AS rush_trips,
        sum(CASE WHEN pu_zone IN (1, 132, 138) THEN 1 ELSE 0 END)::BIGINT AS airport_trips,
        max(CASE WHEN dayofweek(pickup_ts) IN (0, 6) THEN 1 ELSE 0 END) AS is_weekend
        FROM trips GROUP BY 1, 2""",
)
def day_borough(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.features import daily_borough

    out = daily_borough(trips(spark, d))
    return out.withColumns({"revenue": F.round("revenue", 4), "avg_distance": F.col("avg_distance")})


@query(
    "agg_17_daily_overview",
    f"""{WITH_TRIPS} SELECT pickup_ts::DATE AS pickup_date, count(*) AS trip_count, round(sum(total), 4) AS revenue,
        round(sum(fare), 4) / count(fare) AS avg_fare, round(sum(distance), 4) / count(distance) AS avg_distance FROM trips GROUP BY 1""",
)
def daily_overview(spark: SparkSession, d: str) -> DataFrame:
    return trips(spark, d).groupBy(F.to_date("pickup_ts").alias("pickup_date")).agg(
        ops.n_rows(), F.round(F.sum("total"), 4).alias("revenue"), ops.steady_mean("fare"), ops.steady_mean("distance")
    )


@query("agg_18_dict_aggregation", "SELECT sum(o_orderkey)::BIGINT AS id_sum, max(o_totalprice) AS max_price FROM orders")
def dict_aggregation(spark: SparkSession, d: str) -> DataFrame:
    out = ops.by_dict(table(spark, d, "orders"), {"o_orderkey": "sum", "o_totalprice": "max"})
    return out.select(F.col("sum(o_orderkey)").alias("id_sum"), F.col("max(o_totalprice)").alias("max_price"))


@query(
    "agg_19_checked_id_sum",
    """SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS id_sum,
              sum(o_orderkey) = count(*) * (count(*) - 1) // 2 AS matches_formula FROM orders""",
)
def checked_id_sum(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("id_sum"))
    return out.withColumn("matches_formula", F.col("id_sum") == F.expr("n * (n - 1) div 2"))


@query(
    "agg_20_category_revenue",
    """SELECT p_brand, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_quantity), 4) / count(l_quantity) AS avg_quantity
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def category_revenue(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("p_brand").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("revenue"), ops.steady_mean("l_quantity", "avg_quantity")
    )


@query(
    "agg_21_per_product",
    """SELECT l_partkey, count(*) AS n, round(sum(l_extendedprice), 4) / count(l_extendedprice) AS avg_price,
              round(sum(l_extendedprice * l_quantity), 2) AS revenue FROM lineitem GROUP BY 1
       ORDER BY revenue DESC, l_partkey""",
)
def per_product(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem").groupBy("l_partkey")
        .agg(ops.n_rows("n"), ops.steady_mean("l_extendedprice", "avg_price"),
             F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), 2).alias("revenue"))
        .orderBy(F.desc("revenue"), "l_partkey")
    )


@query(
    "agg_22_access_by_month",
    """SELECT date_trunc('month', ts)::TIMESTAMP AS month, user_id, count(*) AS access_count,
              count(DISTINCT event_type) AS items_accessed FROM events GROUP BY 1, 2""",
)
def access_by_month(spark: SparkSession, d: str) -> DataFrame:
    return ops.access_by_month(table(spark, d, "events"), "ts", "user_id", "event_type")


@query(
    "agg_23_salted_sum",
    "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem GROUP BY 1",
)
def salted_sum(spark: SparkSession, d: str) -> DataFrame:
    return ops.salted_sum(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query("agg_24_id_modulo_groups", "SELECT o_orderkey % 100 AS bucket, count(*) AS n FROM orders GROUP BY 1")
def id_modulo_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy((F.col("o_orderkey") % 100).alias("bucket")).agg(ops.n_rows("n"))


@query(
    "agg_25_two_level",
    """SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, count(*) AS n,
              count(DISTINCT l_suppkey) AS sub_categories FROM lineitem GROUP BY 1""",
)
def two_level(spark: SparkSession, d: str) -> DataFrame:
    return ops.two_level(table(spark, d, "lineitem"), "l_returnflag", "l_suppkey", "l_extendedprice")
