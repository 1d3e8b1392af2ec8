"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import aggregates as agg
from tidemark.operators import joins as ops
from tidemark.operators.features import daily_zone
from tidemark.plans.inputs import TRIP_ORDER, WITH_TRIPS, table, trips
from tidemark.plans.registry import query
from tidemark.plans.rows import BOROUGH_SQL, KEYS

BRAND_SQL = """SELECT p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue
               FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("partkey"), "l_orderkey", "l_linenumber", "l_extendedprice"
    )


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), "p_brand")


def _by_brand(joined: DataFrame) -> DataFrame:
    return joined.groupBy("p_brand").agg(agg.n_rows("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("jn_01_fact_dimension", BRAND_SQL)
def fact_dimension(spark: SparkSession, d: str) -> DataFrame:
    return _by_brand(_lines(spark, d).join(_parts(spark, d), "partkey"))


@query(
    "jn_02_self_join_summary",
    f"""{WITH_TRIPS}, t AS (SELECT pu_zone, epoch(pickup_ts)::BIGINT AS s FROM trips)
    SELECT a.pu_zone, count(*) AS pairs, min(a.s - b.s) AS min_diff_sec, max(a.s - b.s) AS max_diff_sec
    FROM t a JOIN t b ON a.pu_zone = b.pu_zone GROUP BY 1""",
)
def self_join_summary(spark: SparkSession, d: str) -> DataFrame:
    return ops.self_join_summary(trips(spark, d), "pu_zone", "pickup_ts")


@query(
    "jn_03_aggregate_joined_back",
    f"""{WITH_TRIPS}, g AS (SELECT *, pickup_ts::DATE AS day, {BOROUGH_SQL} AS borough FROM trips),
    s AS (SELECT day, pu_zone, borough, count(*) AS daily_trips, round(sum(total), 4) AS daily_revenue
          FROM g GROUP BY 1, 2, 3)
    SELECT {KEYS}, daily_trips, daily_revenue FROM g LEFT JOIN s USING (day, pu_zone, borough)""",
)
def aggregate_joined_back(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.features import geospatial, temporal

    detail = geospatial(temporal(trips(spark, d))).select(*TRIP_ORDER, "pickup_date", "pu_zone", "borough")
    daily = daily_zone(trips(spark, d)).select(
        "pickup_date", "pu_zone", "borough", "daily_trips", F.round("daily_revenue", 4).alias("daily_revenue")
    )
    joined = detail.join(daily, ["pickup_date", "pu_zone", "borough"], "left")
    return joined.select(*TRIP_ORDER, "daily_trips", "daily_revenue")


@query(
    "jn_04_feature_chain",
    """SELECT c_custkey, orders, spend, events, errors FROM customer
       LEFT JOIN (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1)
         ON c_custkey = o_custkey
       LEFT JOIN (SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors
                  FROM events GROUP BY 1) ON c_custkey = user_id""",
)
def feature_chain(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").select("c_custkey")
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        agg.n_rows("orders"), F.round(F.sum("o_totalprice"), 2).alias("spend")
    )
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        agg.n_rows("events"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
    return customer.join(orders, "c_custkey", "left").join(events, "c_custkey", "left")


@query(
    "jn_05_two_aggregates",
    f"""{WITH_TRIPS} SELECT a.passengers, total_fare, avg_distance
    FROM (SELECT passengers, round(sum(fare), 2) AS total_fare FROM trips GROUP BY 1) a
    JOIN (SELECT passengers, round(sum(distance), 4) / count(distance) AS avg_distance FROM trips GROUP BY 1) b
      ON a.passengers = b.passengers WHERE total_fare > 1000""",
)
def two_aggregates(spark: SparkSession, d: str) -> DataFrame:
    rides = trips(spark, d)
    fares = rides.groupBy("passengers").agg(F.round(F.sum("fare"), 2).alias("total_fare"))
    distances = rides.groupBy("passengers").agg(agg.steady_mean("distance"))
    return fares.join(distances, "passengers").filter(F.col("total_fare") > 1000)


@query(
    "jn_06_pickup_dropoff_zones",
    f"""{WITH_TRIPS} SELECT zone, pickup_count, avg_distance, dropoff_count, dropoff_avg_distance
    FROM (SELECT pu_zone AS zone, count(*) AS pickup_count, round(sum(distance), 4) / count(distance) AS avg_distance
          FROM trips WHERE total > 0 GROUP BY 1)
    JOIN (SELECT do_zone AS zone, count(*) AS dropoff_count,
                 round(sum(distance), 4) / count(distance) AS dropoff_avg_distance
          FROM trips WHERE total > 0 GROUP BY 1) USING (zone)
    WHERE pickup_count > 100 AND dropoff_count > 100 ORDER BY pickup_count DESC, zone LIMIT 100""",
)
def pickup_dropoff_zones(spark: SparkSession, d: str) -> DataFrame:
    rides = trips(spark, d).filter(F.col("total") > 0)
    up = rides.groupBy(F.col("pu_zone").alias("zone")).agg(agg.n_rows("pickup_count"), agg.steady_mean("distance"))
    down = rides.groupBy(F.col("do_zone").alias("zone")).agg(
        agg.n_rows("dropoff_count"), agg.steady_mean("distance", "dropoff_avg_distance")
    )
    busy = up.filter("pickup_count > 100").join(down.filter("dropoff_count > 100"), "zone")
    return busy.orderBy(F.desc("pickup_count"), "zone").limit(100)


@query(
    "jn_07_limited_keys",
    f"""{WITH_TRIPS} SELECT t.passengers, count(*) AS trip_count FROM trips t
    JOIN (SELECT passengers FROM trips GROUP BY 1 ORDER BY 1 LIMIT 5) k ON t.passengers = k.passengers GROUP BY 1""",
)
def limited_keys(spark: SparkSession, d: str) -> DataFrame:
    rides = trips(spark, d)
    keys = rides.select("passengers").distinct().orderBy("passengers").limit(5)
    return rides.join(keys, "passengers").groupBy("passengers").agg(agg.n_rows())


@query("jn_08_broadcast_checked", BRAND_SQL)
def broadcast_checked(spark: SparkSession, d: str) -> DataFrame:
    return _by_brand(ops.lookup_join(_lines(spark, d), _parts(spark, d), "partkey"))


@query("jn_09_shuffle_hash", BRAND_SQL)
def shuffle_hash(spark: SparkSession, d: str) -> DataFrame:
    return _by_brand(_lines(spark, d).join(_parts(spark, d).hint("shuffle_hash"), "partkey"))


@query("jn_10_sort_merge", BRAND_SQL)
def sort_merge(spark: SparkSession, d: str) -> DataFrame:
    return _by_brand(_lines(spark, d).join(_parts(spark, d).hint("merge"), "partkey"))


@query("jn_11_salted", BRAND_SQL)
def salted(spark: SparkSession, d: str) -> DataFrame:
    return _by_brand(ops.salted_join(_lines(spark, d), _parts(spark, d), "partkey", ["l_orderkey", "l_linenumber"]))


@query("jn_12_skew_by_aqe", BRAND_SQL)
def skew_by_aqe(spark: SparkSession, d: str) -> DataFrame:
    """The SKEW hint does nothing in Apache Spark; the adaptive skew join, on by default, does its work."""
    return _by_brand(_lines(spark, d).hint("skew", "partkey").join(_parts(spark, d), "partkey"))


@query(
    "jn_13_orphans",
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)",
)
def orphans(spark: SparkSession, d: str) -> DataFrame:
    customer, events = table(spark, d, "customer"), table(spark, d, "events")
    return ops.orphans(customer.select("c_custkey", "c_name"), events, F.col("user_id") == F.col("c_custkey"))


@query(
    "jn_14_semi",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""",
)
def semi(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    orders = table(spark, d, "orders")
    return orders.join(returned, orders.o_orderkey == returned.l_orderkey, "left_semi").select("o_orderkey", "o_totalprice")


@query(
    "jn_15_left_to_dimensions",
    """SELECT o_orderkey, c_name, c_mktsegment, n_name FROM orders
       LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def left_to_dimensions(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return (
        orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select("o_orderkey", "c_name", "c_mktsegment", "n_name")
    )


@query(
    "jn_17_within_five_minutes",
    """SELECT a.event_id AS click_id, b.event_id AS purchase_id, a.user_id FROM events a JOIN events b
       ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 5 MINUTE AND a.ts + INTERVAL 5 MINUTE
       WHERE a.event_type = 'click' AND b.event_type = 'purchase'""",
)
def within_five_minutes(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    buys = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    pairs = ops.within_time(clicks, buys, "user_id", "click_ts", "purchase_ts", 300)
    return pairs.select("click_id", "purchase_id", "user_id")


@query("jn_18_id_join_count", "SELECT count(*) AS n FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey")
def id_join_count(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").select("o_orderkey")
    return ids.join(ids.withColumnRenamed("o_orderkey", "other"), F.col("o_orderkey") == F.col("other")).agg(agg.n_rows("n"))


NULL_KEY_SQL = "SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS suppkey FROM lineitem"


def _null_keyed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("suppkey"),
        "l_orderkey", "l_linenumber", "l_extendedprice",
    )


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("suppkey"), "s_name")


@query(
    "jn_19_spread_null_keys",
    f"""SELECT suppkey, s_name, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue
        FROM ({NULL_KEY_SQL}) LEFT JOIN supplier ON suppkey = s_suppkey GROUP BY 1, 2""",
)
def spread_null_keys(spark: SparkSession, d: str) -> DataFrame:
    joined = ops.left_join_spreading_nulls(_null_keyed(spark, d), _suppliers(spark, d), "suppkey", ["l_orderkey", "l_linenumber"])
    return joined.groupBy("suppkey", "s_name").agg(agg.n_rows("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query(
    "jn_19_drop_null_keys",
    f"""SELECT s_name, count(*) AS n FROM ({NULL_KEY_SQL}) JOIN supplier ON suppkey = s_suppkey
        WHERE suppkey IS NOT NULL GROUP BY 1""",
)
def drop_null_keys(spark: SparkSession, d: str) -> DataFrame:
    keyed = _null_keyed(spark, d).filter(F.col("suppkey").isNotNull())
    return keyed.join(_suppliers(spark, d), "suppkey").groupBy("s_name").agg(agg.n_rows("n"))


@query("jn_20_hot_key_split", BRAND_SQL)
def hot_key_split(spark: SparkSession, d: str) -> DataFrame:
    return _by_brand(ops.hot_key_split_join(_lines(spark, d), _parts(spark, d), "partkey", share=0.0006))
