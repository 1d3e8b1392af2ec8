"""The given tables, and the trip / usage / run tables Spark derives from them.

Every derived table has a SQL twin with the same columns, so that oracles can start from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item seen as a trip: times, zones, distance and amounts.

    The order carries a date only, so the time of day and the trip length are spread over the keys.
    """
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    secs = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 3607) % 86400).cast("int")
    ride = (300 + (F.col("l_partkey") * 37 + F.col("l_linenumber") * 101) % 1500).cast("int")
    tip = F.col("l_extendedprice") * F.col("l_discount")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"),
        F.timestamp_add("SECOND", secs, F.col("o_orderdate")).alias("pickup_ts"),
        F.timestamp_add("SECOND", secs + ride, F.col("o_orderdate")).alias("dropoff_ts"),
        (F.col("o_custkey") % 265 + 1).cast("int").alias("pu_zone"),
        (F.col("l_suppkey") % 265 + 1).cast("int").alias("do_zone"),
        F.col("l_linenumber").alias("passengers"),
        (F.col("l_quantity") / 2).alias("distance"),
        F.col("l_extendedprice").alias("fare"),
        tip.alias("tip"),
        (F.col("l_extendedprice") + tip).alias("total"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3).alias("payment_type"),
        F.when(F.col("l_tax") > 0.06, 1.75).otherwise(0.0).alias("airport_fee"),
    )


TRIP_ORDER = ["order_id", "line_no", "part_id", "supp_id", "fare"]

TRIPS_SQL = """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supp_id,
       o_orderdate + to_seconds((l_orderkey * 7919 + l_linenumber * 3607) % 86400) AS pickup_ts,
       o_orderdate + to_seconds((l_orderkey * 7919 + l_linenumber * 3607) % 86400
                                + 300 + (l_partkey * 37 + l_linenumber * 101) % 1500) AS dropoff_ts,
       (o_custkey % 265 + 1)::INT AS pu_zone, (l_suppkey % 265 + 1)::INT AS do_zone,
       l_linenumber AS passengers, l_quantity / 2 AS distance, l_extendedprice AS fare,
       l_extendedprice * l_discount AS tip, l_extendedprice + l_extendedprice * l_discount AS total,
       CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS payment_type,
       CASE WHEN l_tax > 0.06 THEN 1.75 ELSE 0.0::DOUBLE END AS airport_fee
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

WITH_TRIPS = f"WITH trips AS ({TRIPS_SQL})"
