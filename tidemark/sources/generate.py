"""Generated rows: id ranges with value modes, and synthetic trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def id_range(spark: SparkSession, n: int, partitions: int = 8, mode: str = "range") -> DataFrame:
    return with_mode(spark.range(0, n, 1, partitions), mode)


def with_mode(ids: DataFrame, mode: str) -> DataFrame:
    """*range*: ids only; *skew*: ten keys; *nulls*: every hundredth value is NULL."""
    if mode == "range":
        return ids
    if mode == "skew":
        return ids.withColumn("skew_key", F.col("id") % 10)
    if mode == "nulls":
        return ids.withColumn("value", F.when(F.col("id") % 100 != 0, F.col("id")))
    raise ValueError(f"unknown mode {mode!r}")


def _weighted(seed: int, steps: Sequence[tuple[float, object]], rest: object) -> Column:
    """Chained draws: each branch draws anew, so the weights are conditional."""
    out = F.when(F.rand(seed) < steps[0][0], steps[0][1])
    for i, (p, value) in enumerate(steps[1:], 1):
        out = out.when(F.rand(seed + i) < p, value)
    return out.otherwise(rest)


def synthetic_trips(spark: SparkSession, n: int, month_start: str, seed: int = 42, partitions: int = 8) -> DataFrame:
    """Trips of one month: fares from distance, surcharges by hour, 5-30 minute rides."""
    first = F.lit(month_start).cast("timestamp")
    seconds = F.unix_timestamp(F.add_months(first, 1).cast("timestamp")) - F.unix_timestamp(first) - 1
    draw = lambda k: F.rand(seed + 100 * k)
    base = spark.range(0, n, 1, partitions).select(
        F.timestamp_seconds(F.unix_timestamp(first) + F.floor(draw(1) * seconds)).alias("pickup_ts"),
        (F.floor(draw(2) * 1500) + 300).alias("_ride"),
        _weighted(seed + 300, [(0.6, 1), (0.8, 2), (0.9, 3), (0.95, 4), (0.98, 5)], 6).alias("passengers"),
        (draw(4) * 19.5 + 0.5).alias("distance"),
        (F.floor(draw(5) * 263) + 1).cast("int").alias("pu_zone"),
        (F.floor(draw(6) * 263) + 1).cast("int").alias("do_zone"),
        _weighted(seed + 700, [(0.5, 1)], 2).alias("vendor"),
        _weighted(seed + 800, [(0.9, 1), (0.95, 2)], 4).alias("rate_code"),
        _weighted(seed + 900, [(0.1, "Y")], "N").alias("stored"),
        draw(10).alias("_fare_noise"), draw(11).alias("_tip_share"),
        _weighted(seed + 1200, [(0.6, 1), (0.95, 2)], 3).alias("payment_type"),
        F.when(draw(13) < 0.2, draw(14) * 10).otherwise(0.0).alias("tolls"),
        F.when(draw(15) < 0.3, 2.75).otherwise(0.0).alias("congestion"),
    )
    hour = F.hour("pickup_ts")
    fare = (F.col("distance") * 2.5 + 3.0) * (1.0 + (F.col("_fare_noise") - 0.5) * 0.2)
    priced = base.withColumns(
        {
            "dropoff_ts": F.timestamp_seconds(F.unix_timestamp("pickup_ts") + F.col("_ride")), "fare": fare,
            "extra": F.when(hour >= 16, 1.0).when(hour < 6, 0.5).otherwise(0.0),
            "mta_tax": F.lit(0.5), "improvement": F.lit(0.3),
        }
    ).withColumn("tip", F.col("fare") * F.col("_tip_share") * 0.3)
    total = sum((F.col(c) for c in ("tip", "extra", "mta_tax", "tolls", "improvement", "congestion")), F.col("fare"))
    return priced.withColumn("total", total).drop("_ride", "_fare_noise", "_tip_share")
