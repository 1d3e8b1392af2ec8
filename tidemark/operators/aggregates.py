"""Group-by reports over trip-like tables.

All of them combine map-side, so a hot key reaches its reducer as one partial row per map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import banded, salt
from tidemark.operators.filters import labelled
from tidemark.operators.joins import join_group_stats
from tidemark.operators.order_stats import linear_quantiles

# Payment type codes.
PAYMENT_NAMES = {1: "Credit Card", 2: "Cash", 3: "No Charge", 4: "Dispute"}


def n_rows(name: str = "trip_count") -> Column:
    return F.count(F.lit(1)).alias(name)


def mean(column: str, digits: int = 4, name: str | None = None) -> Column:
    return F.round(F.avg(column), digits).alias(name or f"avg_{column}")


def steady_mean(column: str, name: str | None = None) -> Column:
    """The mean from a sum rounded to 4 decimals: the same double for any order of summation."""
    return (F.round(F.sum(column), 4) / F.count(column)).alias(name or f"avg_{column}")


def global_summary(trips: DataFrame) -> DataFrame:
    return trips.agg(
        n_rows(), mean("distance"), mean("fare"), mean("tip"), mean("total"),
        F.round(F.sum("total") / 1_000_000, 6).alias("revenue_m"),
    )


def column_profile(df: DataFrame, columns: Sequence[str], stored: bool = False) -> DataFrame:
    """count, mean, stddev, min, exact quartiles and max; one row per column. ``stored``: the frame is a scan, see ``values_at_ranks``."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")
    ).select("e.*")
    basics = long.groupBy("column").agg(
        F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev("v"), 4).alias("stddev"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    quartiles = linear_quantiles(long, ["column"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, stored).drop("_n")
    return basics.join(quartiles.select("column", *[F.round(q, 4).alias(q) for q in ("p25", "p50", "p75")]), "column")


def calendar_zone_rollup(trips: DataFrame) -> DataFrame:
    ts = F.col("pickup_ts")
    return trips.groupBy(
        F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"), "pu_zone"
    ).agg(
        n_rows(), F.round(F.sum("fare"), 2).alias("sum_fare"), steady_mean("fare"),
        F.max("fare").alias("max_fare"), F.min("fare").alias("min_fare"),
    )


def by_passengers(trips: DataFrame, low: int, high: int) -> DataFrame:
    return (
        trips.filter(F.col("passengers").between(low, high) & (F.col("total") > 0))
        .groupBy("passengers")
        .agg(n_rows(), mean("fare"), mean("distance"), F.round(F.sum("total"), 4).alias("revenue"))
        .orderBy("passengers")
    )


def monthly(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.month("pickup_ts").alias("month")).agg(
        n_rows(), F.round(F.sum("total") / 1_000_000, 6).alias("revenue_m"), mean("distance"), mean("fare"), mean("tip")
    )


def hourly_profile(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.hour("pickup_ts").alias("hour")).agg(n_rows(), mean("fare"), mean("distance"))


def weekday_profile(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.dayofweek("pickup_ts").alias("day_of_week")).agg(n_rows(), mean("total"), mean("tip"))


def payment_profile(trips: DataFrame) -> DataFrame:
    """The tip share is the ratio of the averages, not the average of ratios."""
    return (
        trips.groupBy("payment_type")
        .agg(
            n_rows(), F.round(F.sum("total") / 1_000_000, 6).alias("revenue_m"), mean("tip"),
            F.round(F.avg("tip") / F.avg("fare") * 100, 4).alias("tip_pct"),
        )
        .withColumn("payment_name", labelled(F.col("payment_type"), PAYMENT_NAMES, "Other"))
    )


def zone_summary(trips: DataFrame) -> DataFrame:
    return trips.groupBy("pu_zone").agg(
        n_rows(), F.sum("passengers").alias("total_passengers"), steady_mean("distance"), F.round(F.sum("fare"), 2).alias("total_fare")
    )


def distance_profile(trips: DataFrame) -> DataFrame:
    """Trips per distance band with their share of all trips."""
    bands = [(1, "< 1 mile"), (3, "1-3 miles"), (5, "3-5 miles"), (10, "5-10 miles"), (20, "10-20 miles")]
    banded_trips = trips.filter((F.col("distance") > 0) & (F.col("fare") > 0)).groupBy(
        banded(F.col("distance"), bands, "20+ miles").alias("distance_bucket")
    )
    totals = banded_trips.agg(n_rows(), mean("fare"), mean("tip"), F.min("distance").alias("min_distance"))
    share = F.round(F.col("trip_count") * 100.0 / F.sum("trip_count").over(Window.partitionBy()), 3)
    return totals.withColumn("pct", share).orderBy("min_distance")


def period_profile(trips: DataFrame) -> DataFrame:
    hour = F.hour("pickup_ts")
    period = (
        F.when(hour.between(6, 9), "1. morning rush")
        .when(hour.between(10, 15), "2. day")
        .when(hour.between(16, 19), "3. evening rush")
        .when(hour.between(20, 23), "4. evening")
        .otherwise("5. night")
    )
    return trips.filter(F.col("fare") > 0).groupBy(period.alias("time_period")).agg(
        n_rows(), mean("distance"), mean("fare"), mean("tip"), F.round(F.sum("total") / 1_000_000, 6).alias("revenue_m")
    )


def having(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], condition: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates).filter(condition)


def spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample standard deviation, min and max per group."""
    return df.groupBy(*keys).agg(
        n_rows("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("stddev"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def median(df: DataFrame, keys: Sequence[str], value: str, stored: bool = False) -> DataFrame:
    """Median and count per group. ``stored``: the frame is a scan, see ``values_at_ranks``."""
    picked = linear_quantiles(df, keys, value, {"median": 0.5}, stored)
    return picked.select(*keys, F.round("median", 4).alias("median"), F.col("_n").alias("n"))


def trimmed_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean per group after dropping values beyond 1.5 interquartile ranges (linear quartiles)."""
    quartiles = linear_quantiles(df, [key], value, {"q1": 0.25, "q3": 0.75}).drop("_n")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    kept = join_group_stats(df, quartiles, [key]).filter(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return kept.groupBy(key).agg((F.round(F.sum(value), 4) / F.count(value)).alias("trimmed_mean"), F.count(value).alias("kept"))


def uniqueness_gap(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows, distinct values and their gap. Spark de-duplicates per (key, value) before the key shuffle."""
    out = df.groupBy(*keys).agg(F.count(column).alias("n"), F.countDistinct(column).alias("n_distinct"))
    return out.withColumn("gap", F.col("n") - F.col("n_distinct"))


def distinct_both_ways(df: DataFrame, key: str, column: str, deviation: float) -> DataFrame:
    """``exact`` and ``near``, the distinct values per group counted and estimated with a relative deviation.

    Two aggregates: in one, Spark would group by (key, value) first and hold a sketch for every value. Sketches are one per group here.
    """
    exact = df.groupBy(key).agg(F.countDistinct(column).alias("exact"))
    near = df.groupBy(F.col(key).alias("_key")).agg(F.approx_count_distinct(column, deviation).alias("near"))
    return exact.join(near, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def salted_sum(df: DataFrame, key: str, value: str, row_key: Sequence[str], salts: int = 16) -> DataFrame:
    """Sum and count per key through partials per (key, salt); key and salt stay separate columns."""
    partial = df.groupBy(key, salt(salts, *row_key).alias("_salt")).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return partial.groupBy(key).agg(F.round(F.sum("_sum"), 2).alias("total"), F.sum("_n").alias("n"))


def two_level(df: DataFrame, category: str, sub_category: str, value: str) -> DataFrame:
    """Category totals from sub-category totals; only sums and counts may be nested like this."""
    inner = df.groupBy(category, sub_category).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return inner.groupBy(category).agg(
        F.round(F.sum("_sum"), 2).alias("total"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("sub_categories")
    )


def by_dict(df: DataFrame, aggregates: Mapping[str, str]) -> DataFrame:
    return df.agg(dict(aggregates))


def access_by_month(df: DataFrame, ts: str, user: str, item: str) -> DataFrame:
    return df.groupBy(F.date_trunc("month", ts).cast("timestamp_ntz").alias("month"), user).agg(
        n_rows("access_count"), F.countDistinct(item).alias("items_accessed")
    )
