"""Transforms that run alike on a static frame (the batch twin) and on a stream.

Event frames have event_id, user_id, event_type, value and ts as TIMESTAMP: a watermark cannot stand on
TIMESTAMP_NTZ, so ``with_event_time`` casts first (the session zone is UTC).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def flat_window(df: DataFrame) -> DataFrame:
    """The window struct as two columns without a zone."""
    bounds = [F.col(f"window.{e}").cast("timestamp_ntz").alias(f"window_{e}") for e in ("start", "end")]
    return df.select(*bounds, *[c for c in df.columns if c != "window"])


def tumbling_counts(events: DataFrame, distinct_users: Column | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and distinct users per type and 5 minutes. Streams allow approximate distinct counts only;
    the batch twin passes the exact one."""
    users = F.approx_count_distinct("user_id") if distinct_users is None else distinct_users
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes"), "event_type")
    return flat_window(grouped.agg(F.count(F.lit(1)).alias("n"), users.alias("users")))


def sliding_means(events: DataFrame, late: str = "5 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute", "30 seconds"), "event_type")
    return flat_window(grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value")))


def offset_counts(events: DataFrame, offset: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Five-minute windows starting ``offset`` past each five minutes; the offset must be below the slide."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes", "5 minutes", offset), "event_type")
    return flat_window(grouped.agg(F.count(F.lit(1)).alias("n")))


def hourly_totals(events: DataFrame, late: str = "2 hours") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return flat_window(grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")))


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Session windows per user. Streams support them in append mode only.

    For a batch over skewed users, ``operators.piecewise.stitched_sessions`` cuts users by day.
    """
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id")
    return flat_window(grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")))


def user_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("top"))


def joined_within(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, how: str = "inner", reach: str = "5 minutes", late: str = "10 minutes"
) -> DataFrame:
    """Equal keys and timestamps within ``reach``, both sides watermarked. The range also bounds the
    state, without which an outer join of streams is refused."""
    near = (
        (F.col(f"l.{key}") == F.col(f"r.{key}"))
        & (F.col(right_ts) >= F.col(left_ts) - F.expr(f"INTERVAL {reach}"))
        & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {reach}"))
    )
    joined = left.withWatermark(left_ts, late).alias("l").join(right.withWatermark(right_ts, late).alias("r"), near, how)
    return joined.drop(F.col(f"r.{key}"))


def as_messages(df: DataFrame, key: str) -> DataFrame:
    """Rows as key and JSON value."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def without_repeats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row per event id; repeats arriving within the watermark are dropped."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
