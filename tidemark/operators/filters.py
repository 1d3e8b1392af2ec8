"""Filters, derived columns, de-duplication and sampling over trip-like tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_trips(trips: DataFrame, start: str, end: str, max_distance: float | None = None) -> DataFrame:
    """Positive distance, fare and total, picked up in [start, end); optionally below a distance cap."""
    keep = (
        (F.col("distance") > 0)
        & (F.col("fare") > 0)
        & (F.col("total") > 0)
        & (F.col("pickup_ts") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("pickup_ts") < F.lit(end).cast("timestamp_ntz"))
    )
    if max_distance is not None:
        keep = keep & (F.col("distance") < max_distance)
    return trips.filter(keep)


def between_days(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """``ts BETWEEN first AND last`` on day literals: the range ends at midnight of the last day."""
    return df.filter(F.col(ts).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))


def last_days(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of the ``days`` days up to and including the as-of day."""
    day = F.lit(as_of).cast("timestamp_ntz")
    return df.filter((F.col(ts) >= day - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) < day + F.expr("INTERVAL 1 DAY")))


def labelled(code: Column, labels: Mapping[object, str], rest: str) -> Column:
    """Code -> label for a fixed handful of codes."""
    out = None
    for value, name in labels.items():
        out = F.when(code == value, name) if out is None else out.when(code == value, name)
    return out.otherwise(rest)


def in_dollars(amount: Column, currency: Column) -> Column:
    """USD at 1, EUR at 1.1 and anything else at 0.9."""
    return F.when(currency == "USD", amount).when(currency == "EUR", amount * 1.1).otherwise(amount * 0.9)


def fill_and_drop(df: DataFrame, fills: Mapping[str, object], required: Sequence[str]) -> DataFrame:
    """Fill NULLs per column, then drop rows where a required column is NULL."""
    return df.na.fill(dict(fills)).na.drop(subset=list(required))


def fill_by_type(df: DataFrame, number: float = 0, text: str = "unknown") -> DataFrame:
    return df.fillna(number).fillna(text)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first along ``order``, which must order rows totally.

    Spark keeps only the best row per key before the shuffle (a window group limit), so a hot key
    sends one row per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def key_percentile(*key: str) -> Column:
    """A number from 0 to 99 that depends on the key only; the MD5 makes it the same in any engine."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("int") % 100


def hash_sample(df: DataFrame, percent: int, *key: str) -> DataFrame:
    """A repeatable sample by key: the same rows whatever the partitioning."""
    return df.filter(key_percentile(*key) < percent)


def hash_split(df: DataFrame, train_percent: int, *key: str) -> DataFrame:
    """Adds ``part`` = train or test, by key."""
    return df.withColumn("part", F.when(key_percentile(*key) < train_percent, "train").otherwise("test"))
