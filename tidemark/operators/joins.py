"""Joins, including the ones for skewed and NULL keys.

Nothing is broadcast without a bound: either the row count is bounded by construction, or the
optimizer's size estimate is checked and a shuffle join (which AQE may still re-plan) is the other way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import salt
from tidemark.session import materialize

BROADCAST_LIMIT = 16 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``; reads statistics only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """A broadcast hint when the estimate is within ``limit``, else ``df`` as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def lookup_join(facts: DataFrame, lookup: DataFrame, on: str, how: str = "inner", limit: int = BROADCAST_LIMIT) -> DataFrame:
    return facts.join(broadcast_if_small(lookup, limit), on, how)


def join_group_stats(detail: DataFrame, stats: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Detail rows with the figures of their group (runs one job: the figures are written first).

    Planned in one go, both sides would be shuffled on the group before the figures prove small, which
    moves the whole detail onto a few hot keys. Written first, their size is known: small figures are
    broadcast and the detail stays where it is; otherwise it is a shuffle join with AQE skew handling.
    """
    return detail.join(broadcast_if_small(materialize(stats, "group-stats")), list(on), how)


def salted_join(facts: DataFrame, lookup: DataFrame, on: str, row_key: Sequence[str], salts: int = 8) -> DataFrame:
    """Inner join with the facts spread over ``salts`` and the lookup repeated once per salt.

    Always a shuffle join: the size estimate of the repeated lookup leaves the repeats out, so by it a lookup far too large would be broadcast.
    """
    spread = facts.withColumn("_salt", salt(salts, *row_key))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated.hint("merge"), [on, "_salt"]).drop("_salt")


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def hot_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys holding at least ``share`` of the rows; at most 1/share of them exist."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return key_counts(df.filter(F.col(key).isNotNull()), key).filter(F.col("n") >= total * share)


def hot_key_split_join(facts: DataFrame, lookup: DataFrame, on: str, share: float = 0.05) -> DataFrame:
    """Inner join in two branches: hot keys against the broadcast of their lookup rows, the rest by shuffle.

    The hot keys (at most 1/share) and their lookup rows are written first, so the facts are counted
    once and the size of what is broadcast is known; many lookup rows per hot key leave that branch to
    a shuffle join as well. Rows with a NULL key join nothing in either branch.
    """
    hot = F.broadcast(materialize(hot_keys(facts, on, share).select(on), "hot-keys"))
    hot_lookup = materialize(lookup.join(hot, on, "left_semi"), "hot-lookup")
    cold = facts.join(hot, on, "left_anti").join(lookup, on)
    return facts.join(broadcast_if_small(hot_lookup), on).unionByName(cold)


def left_join_spreading_nulls(facts: DataFrame, lookup: DataFrame, on: str, row_key: Sequence[str], fillers: int = 100) -> DataFrame:
    """Left join where NULL keys travel as one of ``fillers`` keys that match nothing.

    The filler is a second join column, so it cannot meet a real key.
    """
    filler = F.when(F.col(on).isNull(), salt(fillers, *row_key)).otherwise(-1)
    left = facts.withColumn("_filler", filler)
    right = lookup.withColumnRenamed(on, "_key").withColumn("_other", F.lit(-1))
    met = (F.col("_filler") == F.col("_other")) & F.col(on).eqNullSafe(F.col("_key"))
    return left.join(right, met, "left").drop("_key", "_filler", "_other")


def orphans(child: DataFrame, parent: DataFrame, condition: Column) -> DataFrame:
    return child.join(parent, condition, "left_anti")


def self_join_summary(df: DataFrame, key: str, ts: str) -> DataFrame:
    """What a self join on ``key`` with a time difference would return, per key, without its n*n rows:
    the number of pairs and the smallest and largest difference in seconds. NULL keys meet nothing."""
    seconds = F.unix_timestamp(ts)
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(seconds).alias("_lo"), F.max(seconds).alias("_hi"))
        .select(
            key, (F.col("_n") * F.col("_n")).alias("pairs"), (F.col("_lo") - F.col("_hi")).alias("min_diff_sec"),
            (F.col("_hi") - F.col("_lo")).alias("max_diff_sec"),
        )
    )


def within_time(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """Pairs with equal key and timestamps at most ``seconds`` apart.

    Both sides meet in time buckets as wide as the range (the right side in its own bucket and the two
    beside it), so a hot key is spread over its buckets instead of one range scan per key.
    """
    def bucket(ts: str) -> Column:
        return F.floor(F.unix_timestamp(ts) / seconds)

    near = F.explode(F.sequence(bucket(right_ts) - 1, bucket(right_ts) + 1))
    pairs = left.withColumn("_bucket", bucket(left_ts)).join(right.withColumn("_bucket", near), [key, "_bucket"])
    reach = F.expr(f"INTERVAL {seconds} SECONDS")
    return pairs.filter(
        (F.col(right_ts) >= F.col(left_ts) - reach) & (F.col(right_ts) <= F.col(left_ts) + reach)
    ).drop("_bucket")
