"""Exact order statistics per group without holding a group in one task.

``percentile`` keeps a value->count map of a whole group in one buffer; that is fine for small groups
and fails for a key holding a third of a large table. Here values are counted per (group, value) with
map-side combine and dealt in ranges of (group's hash, value), so that a large group lies in many pieces in order.
A group within one piece is ordered as it is. Groups cut by a border, fewer than pieces, are ordered by piece, and
totals of their pieces carry the ranks on; so millions of small groups need no totals and no join. Values keep their type: NaN and infinities have their place in Spark's order, and
whole numbers and decimals are not rounded. Columns read from storage are first narrowed to the cells of a logarithmic
histogram that hold a wanted rank, so that only those values pass a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.operators.joins import broadcast_if_small
from tidemark.session import materialize

Rank = Callable[[Column], Column]


#: Steps of a value's natural logarithm in one unit: a cell is 0.2 % of a value wide.
STEPS = 512


def _cell(value: Column) -> Column:
    """The cell of a number. Larger numbers never have smaller cells; infinities and NaN lie at the ends."""
    v = value.cast("double")
    step, end = F.floor(F.log1p(F.abs(v)) * STEPS), 1 << 40
    return F.when(F.isnan(v), end + 1).when(F.abs(v) == float("inf"), F.signum(v).cast("long") * end).otherwise(F.when(v < 0, -1 - step).otherwise(step))


def _wanted(ranks: Mapping[str, Rank]) -> Column:
    """The ranks from ``_below`` on among ``_in`` values, of the ``_n`` values of a group."""
    picks = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("rank")) for name, rank in ranks.items()])
    return F.filter(picks, lambda p: (p["rank"] >= F.col("_below")) & (p["rank"] < F.col("_below") + F.col("_in")))


def values_at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Rank], stored: bool = False) -> DataFrame:
    """One row per group: ``_n`` non-null values and, per name, the value at the 0-based rank f(n).

    The counted values, the groups cut between pieces and the totals of those are written to the shared folder (three jobs): the
    input is read once. Cut groups are fewer than pieces; totals are broadcast only when their written size is small.

    ``stored`` says that every evaluation of ``df`` gives the same values, as a scan does (sums of doubles after a shuffle may not).
    Then a number is narrowed first: a scan counts cells per group, and a second one keeps the cells with a wanted rank
    (one more small table is written). Cells that hold much, as equal values do, go the same way as whole groups.
    """
    group = list(keys) or ["_all"]
    data = (df if keys else df.withColumn("_all", F.lit(0))).filter(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"))
    by = group
    if stored and isinstance(df.schema[value].dataType, NumericType):
        by = [*group, "_cell"]
        data = data.withColumn("_cell", _cell(F.col("_v")))
        whole = Window.partitionBy(*group)
        cells = data.groupBy(*by).agg(F.count(F.lit(1)).alias("_in")).withColumns(
            {"_below": F.sum("_in").over(whole.orderBy("_cell")) - F.col("_in"), "_n": F.sum("_in").over(whole)}
        )
        chosen = cells.withColumn("_picks", _wanted(ranks)).filter(F.size("_picks") > 0)
        named = [F.col(k).alias(f"_to{i}") for i, k in enumerate(by)]
        chosen = materialize(chosen.select(*named, F.to_json(F.struct(*by)).alias("_key"), F.col("_below").alias("_base"), "_n"), "cells")
        same = [F.col(k).eqNullSafe(F.col(f"_to{i}")) for i, k in enumerate(by)]
        data = data.join(broadcast_if_small(chosen.drop("_key", "_base", "_n")), reduce(and_, same))
    else:
        chosen = None
    counted = data.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_hash", F.xxhash64(*by))
    held = materialize(counted.repartitionByRange("_hash", "_v").withColumn("_piece", F.spark_partition_id()), "value-counts")
    # a group that lies in several pieces is at an end of each, so there are fewer of them than pieces
    ends = held.groupBy("_piece").agg(F.array(F.min("_hash"), F.max("_hash")).alias("_ends")).select("_piece", F.explode("_ends").alias("_hash"))
    cut = F.broadcast(materialize(ends.groupBy("_hash").agg(F.countDistinct("_piece").alias("_n")).filter("_n > 1").select("_hash"), "cut-groups"))

    group_of = Window.partitionBy(*by)
    upward = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = [*by, "_v", "_c", "_end", "_n"]
    together = held.join(cut, "_hash", "left_anti").withColumn("_end", F.sum("_c").over(upward.partitionBy(*by))).withColumn("_n", F.sum("_c").over(group_of))
    # the group as text, which is never NULL, so that NULL keys are a group like any other
    split = held.join(cut, "_hash", "left_semi").withColumn("_key", F.to_json(F.struct(*by)))
    in_order = Window.partitionBy("_key").orderBy("_piece")
    pieces = split.groupBy("_key", "_piece").agg(F.sum("_c").alias("_in"))
    pieces = pieces.withColumn("_below", F.sum("_in").over(in_order) - F.col("_in")).withColumn("_n", F.sum("_in").over(Window.partitionBy("_key")))
    split = split.join(broadcast_if_small(materialize(pieces.drop("_in"), "pieces")), ["_key", "_piece"])
    split = split.withColumn("_end", F.col("_below") + F.sum("_c").over(upward.partitionBy("_key", "_piece")))
    placed = together.select(*kept).unionAll(split.select(*kept))
    if chosen is not None:
        totals = chosen.select("_key", "_base", F.col("_n").alias("_all_n"))
        placed = placed.withColumn("_key", F.to_json(F.struct(*by))).join(broadcast_if_small(totals), "_key")
        placed = placed.withColumns({"_end": F.col("_end") + F.col("_base"), "_n": F.col("_all_n")})
    hits = {name: (rank(F.col("_n")) < F.col("_end")) & (rank(F.col("_n")) >= F.col("_end") - F.col("_c")) for name, rank in ranks.items()}
    picked = [F.max(F.when(hit, F.col("_v"))).alias(name) for name, hit in hits.items()]
    return placed.filter(reduce(or_, hits.values())).groupBy(*group).agg(F.max("_n").alias("_n"), *picked).select(*keys, "_n", *ranks)


def linear_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], stored: bool = False
) -> DataFrame:
    """Quantiles with linear interpolation at (n-1)q, plus ``_n``; keys + one column per name. A quantile that falls on a
    value, or between equal ones, is that value as a double."""
    ranks: dict[str, Rank] = {}
    for name, q in quantiles.items():
        ranks[f"_lo_{name}"] = lambda n, q=q: F.floor((n - 1) * F.lit(q))
        ranks[f"_up_{name}"] = lambda n, q=q: F.ceil((n - 1) * F.lit(q))
    picked = values_at_ranks(df, keys, value, ranks, stored)

    def mix(name: str, q: float) -> Column:
        at = (F.col("_n") - 1) * F.lit(q)
        low, high = F.col(f"_lo_{name}").cast("double"), F.col(f"_up_{name}").cast("double")
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name)

    return picked.select(*keys, "_n", *[mix(name, q) for name, q in quantiles.items()])


def upper_median(n: Column) -> Column:
    """0-based rank of ``sorted[n // 2]``."""
    return F.floor(n / 2)


def nearest_rank(q: float) -> Rank:
    """0-based rank of ``sorted[int(n * q)]``."""
    return lambda n: F.floor(n * F.lit(q))


def index_quartile(part: int) -> Rank:
    """0-based rank of ``sorted[part * n // 4]``."""
    return lambda n: F.floor(n * part / 4)
