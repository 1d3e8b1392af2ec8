"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source gets the same fractional number of copies, target / source size. The whole
part is certain; the fractions are rounded by the pivotal method: two documents at a time, words move from
one to the other until one of the two fractions is 0 or 1. The direction is drawn so that every
document keeps its expected copies, and since words move, the words of a source stay at the target up to the
one fraction left at the very end, which goes to the nearer side; long documents come first, so that this
is seldom a long one. Documents are rounded in buckets of bounded size; each bucket leaves at most one
fraction, and those meet in the next level of a reduction tree.

Edge cases: null text has size 0 and is never taken; a null source is a source of its own, last in
order; repeated rows are rounded together and their copies spread over them; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, row_key, text_of
from tidemark.session import materialize

BUCKET = 4096
TINY = 1e-9


def word_count(text):
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """``source, source_size`` -> the same with ``target``: one row per source in, one row out.

    Sources in code point order (null last) take the weights in turn. A target never exceeds ``limit`` times the
    source; what is cut is shared among the others by weight. In the order of the level at which sources
    reach their limit, a source is limited when its limit lies below its share of what is left then.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    t = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    t = t.withColumn("most", F.col("source_size") * F.lit(float(limit)))
    level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("share", left / weight_left)
    t = t.withColumn("limited", F.col("most") <= F.col("share") * F.col("weight"))
    free = F.min(F.when(~F.col("limited"), F.struct(F.col("most") / F.col("weight"), "share"))).over(whole)["share"]
    return t.select("source", "source_size", F.when(F.col("limited"), F.col("most")).otherwise(free * F.col("weight")).alias("target"))


def _unit_draw(ids: pd.Series, sizes: np.ndarray, seed: int) -> np.ndarray:
    """A repeatable draw in [0, 1) from a document's id and size."""
    h = pd.util.hash_array(ids.fillna("").to_numpy(object)) ^ (sizes.astype("uint64") * np.uint64(0x9E3779B97F4A7C15))
    h = (h + np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype("float64") / 2.0**53


def pivot(part: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Rounds fractions ``part`` in turn; the returned array holds 0, 1 and at most one fraction."""
    out = part.copy()
    a = -1
    for b in range(len(out)):
        if not TINY < out[b] < 1 - TINY:
            out[b] = round(out[b])
            continue
        if a < 0:
            a = b
            continue
        up = min((1 - out[a]) * size[a], out[b] * size[b])
        down = min(out[a] * size[a], (1 - out[b]) * size[b])
        moved = up if draw[b] * (up + down) < down else -down
        out[a] += moved / size[a]
        out[b] -= moved / size[b]
        rest = -1
        for i in (a, b):
            if out[i] <= TINY or out[i] >= 1 - TINY:
                out[i] = round(out[i])
            else:
                rest = i
        a = rest
    return out


def _round_level(items: DataFrame, seed: int, last: bool) -> DataFrame:
    """One level of the tree: each (source, bucket) keeps at most one fraction, none in the last level."""

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "digest"], ascending=[False, True], kind="stable").reset_index(drop=True)
        size = pdf["size"].to_numpy("float64")
        draw = _unit_draw(pdf["key"], pdf["size"].to_numpy(), seed)
        out = pivot(pdf["part"].to_numpy("float64"), size, draw)
        if last:
            out = np.round(out)
        return pdf.assign(part=out)

    return items.groupBy("source", "bucket").applyInPandas(reduce, items.schema)


def decide(units: DataFrame, goal: DataFrame, seed: int = 17) -> DataFrame:
    """Units (key, source, size, rows) with ``base`` copies for each row and ``extra`` more for all rows together.

    Runs one job per level of the tree; a level divides the open fractions by ``BUCKET``.
    """
    same = F.col("u.source").eqNullSafe(F.col("g.source"))
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(3.0))).otherwise(F.lit(0.0))
    u = units.alias("u").join(goal.alias("g"), same).select("u.*", "source_size", "target", copies.alias("copies"))
    u = u.withColumn("base", F.floor(F.col("copies") + TINY))
    whole = F.greatest(F.lit(0.0), F.col("copies") - F.col("base")) * F.col("rows")
    u = u.withColumn("whole", F.floor(whole + TINY)).withColumn("part", F.greatest(F.lit(0.0), whole - F.col("whole")))
    u = u.withColumn("digest", F.xxhash64("key", "size", "source"))
    u = materialize(u.withColumn("open", (F.col("part") > TINY) & (F.col("size") > 0)), "mix-units")
    counts = u.filter("open").groupBy("source").agg(F.count("*").alias("n"))
    buckets = counts.select("source", F.ceil(F.col("n") / BUCKET).alias("buckets"))
    most = buckets.agg(F.max("buckets")).first()[0] or 0
    keep = ["key", "source", "size", "rows", "source_size", "target", "base", "whole", "part", "digest"]
    done = u.filter("not open").select(*keep, F.lit(0.0).alias("pick")).drop("part")
    if most:
        items = u.filter("open").alias("u").join(buckets.alias("b"), F.col("u.source").eqNullSafe(F.col("b.source")))
        items = items.select(*[F.col(f"u.{c}") for c in keep], F.pmod("digest", "buckets").alias("bucket"))
        level = 0
        while True:
            last = most == 1
            out = materialize(_round_level(items, seed + level, last), "mix-level")
            whole_now = F.col("part").isin(0.0, 1.0)
            done = done.unionByName(out.filter(whole_now).withColumn("pick", F.col("part")).drop("part", "bucket"))
            if last:
                break
            items = out.filter(~whole_now).withColumn("bucket", F.floor(F.col("bucket") / BUCKET))
            most, level = math.ceil(most / BUCKET), level + 1
    return done.select("key", "source", "size", "rows", "source_size", "target", "base", (F.col("whole") + F.col("pick")).cast("long").alias("extra"))


def sized(docs: DataFrame, key) -> DataFrame:
    """One row per distinct (key, source, size) with the number of rows: the only pass over the texts."""
    rows = docs.select(key.cast("string").alias("key"), F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"))
    return materialize(rows.groupBy("key", "source", "size").agg(F.count("*").alias("rows")), "mix-sizes")


def mix(docs: DataFrame, key=None, weights: tuple[int, ...] = (5, 2, 1), limit: float = 3.0, seed: int = 17) -> DataFrame:
    """The decisions for ``docs`` (doc_id, text, source): see ``decide``. ``key`` names a document, its doc_id by default."""
    units = sized(docs, F.col("doc_id") if key is None else key)
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    goal = materialize(targets(totals, weights, limit), "mix-targets")
    return decide(units, goal, seed)


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and the words ``taken``."""
    plan = mix(docs, **options).withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    taken = (F.col("base") + (F.col("turn") <= F.col("extra")).cast("long")) * F.col("size")
    return plan.select(F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


def resample(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (not at all, or up to ``limit`` times)."""
    names = [f"`{c}`" for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("row"), row_key(docs).alias("key"))
    plan = mix(docs, key=row_key(docs), **options).select(F.col("key"), "base", "extra", "rows")
    both = keyed.join(plan, "key")
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    copies = (F.col("base") + (F.col("turn") <= F.col("extra")).cast("long")).cast("int")
    return both.withColumn("turn", turn).withColumn("n", copies).filter("n > 0").select(F.explode(F.array_repeat("row", F.col("n"))).alias("row")).select("row.*")
