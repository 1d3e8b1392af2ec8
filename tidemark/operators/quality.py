"""Data quality: a suite of checks in one pass, quarantine, gates and completeness."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import publish_path, remove_path


@dataclass(frozen=True)
class RowCheck:
    """``failed`` is true for a row that breaks the rule; a share of ``mostly`` must hold."""

    name: str
    failed: Column
    mostly: float = 1.0


def not_null(column: str, mostly: float = 1.0) -> RowCheck:
    return RowCheck(f"{column} not null", F.col(column).isNull(), mostly)


def between(column: str, low: float | None = None, high: float | None = None, mostly: float = 1.0) -> RowCheck:
    """Either end may be open; NULLs pass."""
    value, failed = F.col(column), F.lit(False)
    if low is not None:
        failed = failed | (value < low)
    if high is not None:
        failed = failed | (value > high)
    return RowCheck(f"{column} between", F.coalesce(failed, F.lit(False)), mostly)


def in_set(column: str, values: Sequence[object], mostly: float = 1.0) -> RowCheck:
    return RowCheck(f"{column} in set", F.coalesce(~F.col(column).isin(list(values)), F.lit(False)), mostly)


def matches(column: str, pattern: str, mostly: float = 1.0) -> RowCheck:
    return RowCheck(f"{column} matches", F.coalesce(~F.col(column).rlike(pattern), F.lit(False)), mostly)


def rows_as_results(wide: DataFrame, checks: Sequence[tuple[str, Column, Column, Column]]) -> DataFrame:
    """One row of totals to one row per check: (name, total, failed, success)."""
    if not checks:
        return wide.sparkSession.createDataFrame([], "check string, total long, failed long, success boolean")
    entries = [
        F.struct(F.lit(n).alias("check"), t.alias("total"), f.alias("failed"), s.alias("success")) for n, t, f, s in checks
    ]
    return wide.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def _tallies(checks: Sequence[RowCheck]) -> list[Column]:
    """The row count and the failed rows per check."""
    failed = [F.coalesce(F.sum(c.failed.cast("long")), F.lit(0)).alias(f"_f{i}") for i, c in enumerate(checks)]
    return [F.count(F.lit(1)).alias("_total"), *failed]


def run_suite(
    df: DataFrame,
    checks: Sequence[RowCheck],
    columns: Sequence[str] = (),
    unique: Sequence[str] = (),
    row_count: tuple[int | None, int | None] | None = None,
) -> DataFrame:
    """Result rows (check, total, failed, success).

    All row checks and the row count share one aggregate; each unique column needs a shuffle on that
    column and adds one. Column-existence checks read the schema only.
    """
    total = F.col("_total")
    wide = df.agg(*_tallies(checks))
    results = []
    for i, check in enumerate(checks):
        failed = F.col(f"_f{i}")
        held = F.when(total > 0, F.lit(1.0) - failed / total).otherwise(1.0)
        success = (failed == 0) if check.mostly >= 1.0 else (held >= check.mostly)
        results.append((check.name, total, failed, success))
    if row_count is not None:
        low, high = row_count
        ok = reduce(lambda a, b: a & b, [F.lit(True)] + ([total >= low] if low is not None else []) + ([total <= high] if high is not None else []))
        results.append(("row count", total, F.when(ok, F.lit(0)).otherwise(F.lit(1)).cast("long"), ok))
    for column in columns:
        there = column in df.columns
        results.append((f"{column} exists", total, F.lit(0 if there else 1).cast("long"), F.lit(there)))
    out = rows_as_results(wide, results)
    for column in unique:
        out = out.unionAll(unique_check(df, column))
    return out


def unique_check(df: DataFrame, column: str) -> DataFrame:
    """Rows sharing their non-null value with another row count as failed."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    wide = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("_total"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("_failed"),
    )
    return rows_as_results(wide, [(f"{column} unique", F.col("_total"), F.col("_failed"), F.col("_failed") == 0)])


def quality_score(results: DataFrame) -> DataFrame:
    """Passed checks as a percentage; 0 for an empty suite."""
    out = results.agg(F.count_if("success").alias("passed"), F.count(F.lit(1)).alias("checks"))
    return out.withColumn("score", F.when(F.col("checks") > 0, F.col("passed") / F.col("checks") * 100).otherwise(0.0))


def with_failed_checks(df: DataFrame, checks: Sequence[RowCheck]) -> DataFrame:
    """Adds ``failed_checks``: the names a row breaks; filter on its size to split or quarantine."""
    names = F.array(*[F.when(c.failed, F.lit(c.name)) for c in checks])
    return df.withColumn("failed_checks", F.array_compact(names))


def quarantined(df: DataFrame, checks: Sequence[RowCheck]) -> tuple[DataFrame, DataFrame]:
    """(good rows, failing rows with the names of the checks they break)."""
    marked = with_failed_checks(df, checks)
    broken = F.size("failed_checks") > 0
    return marked.filter(~broken).drop("failed_checks"), marked.filter(broken)


def freshness(df: DataFrame, ts: str, as_of: str, hours: float) -> DataFrame:
    lag = (F.unix_timestamp(F.lit(as_of).cast("timestamp_ntz")) - F.unix_timestamp(F.max(ts))) / 3600
    return df.agg(F.max(ts).alias("latest"), lag.alias("lag_hours")).withColumn("fresh", F.col("lag_hours") <= hours)


# Fixed values: (level, completeness above %, accuracy above %, lag below hours), best first.
GATE_LEVELS = [("production", 99.9, 99.5, 1.0), ("staging", 99.0, 99.0, 4.0), ("development", 95.0, 95.0, 24.0)]


def gate_level(completeness: Column, accuracy: Column, lag_hours: Column) -> Column:
    out = None
    for level, complete, accurate, lag in GATE_LEVELS:
        met = (completeness > complete) & (accuracy > accurate) & (lag_hours < lag)
        out = F.when(met, level) if out is None else out.when(met, level)
    return out.otherwise("failed")


def load_gate(df: DataFrame, amount: str, id: str, negative_share: float = 0.01) -> DataFrame:
    """NULL amounts fail; more than 1% negative amounts fail; duplicate ids are reported. An empty
    input has no negative share and passes."""
    per_id = df.groupBy(id).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(amount).isNull()).alias("nulls"), F.count_if(F.col(amount) < 0).alias("negative")
    )
    out = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_amounts"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative_amounts"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"),
    )
    share = F.when(F.col("total_records") > 0, F.col("negative_amounts") / F.col("total_records")).otherwise(0.0)
    verdict = F.when(F.col("null_amounts") > 0, "null amounts").when(share > negative_share, "negative amounts").otherwise("pass")
    return out.withColumn("verdict", verdict)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column from one aggregate."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def schema_differences(df: DataFrame, expected: StructType) -> list[tuple[str, str, str]]:
    """(column, expected type, found type) for every mismatch; '' where a side lacks the column."""
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}
    names = [*want, *[c for c in found if c not in want]]
    return [(c, want.get(c, ""), found.get(c, "")) for c in names if want.get(c) != found.get(c)]


def gated_load(raw: DataFrame, raw_checks: Sequence[RowCheck], transform, checks: Sequence[RowCheck], path: str) -> DataFrame:
    """Validate raw rows, transform, validate again, write, in one job; raises when a check fails, and ``path`` stays as it was.

    Both validations are tallied while the rows are written to a staging folder beside ``path``: raw is read once and
    ``transform`` evaluated once. A task that runs again may be tallied twice, which can change a share only
    where some rows failed, never turn none into some. Returns what was written.
    """
    spark, staged = raw.sparkSession, f"{path}.staged-{uuid.uuid4().hex}"
    before, after = Observation(), Observation()
    made = transform(raw.observe(before, *_tallies(raw_checks))).observe(after, *_tallies(checks))
    try:
        made.write.parquet(staged)
        for stage, tally, suite in (("raw", before.get, raw_checks), ("transformed", after.get, checks)):
            broken = [c.name for i, c in enumerate(suite) if not _held(tally["_total"], tally[f"_f{i}"], c.mostly)]
            if broken:
                raise ValueError(f"{stage} data failed: {', '.join(broken)}")
        publish_path(spark, staged, path)
    finally:
        remove_path(spark, staged)
    return spark.read.schema(made.schema).parquet(path)


def _held(total: int, failed: int, mostly: float) -> bool:
    return failed == 0 or (mostly < 1.0 and 1.0 - failed / total >= mostly)


def missing_days(df: DataFrame, ts: str) -> DataFrame:
    """Days between the first and the last day that have no row."""
    seen = df.select(F.to_date(ts).alias("day")).distinct()
    span = seen.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return span.select(F.explode(F.sequence("first", "last")).alias("day")).join(seen, "day", "left_anti")


def composite_gate(df: DataFrame, id: str, ts: str, as_of: str, hours: float = 24) -> DataFrame:
    """Non-empty, id column there, no NULL id, younger than ``hours``: one row, one pass."""
    if id not in df.columns:
        return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("verdict", F.lit(f"missing column {id}"))
    lag = (F.unix_timestamp(F.lit(as_of).cast("timestamp_ntz")) - F.unix_timestamp(F.max(ts))) / 3600
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(id).isNull()).alias("null_ids"), lag.alias("lag_hours"))
    verdict = (
        F.when(F.col("rows") == 0, "empty").when(F.col("null_ids") > 0, "null ids")
        .when(F.col("lag_hours") >= hours, "stale").otherwise("pass")
    )
    return out.withColumn("verdict", verdict)
