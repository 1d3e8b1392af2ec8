"""Audit, lineage and integrity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.session import Steps, matching, remove_path
from tidemark.sources.files import file_system, read_bytes

BLOCK = 64 * 1024 * 1024

# ---- audit ------------------------------------------------------------------------------------


def since(ts: str, as_of: str, interval: str) -> Column:
    """``ts`` later than the as-of time minus an interval such as '7 DAYS'."""
    return F.col(ts) > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {interval}")


def table_access(audit: DataFrame, table: str, as_of: str) -> DataFrame:
    recent = audit.filter((F.col("table_name") == table) & since("ts", as_of, "7 DAYS"))
    return recent.orderBy(F.desc("ts"))


def user_access(audit: DataFrame, user: object, as_of: str) -> DataFrame:
    recent = audit.filter((F.col("user") == user) & since("ts", as_of, "30 DAYS"))
    return recent.groupBy("table_name").agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_access"))


def failed_access(audit: DataFrame, as_of: str, interval: str = "1 DAY") -> DataFrame:
    return audit.filter((F.col("event_type") == "error") & since("ts", as_of, interval))


def permission_changes(audit: DataFrame, as_of: str, kinds: Sequence[str] = ("grantPrivilege", "revokePrivilege")) -> DataFrame:
    return audit.filter(F.col("event_type").isin(list(kinds)) & since("ts", as_of, "7 DAYS"))


def pii_access(audit: DataFrame, tables: Sequence[str], as_of: str) -> DataFrame:
    return audit.filter(F.col("table_name").isin(list(tables)) & since("ts", as_of, "12 MONTHS"))


def finance_access_by_month(audit: DataFrame, as_of: str) -> DataFrame:
    """As written in the report: AND binds before OR, so the date limit covers the revenue tables only."""
    name = F.col("table_name")
    held = audit.filter(name.like("%sales%") | (name.like("%revenue%") & since("ts", as_of, "12 MONTHS")))
    return held.groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), "user").agg(
        F.count(F.lit(1)).alias("access_count"), F.countDistinct("table_name").alias("tables_accessed")
    )


def suspicious_access(audit: DataFrame, bulk_rows: int = 1_000_000, failures: int = 10) -> DataFrame:
    """(reason, user, at, detail) of bulk reads, accesses before 6 or after 22, admin tables, and users
    with more than ``failures`` errors in an hour.

    The row reasons come from one pass; a row with several reasons appears once per reason.
    """
    hour = F.hour("ts")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("rows_read") > bulk_rows, "bulk export"),
            F.when((hour < 6) | (hour > 22), "outside hours"),
            F.when(F.col("table_name").contains("admin"), "admin table"),
        )
    )
    rows = audit.select(F.explode(reasons).alias("reason"), "user", F.col("ts").alias("at"), F.col("event_id").alias("detail"))
    hourly = (
        audit.filter(F.col("event_type") == "error")
        .groupBy("user", F.window("ts", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("detail"))
        .filter(F.col("detail") > failures)
        .select(F.lit("failed attempts").alias("reason"), "user", F.col("w.start").cast("timestamp_ntz").alias("at"), "detail")
    )
    return rows.unionByName(hourly)


def masked_domain(email: Column) -> Column:
    """The policy as given: keeps the name and replaces the domain."""
    domain = F.regexp_extract(email, "(@.*)$", 1)
    return F.when(domain != "", F.replace(email, domain, F.lit("***@***"))).otherwise(email)


def masked_name(email: Column) -> Column:
    return F.regexp_replace(email, "^[^@]+(?=@)", "***")


def append_audit(audit: DataFrame, path: str) -> None:
    """JSON lines partitioned by event type and date."""
    audit.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("event_type", "date").json(path)


def expire_audit(spark: SparkSession, path: str, first_day: str) -> list[str]:
    """Drops the dates before ``first_day`` from storage and returns the folders that went; their rows are not read.

    There is one folder per event type and day, so the calendar bounds the list.
    """
    old = [f for f in matching(spark, f"{path}/event_type=*/date=*") if f.rsplit("date=", 1)[1] < first_day]
    for folder in old:
        remove_path(spark, folder)
    return old


def retained_audit(spark: SparkSession, path: str, schema: str, first_day: str) -> DataFrame:
    """The log without the dates before ``first_day``; whole folders are pruned."""
    log = spark.read.schema(schema).option("basePath", path).json(path)
    return log.filter(F.col("date") >= F.lit(first_day).cast("date"))


# ---- lineage ----------------------------------------------------------------------------------

def consumers(edges: DataFrame, table: str) -> DataFrame:
    return edges.filter(F.col("source") == table).select("target", "kind")


def lineage_report(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target").agg(F.countDistinct("source").alias("sources"), F.countDistinct("kind").alias("kinds"))


def downstream(edges: DataFrame, root: str) -> DataFrame:
    """Everything reachable from ``root`` with its distance, one join per hop (runs two actions per hop).

    Each hop keeps only nodes not seen before and is written to the shared folder; it ends when a hop finds nothing new.
    """
    spark = edges.sparkSession
    hops = Steps(spark, "downstream")
    frontier = hops.add(spark.createDataFrame([(root,)], "node string"))
    while not frontier.isEmpty():
        step = edges.join(frontier.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        frontier = hops.add(step.join(hops.all().select("node"), "node", "left_anti"))
    return hops.all().withColumnRenamed("_step", "hops")


def source_files(df: DataFrame, target: str) -> DataFrame:
    """One edge per file a frame reads, found where the files are read."""
    return df.select(F.input_file_name().alias("source")).distinct().select("source", F.lit(target).alias("target"))


# ---- integrity --------------------------------------------------------------------------------

def block_checksums(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, md5) of files given as (path, length), of any size: no file is one value or one task's work.

    Every block is digested by itself; a file's sum is the digest of its blocks' digests in order. Sums of one ``block`` size compare.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(block).cast("long")))
    blocks = files.select("path", starts.alias("start"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = []
            for path, start in zip(batch["path"], batch["start"]):
                fs, place = file_system(path)
                with fs.open_input_file(place) as source:
                    size = min(block, source.size() - start)
                    sums.append(hashlib.md5(source.read_at(size, start) if size > 0 else b"").hexdigest())
            yield batch.assign(md5=sums)

    parts = blocks.repartition("path", "start").mapInPandas(digest, "path string, start long, md5 string")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("start", "md5"))), lambda b: b["md5"])
    return parts.groupBy("path").agg(F.md5(F.concat_ws("", in_order)).alias("md5"))


def verify_checksums(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, md5) found against listed: verified, mismatch, missing or unlisted."""
    joined = files.select("path", F.col("md5").alias("found")).join(manifest.select("path", F.col("md5").alias("listed")), "path", "full")
    status = (
        F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted")
        .when(F.col("found") == F.col("listed"), "verified").otherwise("mismatch")
    )
    return joined.withColumn("status", status)


def partition_differences(catalog: DataFrame, storage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partitions on one side only: 'missing' has no folder, 'orphaned' is not in the catalog."""
    joined = catalog.select(*keys, F.lit(True).alias("_c")).join(storage.select(*keys, F.lit(True).alias("_s")), list(keys), "full")
    status = F.when(F.col("_s").isNull(), "missing").when(F.col("_c").isNull(), "orphaned")
    return joined.withColumn("status", status).filter(F.col("status").isNotNull()).select(*keys, "status")


def folder_partitions(spark: SparkSession, path: str, keys: Sequence[str], glob: str = "*.parquet") -> DataFrame:
    """The distinct partition folders below ``path``; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(*[F.regexp_extract("path", f"/{k}=([^/]+)/", 1).alias(k) for k in keys]).distinct()


def schema_consistency(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, column, expected, found) where a Parquet file's footer differs from the first file's, first by folder given, then by name.

    The files below all paths are listed by Spark and their footers read in tasks; only the first one's columns reach the
    driver (runs a job). No files: no rows.
    """
    listed = [
        read_bytes(spark, p, "*.parquet").select(F.lit(i).alias("at"), "path", F.lit(p).alias("folder")) for i, p in enumerate(paths)
    ]
    every = reduce(DataFrame.unionAll, listed)
    lead = every.orderBy("at", "path").limit(1)
    first = {r["column"]: r["type"] for r in _footers(lead.select("path")).collect()}
    expected = F.create_map(*[F.lit(x) for pair in first.items() for x in pair]) if first else F.create_map().cast("map<string,string>")
    # one row per file, as wide as its schema
    found = _footers(every.select("path")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("column", "type"))).alias("found"))
    names = F.explode(F.array_union(F.map_keys("expected"), F.map_keys("found")))
    each = found.withColumn("expected", expected).withColumn("column", names).select(
        "path", "column", *[F.coalesce(F.element_at(side, F.col("column")), F.lit("")).alias(side) for side in ("expected", "found")]
    )
    return each.filter("expected <> found")


def _footers(files: DataFrame) -> DataFrame:
    """(path, column, type) from the footers of Parquet files; row groups are not read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                fs, place = file_system(path)
                fields = from_arrow_schema(pq.read_schema(place, filesystem=fs)).fields
                yield pd.DataFrame({"path": path, "column": [f.name for f in fields], "type": [f.dataType.simpleString() for f in fields]})

    return files.mapInPandas(read, "path string, column string, type string")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count, NULL count and a checksum that does not depend on row order."""
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h"), nulls.alias("n")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("nulls"), F.sum("h").alias("checksum")
    )


def retention(files: DataFrame, date: str, as_of: str, daily: int = 7, weekly: int = 30, monthly: int = 365) -> DataFrame:
    """Keep recent dailies, then Sundays, then firsts of the month; cut-offs in days before the as-of day."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col(date))
    keep = (
        F.when(age > monthly, F.dayofmonth(date) == 1)
        .when(age > weekly, F.dayofweek(date) == 1)
        .when(age > daily, False)
        .otherwise(True)
    )
    return files.withColumn("keep", keep)


def empty_partitions(df: DataFrame, partitions: int) -> DataFrame:
    """Ids of the partitions without rows, given the partition count."""
    held = df.select(F.spark_partition_id().alias("part")).distinct()
    every = df.sparkSession.range(partitions).select(F.col("id").cast("int").alias("part"))
    return every.join(held, "part", "left_anti")


def lint(queries: DataFrame, text: str) -> DataFrame:
    """Anti-pattern flags and a cost score (1 for SELECT *, 1 for ORDER BY without LIMIT, 2 for CROSS JOIN)."""
    sql = F.upper(F.col(text))
    flags = {
        "select_star": sql.contains("SELECT *"), "cross_join": sql.contains("CROSS JOIN"), "uses_distinct": sql.contains("DISTINCT"),
        "in_subquery": sql.rlike(r"WHERE.*IN \(SELECT"), "many_counts": F.regexp_count(F.col(text), F.lit(r"COUNT\(")) > 3,
        "unlimited_order": sql.contains("ORDER BY") & ~sql.contains("LIMIT"),
    }
    score = F.col("select_star").cast("int") + F.col("unlimited_order").cast("int") + F.col("cross_join").cast("int") * 2
    return queries.withColumns(flags).withColumn("cost", score)


def table_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only in one table, duplicates counted, labelled 'left' or 'right': both tables are read and shuffled once,
    every row counting +1 or -1."""
    names = [f"`{c}`" for c in left.columns]
    both = left.select(*names, F.lit(1).alias("_by")).unionByName(right.select(*names, F.lit(-1).alias("_by")))
    more = both.groupBy(*names).agg(F.sum("_by").alias("_by")).filter("_by <> 0")
    side = F.when(F.col("_by") > 0, "left").otherwise("right")
    return more.select(*names, side.alias("side"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_by"))).alias("_i")).drop("_i")
