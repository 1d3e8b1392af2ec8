"""Audit, lineage and integrity. An event is an audit record; the accessed table follows from its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import governance as ops
from tidemark.plans.inputs import table
from tidemark.plans.registry import query
from tidemark.session import materialize, scratch_path
from tidemark.sources import files, sinks

# The audited tables.
AUDITED = ["production.sales_transactions", "production.customers", "finance.revenue_daily", "ops.admin_users", "production.orders"]
NAME_SQL = "[" + ", ".join(f"'{t}'" for t in AUDITED) + "][event_id % 5 + 1]"
AUDIT_SQL = f"""SELECT event_id, ts, user_id AS "user", {NAME_SQL} AS table_name, (value * 10000)::BIGINT AS rows_read, event_type FROM events"""
AS_OF = "2024-01-31"


def audit(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in AUDITED])
    return table(spark, d, "events").select(
        "event_id", "ts", F.col("user_id").alias("user"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("table_name"),
        F.round(F.col("value") * 10000).cast("long").alias("rows_read"), "event_type",
    )


@query("gov_01_table_access", f"""SELECT event_id, ts, "user" FROM ({AUDIT_SQL}) WHERE table_name = 'production.sales_transactions'
    AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def table_access(spark: SparkSession, d: str) -> DataFrame:
    return ops.table_access(audit(spark, d), "production.sales_transactions", AS_OF).select("event_id", "ts", "user")


@query("gov_02_user_access", f"""SELECT table_name, count(*) AS access_count, max(ts) AS last_access FROM ({AUDIT_SQL}) WHERE "user" = 17
    AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1""")
def user_access(spark: SparkSession, d: str) -> DataFrame:
    return ops.user_access(audit(spark, d), 17, AS_OF)


@query("gov_03_failed_access", f"""SELECT ts, "user", table_name FROM ({AUDIT_SQL}) WHERE event_type = 'error' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY""")
def failed_access(spark: SparkSession, d: str) -> DataFrame:
    return ops.failed_access(audit(spark, d), AS_OF).select("ts", "user", "table_name")


@query("gov_03_permission_changes", f"""SELECT ts, "user", event_type FROM ({AUDIT_SQL}) WHERE event_type IN ('signup', 'purchase') AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def permission_changes(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups and purchases stand for grants and revokes."""
    return ops.permission_changes(audit(spark, d), AS_OF, ("signup", "purchase")).select("ts", "user", "event_type")


@query("gov_04_pii_access", f"""SELECT event_id, ts, "user", table_name FROM ({AUDIT_SQL}) WHERE table_name IN ('production.customers', 'production.orders')
    AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 12 MONTH""")
def pii_access(spark: SparkSession, d: str) -> DataFrame:
    return ops.pii_access(audit(spark, d), ["production.customers", "production.orders"], AS_OF).select("event_id", "ts", "user", "table_name")


@query("gov_04_finance_by_month", f"""SELECT date_trunc('month', ts)::TIMESTAMP AS month, "user", count(*) AS access_count, count(DISTINCT table_name) AS tables_accessed
    FROM ({AUDIT_SQL}) WHERE table_name LIKE '%sales%' OR table_name LIKE '%revenue%' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 12 MONTH GROUP BY 1, 2""")
def finance_by_month(spark: SparkSession, d: str) -> DataFrame:
    return ops.finance_access_by_month(audit(spark, d), AS_OF)


@query("gov_05_suspicious", f"""WITH a AS ({AUDIT_SQL})
    SELECT 'bulk export' AS reason, "user", ts AS "at", event_id AS detail FROM a WHERE rows_read > 1000000
    UNION ALL SELECT 'outside hours', "user", ts, event_id FROM a WHERE hour(ts) < 6 OR hour(ts) > 22
    UNION ALL SELECT 'admin table', "user", ts, event_id FROM a WHERE contains(table_name, 'admin')
    UNION ALL SELECT 'failed attempts', "user", date_trunc('hour', ts)::TIMESTAMP, count(*) FROM a WHERE event_type = 'error' GROUP BY 2, 3 HAVING count(*) > 1""")
def suspicious(spark: SparkSession, d: str) -> DataFrame:
    """More than one failure per hour counts here; the library default is more than ten."""
    return ops.suspicious_access(audit(spark, d), failures=1)


MAIL_SQL = "SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example.com' AS email FROM customer"


@query("gov_06_masking", rf"""SELECT c_custkey, regexp_replace(email, '@.*$', '***@***') AS domain_masked, regexp_replace(email, '^[^@]+@', '***@') AS name_masked FROM ({MAIL_SQL})""")
def masking(spark: SparkSession, d: str) -> DataFrame:
    email = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.com"))
    return table(spark, d, "customer").select(
        "c_custkey", ops.masked_domain(email).alias("domain_masked"), ops.masked_name(email).alias("name_masked")
    )


@query("gov_07_retained_log", f"""SELECT event_id, "user", table_name, event_type, ts::DATE AS date FROM ({AUDIT_SQL}) WHERE ts >= TIMESTAMP '2024-01-20'""")
def retained_log(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "audit")
    ops.append_audit(audit(spark, d), path)
    ops.expire_audit(spark, path, "2024-01-20")
    schema = "event_id LONG, user LONG, table_name STRING, rows_read LONG, ts TIMESTAMP_NTZ, event_type STRING, date DATE"
    return ops.retained_audit(spark, path, schema, "2024-01-20").select("event_id", "user", "table_name", "event_type", "date")


@query("gov_07_expired_days", f"SELECT DISTINCT event_type, ts::DATE AS date FROM ({AUDIT_SQL}) WHERE ts < TIMESTAMP '2024-01-20'")
def expired_days(spark: SparkSession, d: str) -> DataFrame:
    """The partitions that retention dropped, less any that storage still holds."""
    path = scratch_path(spark, "audit")
    ops.append_audit(audit(spark, d), path)
    gone = spark.createDataFrame([(f,) for f in ops.expire_audit(spark, path, "2024-01-20")], "folder string")
    left = spark.read.option("basePath", path).json(path).select("event_type", "date").distinct()
    found = gone.select(F.regexp_extract("folder", "event_type=([^/]+)/", 1).alias("event_type"), F.regexp_extract("folder", "date=([^/]+)$", 1).cast("date").alias("date"))
    return found.join(left, ["event_type", "date"], "left_anti")


EDGES_SQL = """SELECT DISTINCT 'supplier/' || l_suppkey AS source, 'part/' || l_partkey AS target, 'ships' AS kind FROM lineitem
    UNION ALL SELECT 'part/' || p_partkey, 'brand/' || p_brand, 'belongs' FROM part
    UNION ALL SELECT DISTINCT 'brand/' || p_brand, 'type/' || p_type, 'covers' FROM part"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """supplier -> part -> brand -> type as lineage edges."""
    def link(df: DataFrame, a: tuple[str, str], b: tuple[str, str], kind: str) -> DataFrame:
        ends = [F.concat(F.lit(p), F.col(c).cast("string")).alias(n) for (p, c), n in ((a, "source"), (b, "target"))]
        return df.select(*ends, F.lit(kind).alias("kind"))

    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    part = table(spark, d, "part")
    return (
        link(lines, ("supplier/", "l_suppkey"), ("part/", "l_partkey"), "ships")
        .unionAll(link(part, ("part/", "p_partkey"), ("brand/", "p_brand"), "belongs"))
        .unionAll(link(part.select("p_brand", "p_type").distinct(), ("brand/", "p_brand"), ("type/", "p_type"), "covers"))
    )


@query("gov_08_lineage_report", f"SELECT target, count(DISTINCT source) AS sources, count(DISTINCT kind) AS kinds FROM ({EDGES_SQL}) GROUP BY 1")
def lineage_report(spark: SparkSession, d: str) -> DataFrame:
    """The edges are appended to a lineage table in two loads and reported from there."""
    path, all_edges = scratch_path(spark, "lineage"), edges(spark, d)
    all_edges.filter("kind = 'ships'").write.mode("append").parquet(path)
    all_edges.filter("kind <> 'ships'").write.mode("append").parquet(path)
    return ops.lineage_report(spark.read.parquet(path))


@query("gov_08_consumers", f"SELECT target, kind FROM ({EDGES_SQL}) WHERE source = 'supplier/7'")
def consumers(spark: SparkSession, d: str) -> DataFrame:
    return ops.consumers(edges(spark, d), "supplier/7")


@query("gov_09_downstream", f"""WITH RECURSIVE e AS ({EDGES_SQL}), r AS (SELECT 'supplier/7' AS node, 0 AS hops UNION
    SELECT e.target, r.hops + 1 FROM e JOIN r ON e.source = r.node) SELECT node, min(hops) AS hops FROM r GROUP BY 1""")
def downstream(spark: SparkSession, d: str) -> DataFrame:
    return ops.downstream(materialize(edges(spark, d), "edges"), "supplier/7")


@query("gov_10_source_files", "SELECT 'orders.parquet' AS source, 'revenue' AS target UNION ALL SELECT 'customer.parquet', 'revenue'")
def source_files(spark: SparkSession, d: str) -> DataFrame:
    found = ops.source_files(table(spark, d, "orders").select("o_orderkey"), "revenue").unionAll(
        ops.source_files(table(spark, d, "customer").select("c_custkey"), "revenue")
    )
    return found.select(F.regexp_extract("source", r"([a-z]+\.parquet)", 1).alias("source"), "target").distinct()


@query("int_01_checksums", "SELECT 'verified' AS status, 4 AS n UNION ALL SELECT 'mismatch', 1 UNION ALL SELECT 'missing', 1 UNION ALL SELECT 'unlisted', 1")
def checksums(spark: SparkSession, d: str) -> DataFrame:
    """Six files; the manifest has a wrong sum for one, lacks one and lists one that is gone."""
    path = scratch_path(spark, "sums")
    sinks.write_files(table(spark, d, "orders"), path, 6)
    found = materialize(ops.block_checksums(files.read_bytes(spark, path, "*.parquet").select("path", "length"), 4096), "found")
    part = F.regexp_extract("path", r"part-0*([0-9]+)-", 1).cast("int")
    listed = found.filter(part != 1).withColumn("md5", F.when(part == 2, "0").otherwise(F.col("md5")))
    gone = spark.range(1).select(F.lit("gone.parquet").alias("path"), F.lit("0").alias("md5"))
    return ops.verify_checksums(found, listed.unionAll(gone)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("int_02_partitions", """SELECT DISTINCT year(o_orderdate)::VARCHAR AS year, 'orphaned' AS status FROM orders WHERE year(o_orderdate) = 1996
    UNION ALL SELECT '2005', 'missing'""")
def partitions(spark: SparkSession, d: str) -> DataFrame:
    """The catalog lacks 1996 and lists 2005."""
    path, orders = scratch_path(spark, "parts"), table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    orders.write.partitionBy("year").parquet(path)
    listed = orders.select(F.when(F.col("year") == 1996, 2005).otherwise(F.col("year")).cast("string").alias("year")).distinct()
    return ops.partition_differences(listed, ops.folder_partitions(spark, path, ["year"]), ["year"])


@query("int_03_schema_consistency", "SELECT 'o_custkey' AS \"column\", 'bigint' AS expected, 'string' AS found UNION ALL SELECT 'o_totalprice', 'double', ''")
def schema_consistency(spark: SparkSession, d: str) -> DataFrame:
    a, b, orders = scratch_path(spark, "a"), scratch_path(spark, "b"), table(spark, d, "orders")
    orders.select("o_orderkey", "o_custkey", "o_totalprice").write.parquet(a)
    orders.select("o_orderkey", F.col("o_custkey").cast("string")).write.parquet(b)
    return ops.schema_consistency(spark, [a, b]).drop("path").distinct()


@query("int_04_fingerprint", """SELECT count(*) AS rows, (2 * count(*) - count(quality) - count(toxic))::BIGINT AS nulls, true AS same
    FROM documents LEFT JOIN labels USING (doc_id)""")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The print of a table and of a re-partitioned copy."""
    docs = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id", "left")
    copy = ops.fingerprint(docs.repartition(7, "text"))
    return ops.fingerprint(docs).select("rows", "nulls", (F.col("checksum") == copy.select("checksum").scalar()).alias("same"))


@query("int_05_retention", """SELECT o_orderkey, CASE WHEN age > 365 THEN dayofmonth(d) = 1 WHEN age > 30 THEN dayofweek(d) = 0
    WHEN age > 7 THEN false ELSE true END AS keep FROM (SELECT o_orderkey, o_orderdate::DATE AS d, date_diff('day', o_orderdate::DATE, DATE '2001-08-02') AS age FROM orders)""")
def retention(spark: SparkSession, d: str) -> DataFrame:
    inventory = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return ops.retention(inventory, "date", "2001-08-02").drop("date")


@query("int_06_empty_partitions", "SELECT 16 - count(DISTINCT 1) AS empty FROM orders")
def empty_partitions(spark: SparkSession, d: str) -> DataFrame:
    """All rows share one key, so 15 of 16 partitions are empty."""
    one_key = table(spark, d, "orders").select("o_orderkey", F.lit(1).alias("k")).withColumn("k", F.col("k") + F.col("o_orderkey") * 0)
    return ops.empty_partitions(one_key.repartition(16, "k"), 16).agg(F.count(F.lit(1)).alias("empty"))


TEXTS = [
    "SELECT * FROM orders ORDER BY o_orderdate", "SELECT o_orderkey FROM orders CROSS JOIN nation LIMIT 5",
    "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)",
    "SELECT COUNT(a), COUNT(b), COUNT(c), COUNT(d) FROM t", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 10",
]
TEXT_SQL = "[" + ", ".join(f"'{t}'" for t in TEXTS) + "][o_orderkey % 5 + 1]"


@query("int_07_lint", f"""WITH q AS (SELECT o_orderkey, {TEXT_SQL} || ' -- ' || o_orderpriority AS t FROM orders), f AS (SELECT o_orderkey, contains(upper(t), 'SELECT *') AS select_star,
        contains(upper(t), 'CROSS JOIN') AS cross_join, contains(upper(t), 'DISTINCT') AS uses_distinct, regexp_matches(upper(t), 'WHERE.*IN \\(SELECT') AS in_subquery,
        len(regexp_extract_all(t, 'COUNT\\(')) > 3 AS many_counts, contains(upper(t), 'ORDER BY') AND NOT contains(upper(t), 'LIMIT') AS unlimited_order FROM q)
    SELECT *, select_star::INT + unlimited_order::INT + cross_join::INT * 2 AS cost FROM f""")
def lint(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array(*[F.lit(t) for t in TEXTS])
    text = F.concat(F.element_at(texts, (F.col("o_orderkey") % 5 + 1).cast("int")), F.lit(" -- "), "o_orderpriority")
    return ops.lint(table(spark, d, "orders").select("o_orderkey", text.alias("query")), "query").drop("query")


@query("int_08_table_differences", """WITH n AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P'),
    o AS (SELECT o_orderkey, o_totalprice FROM orders)
    SELECT 'left' AS side, * FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL SELECT 'right', * FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)""")
def table_differences(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    price = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", price.alias("o_totalprice"))
    return ops.table_differences(old, new)
