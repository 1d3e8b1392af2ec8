"""Data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.operators import quality as ops
from tidemark.plans.inputs import table
from tidemark.plans.registry import query
from tidemark.plans.rows import PURCHASES_SQL, purchases, sparse_documents
from tidemark.session import scratch_path

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def suite() -> list[ops.RowCheck]:
    return [
        ops.not_null("event_id"),
        ops.not_null("props", mostly=0.95),
        ops.between("value", 1, 200, mostly=0.9),
        ops.between("value", low=0),
        ops.in_set("event_type", ["click", "view", "purchase", "signup"], mostly=0.75),
        ops.matches("props", r'^\{"k": [0-9]+\}$'),
    ]


RESULT = "SELECT '{name}' AS \"check\", count(*) AS total, count(*) FILTER ({failed}) AS failed, {success} AS success FROM events"
FAILS = {
    "event_id not null": ("event_id IS NULL", "count(*) FILTER (event_id IS NULL) = 0"),
    "props not null": ("props IS NULL", "1 - count(*) FILTER (props IS NULL) / count(*) >= 0.95"),
    "value between 1": ("value < 1 OR value > 200", "1 - count(*) FILTER (value < 1 OR value > 200) / count(*) >= 0.9"),
    "value between 2": ("value < 0", "count(*) FILTER (value < 0) = 0"),
    "event_type in set": ("event_type NOT IN ('click', 'view', 'purchase', 'signup')", "1 - count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase', 'signup')) / count(*) >= 0.75"),
    "props matches": ("NOT regexp_matches(props, '^\\{\"k\": [0-9]+\\}$')", "count(*) FILTER (NOT regexp_matches(props, '^\\{\"k\": [0-9]+\\}$')) = 0"),
}


def _result_sql(name: str) -> str:
    failed, success = FAILS[name]
    return RESULT.format(name=name.removesuffix(" 1").removesuffix(" 2"), failed=failed, success=success)


SUITE_SQL = " UNION ALL ".join(_result_sql(n) for n in FAILS) + """
    UNION ALL SELECT 'row count', count(*), CASE WHEN count(*) BETWEEN 1 AND 1000000000000 THEN 0 ELSE 1 END,
        count(*) BETWEEN 1 AND 1000000000000 FROM events
    UNION ALL SELECT 'user_id exists', count(*), 0, true FROM events
    UNION ALL SELECT 'country exists', count(*), 1, false FROM events
    UNION ALL SELECT 'event_id unique', sum(n)::BIGINT, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT, coalesce(sum(n) FILTER (n > 1), 0) = 0
        FROM (SELECT count(*) AS n FROM events GROUP BY event_id)
    UNION ALL SELECT 'user_id unique', sum(n)::BIGINT, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT, coalesce(sum(n) FILTER (n > 1), 0) = 0
        FROM (SELECT count(*) AS n FROM events GROUP BY user_id)"""


def _suite_results(spark: SparkSession, d: str) -> DataFrame:
    return ops.run_suite(
        table(spark, d, "events"), suite(), columns=["user_id", "country"], unique=["event_id", "user_id"],
        row_count=(1, 1_000_000_000_000),
    )


def _single(name: str, check: str, sql: str):
    """Register one check on its own."""

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _suite_results(spark, d).filter(F.col("check") == check)

    return run


_single("dq_01_column_exists", "country exists", "SELECT 'country exists' AS \"check\", count(*) AS total, 1 AS failed, false AS success FROM events")
_single("dq_05_unique", "user_id unique", """SELECT 'user_id unique' AS "check", sum(n)::BIGINT AS total,
    sum(n) FILTER (n > 1)::BIGINT AS failed, false AS success FROM (SELECT count(*) AS n FROM events GROUP BY user_id)""")


@query("dq_02_not_null_mostly", """SELECT 'quality not null' AS "check", count(*) AS total, count(*) - count(quality) AS failed,
    count(quality) / count(*) >= 0.3 AS success FROM documents LEFT JOIN labels USING (doc_id)""")
def not_null_mostly(spark: SparkSession, d: str) -> DataFrame:
    return ops.run_suite(sparse_documents(spark, d), [ops.not_null("quality", mostly=0.3)])


@query("dq_03_between", """SELECT 'n_chars between' AS "check", count(*) AS total, count(*) FILTER (n_chars < 100) AS failed,
    count(*) FILTER (n_chars < 100) = 0 AS success FROM documents""")
def between(spark: SparkSession, d: str) -> DataFrame:
    return ops.run_suite(table(spark, d, "documents"), [ops.between("n_chars", low=100)])


@query("dq_04_in_set", """SELECT 'lang in set' AS "check", count(*) AS total, count(*) FILTER (lang NOT IN ('en', 'de')) AS failed,
    count(*) FILTER (lang NOT IN ('en', 'de')) = 0 AS success FROM documents""")
def in_set(spark: SparkSession, d: str) -> DataFrame:
    return ops.run_suite(table(spark, d, "documents"), [ops.in_set("lang", ["en", "de"])])


@query("dq_06_row_count", """SELECT 'row count' AS "check", count(*) AS total, CASE WHEN count(*) >= 100 THEN 0 ELSE 1 END AS failed,
    count(*) >= 100 AS success FROM orders""")
def row_count(spark: SparkSession, d: str) -> DataFrame:
    return ops.run_suite(table(spark, d, "orders"), [], row_count=(100, None))


@query("dq_07_matches", f"""SELECT 'text matches' AS "check", count(*) AS total,
    count(*) FILTER (NOT regexp_matches(text, '{EMAIL}')) AS failed,
    count(*) FILTER (NOT regexp_matches(text, '{EMAIL}')) = 0 AS success FROM documents""")
def matches(spark: SparkSession, d: str) -> DataFrame:
    return ops.run_suite(table(spark, d, "documents"), [ops.matches("text", EMAIL)])


@query("dq_08_suite", SUITE_SQL)
def whole_suite(spark: SparkSession, d: str) -> DataFrame:
    return _suite_results(spark, d)


@query("dq_09_score", f"""SELECT count(*) FILTER (success) AS passed, count(*) AS checks,
    count(*) FILTER (success) / count(*) * 100 AS score FROM ({SUITE_SQL})""")
def score(spark: SparkSession, d: str) -> DataFrame:
    return ops.quality_score(_suite_results(spark, d))


@query("dq_10_quarantine", """SELECT event_id, list_filter([CASE WHEN value < 1 OR value > 200 THEN 'value between' END,
        CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'event_type in set' END], lambda x: x IS NOT NULL)::VARCHAR[] AS failed_checks
    FROM events WHERE value < 1 OR value > 200 OR event_type NOT IN ('click', 'view', 'purchase', 'signup')""")
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    checks = [ops.between("value", 1, 200), ops.in_set("event_type", ["click", "view", "purchase", "signup"])]
    _, failing = ops.quarantined(table(spark, d, "events"), checks)
    return failing.select("event_id", "failed_checks")


@query("dq_11_freshness", """SELECT max(ts) AS latest, (epoch(TIMESTAMP '2024-01-31 06:00:00') - epoch(date_trunc('second', max(ts)))) / 3600 AS lag_hours,
    (epoch(TIMESTAMP '2024-01-31 06:00:00') - epoch(date_trunc('second', max(ts)))) / 3600 <= 24 AS fresh FROM events""")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return ops.freshness(table(spark, d, "events"), "ts", "2024-01-31 06:00:00", 24)


@query("dq_12_gate_level", """WITH s AS (SELECT event_type, count(*) FILTER (value >= 0.5) / count(*) * 100 AS completeness,
        count(*) FILTER (value <= 250) / count(*) * 100 AS accuracy,
        (epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', max(ts)))) / 3600 AS lag_hours FROM events GROUP BY 1)
    SELECT event_type, CASE WHEN completeness > 99.9 AND accuracy > 99.5 AND lag_hours < 1 THEN 'production'
        WHEN completeness > 99 AND accuracy > 99 AND lag_hours < 4 THEN 'staging'
        WHEN completeness > 95 AND accuracy > 95 AND lag_hours < 24 THEN 'development' ELSE 'failed' END AS level FROM s""")
def gate_level(spark: SparkSession, d: str) -> DataFrame:
    lag = (F.unix_timestamp(F.lit("2024-01-31").cast("timestamp_ntz")) - F.unix_timestamp(F.max("ts"))) / 3600
    n = F.count(F.lit(1))
    scores = table(spark, d, "events").groupBy("event_type").agg(
        (F.count_if(F.col("value") >= 0.5) / n * 100).alias("completeness"),
        (F.count_if(F.col("value") <= 250) / n * 100).alias("accuracy"), lag.alias("lag_hours"),
    )
    return scores.select("event_type", ops.gate_level(F.col("completeness"), F.col("accuracy"), F.col("lag_hours")).alias("level"))


@query("dq_13_load_gate", f"""SELECT count(*) AS total_records, count(*) FILTER (amount IS NULL) AS null_amounts,
    count(*) FILTER (amount < 0) AS negative_amounts, count(*) - count(DISTINCT event_id) AS duplicate_ids, 'pass' AS verdict
    FROM ({PURCHASES_SQL})""")
def load_gate(spark: SparkSession, d: str) -> DataFrame:
    return ops.load_gate(purchases(spark, d), "amount", "event_id")


@query("dq_14_null_counts", """WITH s AS (SELECT doc_id, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
    SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS nulls FROM s UNION ALL SELECT 'source', count(*) - count(source) FROM s
    UNION ALL SELECT 'n_chars', count(*) - count(n_chars) FROM s UNION ALL SELECT 'quality', count(*) - count(quality) FROM s
    UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM s""")
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return ops.null_counts(sparse_documents(spark, d))


@query("dq_15_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return ops.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq_16_schema_and_count", """SELECT "column", expected, found, count(*) >= 100 AS enough_rows FROM orders,
    (VALUES ('o_custkey', 'string', 'bigint'), ('o_region', 'string', ''), ('o_orderstatus', '', 'string'),
            ('o_orderdate', '', 'timestamp_ntz'), ('o_orderpriority', '', 'string')) v("column", expected, found) GROUP BY 1, 2, 3""")
def schema_and_count(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    expected = StructType(
        [StructField("o_orderkey", LongType()), StructField("o_custkey", StringType()), StructField("o_totalprice", DoubleType()), StructField("o_region", StringType())]
    )
    found = orders.agg((F.count(F.lit(1)) >= 100).alias("enough_rows"))
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("column", "expected", "found"), r)]) for r in ops.schema_differences(orders, expected)]
    return found.select(F.explode(F.array(*rows)).alias("r"), "enough_rows").select("r.*", "enough_rows")


@query("dq_17_gated_load", f"""SELECT event_id, user_id, CASE currency WHEN 'USD' THEN amount WHEN 'EUR' THEN amount * 1.1::DOUBLE
    ELSE amount * 0.9::DOUBLE END AS amount_usd FROM ({PURCHASES_SQL})""")
def gated_load(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.filters import in_dollars

    def transform(raw: DataFrame) -> DataFrame:
        return raw.select("event_id", "user_id", in_dollars(F.col("amount"), F.col("currency")).alias("amount_usd"))

    return ops.gated_load(
        purchases(spark, d), [ops.not_null("event_id"), ops.between("amount", low=0)], transform,
        [ops.not_null("amount_usd"), ops.between("amount_usd", low=0)], scratch_path(spark, "gated"),
    )


@query("dq_18_missing_days", """WITH s AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
    SELECT d::DATE AS day FROM (SELECT unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM s)
    WHERE d::DATE NOT IN (SELECT day FROM s)""")
def missing_days(spark: SparkSession, d: str) -> DataFrame:
    return ops.missing_days(table(spark, d, "orders"), "o_orderdate")


@query("dq_19_composite_gate", """SELECT count(*) AS rows, count(*) FILTER (event_id IS NULL) AS null_ids,
    (epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', max(ts)))) / 3600 AS lag_hours, 'pass' AS verdict FROM events""")
def composite_gate(spark: SparkSession, d: str) -> DataFrame:
    return ops.composite_gate(table(spark, d, "events"), "event_id", "ts", "2024-01-31", 24)
