"""Streaming queries over the events table, run to the end of what is there, and their batch twins.

The SQL states which windows are closed: those that end at or before the last watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.learning import scored
from tidemark.plans.inputs import table
from tidemark.plans.learning import save_classifier
from tidemark.plans.registry import query
from tidemark.plans.storage import EVENT_SCHEMA, envelopes
from tidemark.session import scratch_path
from tidemark.sources.files import parse_events
from tidemark.streaming import runs
from tidemark.streaming import transforms as fx


def _events(spark: SparkSession, d: str) -> DataFrame:
    return fx.with_event_time(table(spark, d, "events"))


def _arriving(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table as a file stream; the bracket makes the path a pattern, as a stream may not start
    from one plain file."""
    return runs.parquet_stream(spark, f"{d}/{name}.parque[t]", table(spark, d, name).schema)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return fx.with_event_time(_arriving(spark, d, "events"))


def _appended(spark: SparkSession, stream: DataFrame, partition_by=()) -> DataFrame:
    """Run the stream into Parquet files and read them back."""
    out = scratch_path(spark, "stream")
    runs.to_parquet(stream, out, scratch_path(spark, "offsets"), partition_by).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _arrived(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows as a stream, written by as many tasks as they have partitions."""
    path = scratch_path(spark, "arrivals")
    rows.write.parquet(path)
    return runs.parquet_stream(spark, path, rows.schema)


def _in_parts(spark: SparkSession, parts: list[DataFrame], start: Callable[[DataFrame], StreamingQuery]) -> StreamingQuery:
    """Run a query over the parts as one micro-batch each, in order: a part is written by all tasks, then the
    query takes what has come since its last run. ``start`` uses the same checkpoint every time."""
    path, key = scratch_path(spark, "arrivals"), "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # or each run would end with a batch of its own
    try:
        for part in parts:
            part.write.mode("append").parquet(path)
            query = start(runs.parquet_stream(spark, path, part.schema))
            query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return query


TUMBLING_SQL = """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end,
    event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL"""
CLOSED = "WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL {late}"


@query("str_01_tumbling", f"SELECT window_start, window_end, event_type, n, true AS users_fit FROM ({TUMBLING_SQL}) {CLOSED.format(late='10 MINUTE')}")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The user count is approximate here, so only its range is compared; the batch twin has it exact."""
    out = _appended(spark, fx.tumbling_counts(_stream(spark, d)))
    return out.withColumn("users_fit", F.col("users").between(1, F.col("n"))).drop("users")


@query("str_01_tumbling_batch", TUMBLING_SQL)
def tumbling_batch(spark: SparkSession, d: str) -> DataFrame:
    return fx.tumbling_counts(_events(spark, d), F.countDistinct("user_id"))


SLIDING_SQL = """SELECT w AS window_start, w + INTERVAL 1 MINUTE AS window_end, event_type, count(*) AS n, avg(value) AS avg_value
    FROM (SELECT *, unnest([time_bucket(INTERVAL 30 SECOND, ts), time_bucket(INTERVAL 30 SECOND, ts) - INTERVAL 30 SECOND]) AS w FROM events)
    GROUP BY ALL"""
ROUND_MEAN = "window_start, window_end, event_type, n, round(avg_value, 6) AS avg_value"


@query("str_02_sliding", f"SELECT {ROUND_MEAN} FROM ({SLIDING_SQL}) {CLOSED.format(late='5 MINUTE')}")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    return _appended(spark, fx.sliding_means(_stream(spark, d))).withColumn("avg_value", F.round("avg_value", 6))


@query("str_02_sliding_batch", f"SELECT {ROUND_MEAN} FROM ({SLIDING_SQL})")
def sliding_batch(spark: SparkSession, d: str) -> DataFrame:
    return fx.sliding_means(_events(spark, d)).withColumn("avg_value", F.round("avg_value", 6))


OFFSET_SQL = """SELECT time_bucket(INTERVAL 5 MINUTE, ts, INTERVAL 1 MINUTE) AS window_start,
    time_bucket(INTERVAL 5 MINUTE, ts, INTERVAL 1 MINUTE) + INTERVAL 5 MINUTE AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL"""


@query("str_03_offset", f"SELECT * FROM ({OFFSET_SQL}) {CLOSED.format(late='10 MINUTE')}")
def offset(spark: SparkSession, d: str) -> DataFrame:
    return _appended(spark, fx.offset_counts(_stream(spark, d)))


@query("str_03_offset_batch", OFFSET_SQL)
def offset_batch(spark: SparkSession, d: str) -> DataFrame:
    return fx.offset_counts(_events(spark, d))


LATE = "event_type = 'view' AND ts >= TIMESTAMP '2024-01-15 16:00:00' AND ts < TIMESTAMP '2024-01-16'"
LATE_SQL = f"""WITH e AS (SELECT *, {LATE} AS late FROM events),
    w AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM e WHERE ts < TIMESTAMP '2024-01-16' AND NOT late),
    k AS (SELECT e.* FROM e, w WHERE NOT late OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark)
    SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS window_end, event_type,
        count(*) AS n, round(sum(value), 2) AS total FROM k GROUP BY ALL"""


@query("str_04_late_rows", LATE_SQL)
def late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Views of one evening arrive two micro-batches late: those behind the watermark that the first
    one left are dropped, the others update their window."""
    events, late, ts = _events(spark, d), F.expr(LATE), F.col("ts")
    first, second = (F.lit(day).cast("timestamp") for day in ("2024-01-16", "2024-01-17"))
    parts = [(ts < first) & ~late, (ts >= first) & (ts < second), (ts >= second) | late]
    out, offsets = scratch_path(spark, "updates"), scratch_path(spark, "offsets")
    _in_parts(
        spark, [events.filter(part) for part in parts], lambda stream: runs.to_batches(fx.hourly_totals(stream), runs.batch_folders(out), offsets)
    )
    return runs.latest_rows(spark, out, ["window_start", "event_type"])


SESSION_SQL = """WITH f AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM events),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM f)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, sid"""


@query("str_05_sessions", f"SELECT * FROM ({SESSION_SQL}) {CLOSED.format(late='2 HOUR')}")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return _appended(spark, fx.user_sessions(_stream(spark, d)))


@query("str_05_sessions_batch", SESSION_SQL)
def sessions_batch(spark: SparkSession, d: str) -> DataFrame:
    return fx.user_sessions(_events(spark, d))


@query("str_06_user_totals", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total, max(value) AS top FROM events GROUP BY 1")
def user_totals(spark: SparkSession, d: str) -> DataFrame:
    """Complete mode into a table that SQL reads; the table is files, not driver memory."""
    out = scratch_path(spark, "complete")
    runs.to_batches(fx.user_totals(_stream(spark, d)), runs.batch_folders(out), scratch_path(spark, "offsets"), "complete").awaitTermination()
    runs.last_batch(spark, out).createOrReplaceTempView("tidemark_user_totals")
    return spark.sql("SELECT user_id, n, total, top FROM tidemark_user_totals")


MESSAGE_SQL = "SELECT event_id, user_id, event_type, value, date_trunc('millisecond', ts)::TIMESTAMP AS ts FROM events"


@query("str_07_parsed_messages", MESSAGE_SQL)
def parsed_messages(spark: SparkSession, d: str) -> DataFrame:
    raw = _arrived(spark, envelopes(table(spark, d, "events")))
    return _appended(spark, parse_events(raw, EVENT_SCHEMA)).drop("processing_time")


def _two_sides(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    buys = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    return clicks, buys


PAIR_SQL = """SELECT a.user_id, a.event_id AS click_id, b.event_id AS purchase_id, a.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'click') a
    {how} JOIN (SELECT * FROM events WHERE event_type = 'purchase') b
    ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 5 MINUTE AND a.ts + INTERVAL 5 MINUTE"""


@query("str_08_stream_join", f"SELECT user_id, click_id, purchase_id FROM ({PAIR_SQL.format(how='')})")
def stream_join(spark: SparkSession, d: str) -> DataFrame:
    joined = fx.joined_within(*_two_sides(_stream(spark, d)), "user_id", "click_ts", "purchase_ts")
    return _appended(spark, joined.select("user_id", "click_id", "purchase_id"))


@query(
    "str_09_stream_outer_join",
    f"""WITH w AS (SELECT least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 15 MINUTE AS mark FROM events)
    SELECT user_id, click_id, purchase_id FROM ({PAIR_SQL.format(how='LEFT')}), w WHERE purchase_id IS NOT NULL OR click_ts < mark""",
)
def stream_outer_join(spark: SparkSession, d: str) -> DataFrame:
    """A click without a purchase comes out once the watermark has passed its five minutes."""
    joined = fx.joined_within(*_two_sides(_stream(spark, d)), "user_id", "click_ts", "purchase_ts", how="leftOuter")
    return _appended(spark, joined.select("user_id", "click_id", "purchase_id"))


@query(
    "str_10_upserts",
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN value * 2 ELSE value END AS value,
        CASE WHEN event_type = 'purchase' OR ts >= TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END AS batch_id FROM events""",
)
def upserts(spark: SparkSession, d: str) -> DataFrame:
    """Two micro-batches: the first half, then the second half with every purchase corrected."""
    events = _events(spark, d).select("event_id", "event_type", "value", "ts")
    second = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    buy = F.col("event_type") == "purchase"
    fixed = events.withColumn("value", F.when(buy, F.col("value") * 2).otherwise(F.col("value")))
    log = runs.ChangeLog(spark, scratch_path(spark, "upserts"), "event_id", "ts", events.schema)
    offsets = scratch_path(spark, "offsets")
    _in_parts(
        spark, [events.filter(~second), fixed.filter(second | buy)],
        lambda stream: runs.to_batches(stream, log, offsets, "append"),
    )
    return log.read().select("event_id", "value", "batch_id")


@query("str_11_partitioned_sink", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    out = scratch_path(spark, "by_day")
    stream = _stream(spark, d).select("event_id", "event_type", F.to_date("ts").alias("day"))
    runs.to_parquet(stream, out, scratch_path(spark, "offsets"), ["day", "event_type"]).awaitTermination()
    return spark.read.parquet(out).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "str_12_messages",
    """SELECT event_type AS key, '{"event_type":"' || event_type || '","n":' || count(*) || ',"users":' || count(DISTINCT user_id) || '}' AS value FROM events GROUP BY 1, event_type""",
)
def messages(spark: SparkSession, d: str) -> DataFrame:
    totals = _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return fx.as_messages(totals, "event_type")


HALVES_SQL = "SELECT CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END AS batch, count(*) AS rows, round(sum(value), 2) AS total FROM events GROUP BY 1"


def _halves(spark: SparkSession, d: str) -> list[DataFrame]:
    events, second = _events(spark, d), F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    return [events.filter(~second), events.filter(second)]


@query("str_13_batch_totals", HALVES_SQL)
def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    out, offsets = scratch_path(spark, "totals"), scratch_path(spark, "offsets")
    _in_parts(spark, _halves(spark, d), lambda stream: runs.to_batches(stream, runs.batch_totals(out, "value"), offsets, "append"))
    return spark.read.option("basePath", out).parquet(out)


@query("str_14_without_repeats", "SELECT event_id, user_id, event_type FROM events")
def without_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Every event arrives twice."""
    events = _events(spark, d)
    stream = _arrived(spark, events.unionAll(events))
    return _appended(spark, fx.without_repeats(stream).select("event_id", "user_id", "event_type"))


@query("str_15_recovery", "SELECT event_id, value FROM events")
def recovery(spark: SparkSession, d: str) -> DataFrame:
    """A second run from the same checkpoint takes the files that came since, no more and no less."""
    arrivals, out, offsets = (scratch_path(spark, p) for p in ("arrivals", "recovered", "offsets"))
    for half in _halves(spark, d):
        half.write.mode("append").parquet(arrivals)
        stream = runs.parquet_stream(spark, arrivals, half.schema).select("event_id", "value")
        runs.to_parquet(stream, out, offsets).awaitTermination()
    return spark.read.parquet(out)


@query("str_16_progress", HALVES_SQL.replace("AS batch, count(*) AS rows, round(sum(value), 2) AS total", "AS batch_id, count(*) AS input_rows"))
def progress(spark: SparkSession, d: str) -> DataFrame:
    out, offsets = scratch_path(spark, "seen"), scratch_path(spark, "offsets")
    with runs.progress_log(spark) as log:
        q = _in_parts(spark, _halves(spark, d), lambda stream: runs.to_parquet(stream, out, offsets))
        return log.table(spark, q).filter("input_rows > 0").select("batch_id", "input_rows")


HOURLY_SQL = """SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS window_end, event_type,
    count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"""


@query("str_17_rocksdb_state", f"SELECT * FROM ({HOURLY_SQL}) {CLOSED.format(late='2 HOUR')}")
def rocksdb_state(spark: SparkSession, d: str) -> DataFrame:
    with runs.state_store(spark):
        return _appended(spark, fx.hourly_totals(_stream(spark, d)))


MESSAGES_SQL = f"""SELECT event_type AS key, '{{"window_start":"' || strftime(window_start, '%Y-%m-%dT%H:%M:%S.000') || '","window_end":"' ||
    strftime(window_end, '%Y-%m-%dT%H:%M:%S.000') || '","event_type":"' || event_type || '","n":' || n || '}}' AS value FROM ({HOURLY_SQL})
    {CLOSED.format(late='2 HOUR')}"""


@query("str_12_windowed_messages", MESSAGES_SQL)
def windowed_messages(spark: SparkSession, d: str) -> DataFrame:
    """Closed windows of a stream as messages: the event type as key, window and count as JSON."""
    closed = fx.hourly_totals(_stream(spark, d)).select("window_start", "window_end", "event_type", "n")
    return _appended(spark, fx.as_messages(closed, "event_type"))


@query("str_18_hourly_increment", f"SELECT * FROM ({HOURLY_SQL}) {CLOSED.format(late='1 HOUR')}")
def hourly_increment(spark: SparkSession, d: str) -> DataFrame:
    return _appended(spark, fx.hourly_totals(_stream(spark, d), late="1 hour"))


@query("str_18_hourly_batch", HOURLY_SQL)
def hourly_batch(spark: SparkSession, d: str) -> DataFrame:
    return fx.hourly_totals(_events(spark, d), late="1 hour")


@query("str_19_scored_stream")
def scored_stream(spark: SparkSession, d: str) -> DataFrame:
    """Documents scored by a saved classifier as they arrive."""
    return _scored_as_they_arrive(spark, d, save_classifier(spark, d))


@query("str_19_stream_equals_batch", "SELECT doc_id, TRUE AS same_score, TRUE AS same_class FROM documents")
def stream_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """The stream's scores against the batch scores of the same saved model."""
    model = save_classifier(spark, d)
    arrived = _scored_as_they_arrive(spark, d, model)
    batch = scored(model, _measures(table(spark, d, "documents"))).select("doc_id", F.col("probability_1").alias("p"), F.col("prediction").alias("c"))
    return arrived.join(batch, "doc_id", "full").select(
        "doc_id", F.col("probability_1").eqNullSafe(F.col("p")).alias("same_score"), F.col("prediction").eqNullSafe(F.col("c")).alias("same_class")
    )


def _measures(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", r"\s+")).cast("double").alias("words"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("digits"), "lang",
    )


def _scored_as_they_arrive(spark: SparkSession, d: str, model: str) -> DataFrame:
    arriving = _measures(_arriving(spark, d, "documents"))
    return _appended(spark, scored(model, arriving).select("doc_id", "probability_1", "prediction"))
