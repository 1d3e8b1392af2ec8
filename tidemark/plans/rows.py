"""Projections, filters, predicates, expressions, de-duplication, sampling and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import filters as ops
from tidemark.plans.inputs import TRIP_ORDER, WITH_TRIPS, table, trips
from tidemark.plans.registry import query

KEYS = "order_id, line_no, part_id, supp_id, fare"


@query("prj_01_column_selection", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def column_selection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "prj_02_derived_columns",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              l_extendedprice * (1 - l_discount) AS net, l_extendedprice / l_quantity AS unit_price,
              l_returnflag || '-' || l_linestatus AS status
       FROM lineitem""",
)
def derived_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice * (1 - l_discount) AS net",
        "l_extendedprice / l_quantity AS unit_price",
        "l_returnflag || '-' || l_linestatus AS status",
    )


VALID_SQL = """distance > 0 AND fare > 0 AND total > 0
       AND pickup_ts >= TIMESTAMP '1996-01-01' AND pickup_ts < TIMESTAMP '1998-01-01'"""


@query("flt_01_valid_trips", f"{WITH_TRIPS} SELECT {KEYS}, pickup_ts, distance FROM trips WHERE {VALID_SQL}")
def valid_trips(spark: SparkSession, d: str) -> DataFrame:
    kept = ops.valid_trips(trips(spark, d), "1996-01-01", "1998-01-01")
    return kept.select(*TRIP_ORDER, "pickup_ts", "distance")


@query(
    "flt_02_valid_trips_capped",
    f"{WITH_TRIPS} SELECT {KEYS}, pickup_ts, distance FROM trips WHERE {VALID_SQL} AND distance < 20",
)
def valid_trips_capped(spark: SparkSession, d: str) -> DataFrame:
    kept = ops.valid_trips(trips(spark, d), "1996-01-01", "1998-01-01", max_distance=20)
    return kept.select(*TRIP_ORDER, "pickup_ts", "distance")


@query(
    "flt_03_conjunction",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
       WHERE l_quantity > 10 AND l_extendedprice * l_quantity > 100000 AND l_discount < 0.05""",
)
def conjunction(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .filter((F.col("l_quantity") > 10) & (F.col("l_extendedprice") * F.col("l_quantity") > 100000) & (F.col("l_discount") < 0.05))
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    )


@query(
    "flt_04_range_set_null",
    """SELECT event_id, user_id, event_type, value FROM events
       WHERE value BETWEEN 10 AND 60 AND event_type IN ('click', 'view') AND props IS NOT NULL""",
)
def range_set_null(spark: SparkSession, d: str) -> DataFrame:
    keep = F.col("value").between(10, 60) & F.col("event_type").isin("click", "view") & F.col("props").isNotNull()
    return table(spark, d, "events").filter(keep).select("event_id", "user_id", "event_type", "value")


@query("flt_05_even_ids", "SELECT count(*) AS even_ids FROM orders WHERE o_orderkey % 2 = 0")
def even_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(F.col("o_orderkey") % 2 == 0).agg(F.count(F.lit(1)).alias("even_ids"))


@query(
    "flt_06_count_matching",
    """SELECT count(*) AS trip_count FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_extendedprice > 0""",
)
def count_matching(spark: SparkSession, d: str) -> DataFrame:
    ship = F.col("l_shipdate")
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("1997-01-01", "1998-01-01"))
    kept = table(spark, d, "lineitem").filter((ship >= start) & (ship < end) & (F.col("l_extendedprice") > 0))
    return kept.agg(F.count(F.lit(1)).alias("trip_count"))


@query(
    "flt_07_last_30_days",
    """SELECT event_type, count(*) AS n FROM events
       WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 30 DAY AND ts < TIMESTAMP '2024-01-26' GROUP BY 1""",
)
def last_30_days(spark: SparkSession, d: str) -> DataFrame:
    recent = ops.last_days(table(spark, d, "events"), "ts", "2024-01-25", 30)
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt_07_fixed_days",
    """SELECT event_id, ts FROM events
       WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'""",
)
def fixed_days(spark: SparkSession, d: str) -> DataFrame:
    return ops.between_days(table(spark, d, "events"), "ts", "2024-01-05", "2024-01-10").select("event_id", "ts")


@query(
    "exp_01_distance_buckets",
    f"""{WITH_TRIPS}
    SELECT CASE WHEN distance < 1 THEN '< 1 mile' WHEN distance < 3 THEN '1-3 miles'
                WHEN distance < 5 THEN '3-5 miles' WHEN distance < 10 THEN '5-10 miles'
                WHEN distance < 20 THEN '10-20 miles' ELSE '20+ miles' END AS distance_bucket,
           count(*) AS trip_count, round(count(*) * 100.0 / sum(count(*)) OVER (), 3)::DOUBLE AS pct,
           round(avg(fare), 4) AS avg_fare, round(avg(tip), 4) AS avg_tip, min(distance) AS min_distance
    FROM trips WHERE distance > 0 AND fare > 0 GROUP BY 1""",
)
def distance_buckets(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.aggregates import distance_profile

    return distance_profile(trips(spark, d))


@query(
    "exp_02_day_periods",
    f"""{WITH_TRIPS}
    SELECT CASE WHEN hour(pickup_ts) BETWEEN 6 AND 9 THEN '1. morning rush'
                WHEN hour(pickup_ts) BETWEEN 10 AND 15 THEN '2. day'
                WHEN hour(pickup_ts) BETWEEN 16 AND 19 THEN '3. evening rush'
                WHEN hour(pickup_ts) BETWEEN 20 AND 23 THEN '4. evening' ELSE '5. night' END AS time_period,
           count(*) AS trip_count, round(avg(distance), 4) AS avg_distance, round(avg(fare), 4) AS avg_fare,
           round(avg(tip), 4) AS avg_tip, round(sum(total) / 1000000, 6) AS revenue_m
    FROM trips WHERE fare > 0 GROUP BY 1""",
)
def day_periods(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.aggregates import period_profile

    return period_profile(trips(spark, d))


@query(
    "exp_03_airport_trips",
    f"""{WITH_TRIPS}
    SELECT CASE WHEN airport_fee > 0 THEN 'Airport Trip' ELSE 'Regular Trip' END AS trip_type,
           count(*) AS trip_count, round(avg(distance), 4) AS avg_distance, round(avg(fare), 4) AS avg_fare,
           round(avg(total), 4) AS avg_total, round(avg(tip), 4) AS avg_tip
    FROM trips GROUP BY 1""",
)
def airport_trips(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("airport_fee") > 0, "Airport Trip").otherwise("Regular Trip")
    return trips(spark, d).groupBy(kind.alias("trip_type")).agg(
        F.count(F.lit(1)).alias("trip_count"),
        *[F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("distance", "fare", "total", "tip")],
    )


@query(
    "exp_04_payment_labels",
    f"""{WITH_TRIPS}
    SELECT CASE payment_type WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'Cash' WHEN 3 THEN 'No Charge'
                WHEN 4 THEN 'Dispute' ELSE 'Other' END AS payment_name, count(*) AS trip_count
    FROM trips GROUP BY 1""",
)
def payment_labels(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.aggregates import PAYMENT_NAMES

    name = ops.labelled(F.col("payment_type"), PAYMENT_NAMES, "Other")
    return trips(spark, d).groupBy(name.alias("payment_name")).agg(F.count(F.lit(1)).alias("trip_count"))


PURCHASES_SQL = """SELECT event_id, user_id, value AS amount, ts,
       CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency
       FROM events WHERE event_type = 'purchase'"""


def purchases(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("user_id") % 3
    return table(spark, d, "events").filter(F.col("event_type") == "purchase").select(
        "event_id", "user_id", F.col("value").alias("amount"), "ts",
        F.when(code == 0, "USD").when(code == 1, "EUR").otherwise("GBP").alias("currency"),
    )


@query(
    "exp_05_currency",
    f"""SELECT event_id, currency, CASE currency WHEN 'USD' THEN amount WHEN 'EUR' THEN amount * 1.1::DOUBLE
               ELSE amount * 0.9::DOUBLE END AS amount_usd FROM ({PURCHASES_SQL})""",
)
def currency(spark: SparkSession, d: str) -> DataFrame:
    amount = ops.in_dollars(F.col("amount"), F.col("currency")).alias("amount_usd")
    return purchases(spark, d).select("event_id", "currency", amount)


SPARSE_SQL = """SELECT doc_id, source, n_chars, quality, toxic
                FROM documents LEFT JOIN labels USING (doc_id)"""


def sparse_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id", "left")


@query(
    "exp_06_fill_and_drop",
    f"""SELECT doc_id, source, n_chars, quality, coalesce(toxic, 0) AS toxic
        FROM ({SPARSE_SQL}) WHERE quality IS NOT NULL""",
)
def fill_and_drop(spark: SparkSession, d: str) -> DataFrame:
    return ops.fill_and_drop(sparse_documents(spark, d), {"toxic": 0}, ["quality"])


@query(
    "exp_07_fill_by_type",
    f"""SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(n_chars, 0) AS n_chars,
               coalesce(quality, 0) AS quality, coalesce(grade, 'unknown') AS grade
        FROM (SELECT *, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS grade FROM ({SPARSE_SQL}))""",
)
def fill_by_type(spark: SparkSession, d: str) -> DataFrame:
    grade = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    graded = sparse_documents(spark, d).withColumn("grade", grade).drop("toxic")
    return ops.fill_by_type(graded)


@query(
    "exp_08_safe_ratio",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 0 END AS tax_per_discount FROM lineitem""",
)
def safe_ratio(spark: SparkSession, d: str) -> DataFrame:
    ratio = fx.safe_ratio(F.col("l_tax"), F.col("l_discount")).alias("tax_per_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ratio)


@query(
    "ded_01_first_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return ops.first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


PERCENTILE_SQL = "('0x' || substr(md5(o_orderkey::VARCHAR), 1, 7))::INT % 100"


@query("smp_01_hash_sample", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {PERCENTILE_SQL} < 10")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return ops.hash_sample(table(spark, d, "orders"), 10, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("smp_01_random_sample")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").sample(fraction=0.1, seed=42).select("o_orderkey", "o_totalprice")


@query(
    "smp_02_hash_split",
    f"""SELECT CASE WHEN {PERCENTILE_SQL} < 80 THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(sum(o_totalprice), 2) AS revenue
        FROM orders GROUP BY 1""",
)
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    split = ops.hash_split(table(spark, d, "orders"), 80, "o_orderkey")
    return split.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("smp_02_random_split")
def random_split(spark: SparkSession, d: str) -> DataFrame:
    train, test = table(spark, d, "orders").select("o_orderkey").randomSplit([0.8, 0.2], seed=42)
    return train.withColumn("part", F.lit("train")).unionAll(test.withColumn("part", F.lit("test")))


@query("smp_01_sample_checks", "SELECT 0::BIGINT AS not_given, true AS share_fits, count(*) AS n FROM orders")
def sample_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every sampled row is a given row, none comes twice, and their share is near the wanted one."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    marked = orders.withColumn("by", F.lit(1)).unionAll(random_sample(spark, d).withColumn("by", F.lit(-1)))
    left = marked.groupBy("o_orderkey", "o_totalprice").agg(F.sum("by").alias("by"), F.count_if(F.col("by") > 0).alias("given"))
    n, kept = F.sum("given"), F.sum(F.col("given") - F.col("by"))
    return left.agg(F.count_if(F.col("by") < 0).alias("not_given"), (F.abs(kept / n - 0.1) < 0.03).alias("share_fits"), n.alias("n"))


@query("smp_02_split_checks", "SELECT o_orderkey, 1::BIGINT AS times FROM orders")
def split_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every row lies in exactly one part."""
    return random_split(spark, d).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("times"))


@query(
    "fn_01_date_parts",
    """SELECT event_id, ts::DATE AS day, hour(ts) AS hour, dayofweek(ts) + 1 AS day_of_week,
              dayofmonth(ts) AS day_of_month, month(ts) AS month, quarter(ts) AS quarter, year(ts) AS year,
              weekofyear(ts) AS week_of_year FROM events""",
)
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, d, "events").select(
        "event_id", F.to_date(ts).alias("day"), F.hour(ts).alias("hour"), F.dayofweek(ts).alias("day_of_week"),
        F.dayofmonth(ts).alias("day_of_month"), F.month(ts).alias("month"), F.quarter(ts).alias("quarter"),
        F.year(ts).alias("year"), F.weekofyear(ts).alias("week_of_year"),
    )


HOLIDAY_SQL = ", ".join(f"DATE '{h}'" for h in fx.HOLIDAYS)


@query(
    "fn_02_calendar_flags",
    f"""SELECT event_id, CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
               CASE WHEN hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS is_rush_hour,
               CASE WHEN ts::DATE IN ({HOLIDAY_SQL}) THEN 1 ELSE 0 END AS is_holiday FROM events""",
)
def calendar_flags(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, d, "events").select(
        "event_id", fx.is_weekend(F.dayofweek(ts)).alias("is_weekend"),
        fx.is_rush_hour(F.hour(ts)).alias("is_rush_hour"), fx.is_holiday(F.to_date(ts)).alias("is_holiday"),
    )


@query(
    "fn_03_time_of_day",
    """SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning'
                             WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day,
              CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon'
                   WHEN hour(ts) BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END AS time_of_day_late FROM events""",
)
def time_of_day(spark: SparkSession, d: str) -> DataFrame:
    hour = F.hour("ts")
    return table(spark, d, "events").select(
        "event_id", fx.time_of_day(hour).alias("time_of_day"),
        fx.time_of_day_evening_to_22(hour).alias("time_of_day_late"),
    )


@query(
    "fn_04_duration_speed",
    f"""{WITH_TRIPS}
    SELECT {KEYS}, (epoch(dropoff_ts) - epoch(pickup_ts)) / 60 AS trip_minutes,
           CASE WHEN epoch(dropoff_ts) > epoch(pickup_ts)
                THEN distance / ((epoch(dropoff_ts) - epoch(pickup_ts)) / 60 / 60) ELSE 0 END AS avg_speed
    FROM trips""",
)
def duration_speed(spark: SparkSession, d: str) -> DataFrame:
    minutes = fx.minutes_between(F.col("pickup_ts"), F.col("dropoff_ts"))
    return trips(spark, d).select(
        *TRIP_ORDER, minutes.alias("trip_minutes"),
        fx.safe_ratio(F.col("distance"), minutes / 60).alias("avg_speed"),
    )


BOROUGH_SQL = (
    "CASE "
    + " ".join(f"WHEN pu_zone BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in fx.BOROUGHS)
    + " ELSE 'Unknown' END"
)


@query(
    "fn_05_borough_airport",
    f"""{WITH_TRIPS}
    SELECT {KEYS}, {BOROUGH_SQL} AS borough, CASE WHEN pu_zone IN (1, 132, 138) THEN 1 ELSE 0 END AS is_airport
    FROM trips""",
)
def borough_airport(spark: SparkSession, d: str) -> DataFrame:
    zone = F.col("pu_zone")
    return trips(spark, d).select(*TRIP_ORDER, fx.borough(zone).alias("borough"), fx.is_airport(zone).alias("is_airport"))


@query(
    "fn_06_date_arithmetic",
    """SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS age_days,
              date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, o_orderdate + INTERVAL 7 DAY AS week_later
       FROM orders""",
)
def date_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.datediff(F.lit("2002-01-01").cast("date"), day).alias("age_days"),
        F.date_trunc("month", day).cast("timestamp_ntz").alias("month_start"),
        (day + F.expr("INTERVAL 7 DAYS")).alias("week_later"),
    )


@query(
    "fn_07_arithmetic",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / 1000, 0) AS thousands,
              l_extendedprice / l_quantity AS unit_price, l_orderkey % 7 AS remainder,
              floor(l_extendedprice / 100)::BIGINT AS hundreds FROM lineitem""",
)
def arithmetic(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(price / 1000, 0).alias("thousands"),
        (price / F.col("l_quantity")).alias("unit_price"), (F.col("l_orderkey") % 7).alias("remainder"),
        F.floor(price / 100).alias("hundreds"),
    )


@query(
    "fn_08_text",
    """SELECT p_partkey, p_brand || '/' || p_type AS label, contains(p_name, 'red') AS has_red,
              p_name LIKE '%widget%' AS is_widget, p_size::VARCHAR AS size_text FROM part""",
)
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("label"),
        F.col("p_name").contains("red").alias("has_red"), F.col("p_name").like("%widget%").alias("is_widget"),
        F.col("p_size").cast("string").alias("size_text"),
    )


@query(
    "fn_09_regex_extract_replace",
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
               regexp_replace(url, '[0-9]+', '#', 'g') AS shape FROM pages""",
)
def regex_extract_replace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        F.regexp_replace("url", "[0-9]+", "#").alias("shape"),
    )


@query(
    "fn_10_regex_match",
    r"""SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS has_email
        FROM documents""",
)
def regex_match(spark: SparkSession, d: str) -> DataFrame:
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(email).alias("has_email"))


@query(
    "fn_11_json",
    """SELECT event_id, json_extract(props, '$.k')::INT AS k,
              '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS envelope FROM events""",
)
def json_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.from_json("props", "k INT")["k"].alias("k"),
        F.to_json(F.struct("event_type", "user_id")).alias("envelope"),
    )


@query(
    "fn_12_map_update",
    """SELECT event_id, json_extract(props, '$.k')::INT AS before, json_extract(props, '$.k')::INT + 1 AS after,
              2 AS entries FROM events""",
)
def map_update(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.versioned import put_key

    props = F.from_json("props", "map<string,int>")
    bumped = put_key(put_key(props, "k", F.element_at(props, "k") + 1), "page", F.lit(1))
    return (
        table(spark, d, "events")
        .select("event_id", F.element_at(props, "k").alias("before"), bumped.alias("m"))
        .select("event_id", "before", F.element_at("m", "k").alias("after"), F.size("m").alias("entries"))
    )


@query("fn_13_hashes", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query(
    "fn_14_unix_time",
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS as_text,
              date_trunc('second', ts)::TIMESTAMP AS second FROM events""",
)
def unix_time(spark: SparkSession, d: str) -> DataFrame:
    text = F.from_unixtime(F.unix_timestamp("ts"))
    return table(spark, d, "events").select(
        "event_id", text.alias("as_text"), text.cast("timestamp_ntz").alias("second")
    )
