"""Feature table, models, forecasts and user functions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.functions.columns import BOROUGHS
from tidemark.operators import aggregates as agg
from tidemark.operators import boosting, features
from tidemark.operators import learning as ops
from tidemark.plans.inputs import TRIP_ORDER, WITH_TRIPS, table, trips
from tidemark.plans.registry import query
from tidemark.plans.rows import BOROUGH_SQL, HOLIDAY_SQL, KEYS
from tidemark.plans.windowing import DAILY_SQL
from tidemark.session import materialize, scratch_path
from tidemark.sources.sinks import export_forecast

TEMPORAL_SQL = f"""pickup_ts::DATE AS pickup_date, hour(pickup_ts) AS hour_of_day, dayofweek(pickup_ts) + 1 AS day_of_week,
    dayofmonth(pickup_ts) AS day_of_month, month(pickup_ts) AS month, quarter(pickup_ts) AS quarter,
    year(pickup_ts) AS year, weekofyear(pickup_ts) AS week_of_year,
    CASE WHEN dayofweek(pickup_ts) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN hour(pickup_ts) BETWEEN 7 AND 9 OR hour(pickup_ts) BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS is_rush_hour,
    CASE WHEN pickup_ts::DATE IN ({HOLIDAY_SQL}) THEN 1 ELSE 0 END AS is_holiday,
    CASE WHEN hour(pickup_ts) < 6 THEN 'night' WHEN hour(pickup_ts) < 12 THEN 'morning'
         WHEN hour(pickup_ts) < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day"""
PLACE_SQL = f"""{BOROUGH_SQL} AS borough, (epoch(dropoff_ts) - epoch(pickup_ts)) / 60 AS trip_duration,
    CASE WHEN epoch(dropoff_ts) > epoch(pickup_ts)
         THEN distance / ((epoch(dropoff_ts) - epoch(pickup_ts)) / 60 / 60) ELSE 0 END AS avg_speed,
    CASE WHEN pu_zone IN (1, 132, 138) THEN 1 ELSE 0 END AS is_airport"""
TEMPORAL = [
    "pickup_date", "hour_of_day", "day_of_week", "day_of_month", "month", "quarter", "year", "week_of_year",
    "is_weekend", "is_rush_hour", "is_holiday", "time_of_day",
]
HISTORY_SQL = """SELECT *, avg(daily_revenue) OVER b AS revenue_ma_7d, avg(daily_trips) OVER b AS trips_ma_7d,
        lag(daily_revenue, 7) OVER o AS revenue_same_day_lw, lag(daily_trips, 7) OVER o AS trips_same_day_lw,
        sum(daily_revenue) OVER f AS total_amount_7d, (sum(daily_trips) OVER f)::BIGINT AS trip_count_7d
    FROM daily
    WINDOW o AS (PARTITION BY pu_zone ORDER BY pickup_date),
           b AS (PARTITION BY pu_zone ORDER BY pickup_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
           f AS (PARTITION BY pu_zone ORDER BY pickup_date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)"""
ROUNDED = ["daily_revenue", "revenue_ma_7d", "trips_ma_7d", "revenue_same_day_lw", "total_amount_7d"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6 if c.endswith("_ma_7d") else 4) for c in ROUNDED if c in df.columns})


def _rounded_sql(columns: list[str]) -> str:
    return ", ".join(f"round({c}, {6 if c.endswith('_ma_7d') else 4}) AS {c}" if c in ROUNDED else c for c in columns)


@query("ml_01_temporal", f"{WITH_TRIPS} SELECT {KEYS}, {TEMPORAL_SQL} FROM trips")
def temporal(spark: SparkSession, d: str) -> DataFrame:
    return features.temporal(trips(spark, d)).select(*TRIP_ORDER, *TEMPORAL)


@query("ml_02_geospatial", f"{WITH_TRIPS} SELECT {KEYS}, {PLACE_SQL} FROM trips")
def geospatial(spark: SparkSession, d: str) -> DataFrame:
    return features.geospatial(trips(spark, d)).select(*TRIP_ORDER, "borough", "trip_duration", "avg_speed", "is_airport")


HISTORY = ["daily_revenue", "daily_trips", "revenue_ma_7d", "trips_ma_7d", "revenue_same_day_lw", "trips_same_day_lw"]
TARGETS = ["total_amount_7d", "trip_count_7d"]


@query(
    "ml_03_history",
    f"""{WITH_TRIPS}, daily AS ({DAILY_SQL}), h AS ({HISTORY_SQL})
    SELECT {KEYS}, {_rounded_sql(HISTORY)} FROM trips t LEFT JOIN h ON t.pickup_ts::DATE = h.pickup_date AND t.pu_zone = h.pu_zone""",
)
def history(spark: SparkSession, d: str) -> DataFrame:
    rides = trips(spark, d)
    daily = features.with_history(features.daily_zone(rides)).drop("borough", "avg_distance", "avg_duration")
    detail = rides.select(*TRIP_ORDER, F.to_date("pickup_ts").alias("pickup_date"), "pu_zone")
    return _rounded(detail.join(daily, ["pickup_date", "pu_zone"], "left").select(*TRIP_ORDER, *HISTORY))


@query(
    "ml_04_targets",
    f"""{WITH_TRIPS}, daily AS ({DAILY_SQL}), h AS ({HISTORY_SQL})
    SELECT {KEYS}, {_rounded_sql(TARGETS)} FROM trips t LEFT JOIN h ON t.pickup_ts::DATE = h.pickup_date AND t.pu_zone = h.pu_zone""",
)
def targets(spark: SparkSession, d: str) -> DataFrame:
    rides = trips(spark, d)
    daily = features.with_targets(features.daily_zone(rides)).select("pickup_date", "pu_zone", *TARGETS)
    detail = rides.select(*TRIP_ORDER, F.to_date("pickup_ts").alias("pickup_date"), "pu_zone")
    return _rounded(detail.join(daily, ["pickup_date", "pu_zone"], "left").select(*TRIP_ORDER, *TARGETS))


FEATURE_COLUMNS_SQL = _rounded_sql([c if c not in ("pickup_date", "pu_zone", "borough") else f"k.{c}" for c in features.FEATURE_COLUMNS])


@query(
    "ml_05_feature_table",
    f"""{WITH_TRIPS}, daily AS ({DAILY_SQL}), h AS ({HISTORY_SQL}),
    k AS (SELECT *, {TEMPORAL_SQL}, {PLACE_SQL} FROM trips
          QUALIFY row_number() OVER (PARTITION BY pickup_ts::DATE, pu_zone, hour(pickup_ts)
                                     ORDER BY pickup_ts, {KEYS}) = 1)
    SELECT {FEATURE_COLUMNS_SQL} FROM k LEFT JOIN h ON k.pickup_date = h.pickup_date AND k.pu_zone = h.pu_zone""",
)
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(features.feature_table(trips(spark, d), TRIP_ORDER))


def accounts(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer with order and event totals."""
    customer = table(spark, d, "customer")
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("created_date"), agg.n_rows("total_payments"),
        F.count_if(F.col("o_orderstatus") == "F").alias("failed_payments"),
        F.round(F.sum("o_totalprice"), 2).alias("spend"),
    )
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        agg.n_rows("total_sessions"), F.round(F.sum("value"), 2).alias("total_duration"),
        F.count_if(F.col("event_type") == "error").alias("support_ticket_count"),
    )
    joined = customer.join(orders, "c_custkey").join(events, "c_custkey", "left")
    return joined.na.fill(0, ["total_sessions", "total_duration", "support_ticket_count"])


CHURN = ["account_age_days", "avg_daily_sessions", "avg_daily_duration", "support_tickets_per_day", "failed_payment_rate"]


@query(
    "ml_06_churn_features",
    """WITH a AS (SELECT c_custkey, created_date, coalesce(s, 0) AS s, coalesce(v, 0) AS v, coalesce(e, 0) AS e, p, f
        FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS created_date, count(*) AS p,
                                   count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1) ON c_custkey = o_custkey
        LEFT JOIN (SELECT user_id, count(*) AS s, round(sum(value), 2) AS v, count(*) FILTER (event_type = 'error') AS e
                   FROM events GROUP BY 1) ON c_custkey = user_id),
    b AS (SELECT *, date_diff('day', created_date::DATE, DATE '2002-01-01') AS account_age_days FROM a)
    SELECT c_custkey, account_age_days, CASE WHEN account_age_days > 0 THEN s / account_age_days ELSE 0 END AS avg_daily_sessions,
        CASE WHEN account_age_days > 0 THEN v / account_age_days ELSE 0 END AS avg_daily_duration,
        CASE WHEN account_age_days > 0 THEN e / account_age_days ELSE 0 END AS support_tickets_per_day,
        CASE WHEN p > 0 THEN f / p ELSE 0 END AS failed_payment_rate FROM b""",
)
def churn_features(spark: SparkSession, d: str) -> DataFrame:
    return ops.churn_features(accounts(spark, d), "2002-01-01").select("c_custkey", *CHURN)


@query(
    "ml_07_index_assemble",
    """WITH s AS (SELECT c_mktsegment, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS i FROM customer GROUP BY 1)
    SELECT c_custkey, i::DOUBLE AS c_mktsegment_idx, c_acctbal + i AS feature_sum FROM customer JOIN s USING (c_mktsegment)""",
)
def index_assemble(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    model = ops.indexed_and_assembled(["c_mktsegment"], ["c_acctbal"]).fit(customer)
    parts = vector_to_array("features")
    return model.transform(customer).select("c_custkey", "c_mktsegment_idx", (parts[0] + parts[1]).alias("feature_sum"))


DAILY_B_SQL = f"""SELECT pickup_ts::DATE AS pickup_date, {BOROUGH_SQL} AS borough, count(*) AS trip_count,
    round(sum(total), 4) AS revenue, round(avg(distance), 6) AS avg_distance, month(any_value(pickup_ts)) AS month,
    dayofweek(any_value(pickup_ts)) + 1 AS day_of_week,
    sum(CASE WHEN hour(pickup_ts) BETWEEN 7 AND 9 OR hour(pickup_ts) BETWEEN 17 AND 19 THEN 1 ELSE 0 END)::BIGINT AS rush_trips,
    sum(CASE WHEN pu_zone IN (1, 132, 138) THEN 1 ELSE 0 END)::BIGINT AS airport_trips,
    max(CASE WHEN dayofweek(pickup_ts) IN (0, 6) THEN 1 ELSE 0 END) AS is_weekend FROM trips GROUP BY 1, 2"""
MODEL_FEATURES = ["avg_distance", "month", "day_of_week", "rush_trips", "airport_trips", "is_weekend"]


def daily_borough(spark: SparkSession, d: str) -> DataFrame:
    day = features.daily_borough(trips(spark, d))
    return day.withColumns(
        {"revenue": F.round("revenue", 4), "avg_distance": F.round("avg_distance", 6),
         "month": F.month("pickup_date"), "day_of_week": F.dayofweek("pickup_date")}
    )


@query(
    "ml_08_correlation_ranking",
    f"""{WITH_TRIPS}, b AS ({DAILY_B_SQL}), c AS ("""
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(abs(corr({f}, revenue)), 6) AS abs_corr FROM b" for f in [*MODEL_FEATURES, "trip_count"])
    + ") SELECT * FROM c ORDER BY abs_corr DESC, feature LIMIT 5",
)
def correlation_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = ops.correlation_ranking(daily_borough(spark, d), [*MODEL_FEATURES, "trip_count"], "revenue", 5)
    return ranked.withColumn("abs_corr", F.round("abs_corr", 6))


SPLIT_SQL = """SELECT *, row_number() OVER (PARTITION BY borough ORDER BY pickup_date)
                         <= floor(count(*) OVER (PARTITION BY borough) * 0.8) AS is_train FROM b"""


@query(
    "ml_09_standard_scaling",
    f"""{WITH_TRIPS}, b AS ({DAILY_B_SQL}), s AS ({SPLIT_SQL}),
    m AS (SELECT avg(rush_trips) AS m1, stddev_pop(rush_trips) AS s1, avg(avg_distance) AS m2, stddev_pop(avg_distance) AS s2
          FROM s WHERE is_train)
    SELECT pickup_date, borough, round((rush_trips - m1) / s1, 6) AS rush_trips, round((avg_distance - m2) / s2, 6) AS avg_distance
    FROM s, m""",
)
def standard_scaling(spark: SparkSession, d: str) -> DataFrame:
    split = ops.time_split(daily_borough(spark, d), "borough", "pickup_date")
    out = ops.standard_scaled(split, ["rush_trips", "avg_distance"], F.col("is_train"))
    return out.select("pickup_date", "borough", F.round("rush_trips", 6).alias("rush_trips"), F.round("avg_distance", 6).alias("avg_distance"))


@query("ml_10_time_split", f"{WITH_TRIPS}, b AS ({DAILY_B_SQL}) SELECT pickup_date, borough, is_train FROM ({SPLIT_SQL})")
def time_split(spark: SparkSession, d: str) -> DataFrame:
    return ops.time_split(daily_borough(spark, d), "borough", "pickup_date").select("pickup_date", "borough", "is_train")


NAMES = [name for _, _, name in BOROUGHS]
FORECAST_FROM = "2001-08-01"  # the last day that is known to the forecast


def _boosted(spark: SparkSession, d: str) -> DataFrame:
    """Both targets of all boroughs at the documented 200 rounds of depth 6, with the seven days to forecast."""
    daily = materialize(ops.time_split(daily_borough(spark, d), "borough", "pickup_date"), "daily")
    known = daily.withColumn("part", F.when(F.col("is_train"), "train").otherwise("test"))
    future = ops.forecast_inputs(daily, "borough", "pickup_date", MODEL_FEATURES, FORECAST_FROM).withColumn("part", F.lit("future"))
    rows = known.unionByName(future, allowMissingColumns=True)
    targets = {"revenue": "revenue", "trips": "trip_count"}
    return materialize(boosting.boosted_daily(rows, "borough", "pickup_date", "part", MODEL_FEATURES, targets), "boosted")


def _boosted_metrics(predicted: DataFrame) -> DataFrame:
    return ops.regression_metrics(predicted.filter("part = 'test'"), ["borough", "target"])


@query("ml_11_boosted_per_borough")
def boosted_per_borough(spark: SparkSession, d: str) -> DataFrame:
    return _boosted_metrics(_boosted(spark, d))


@query(
    "ml_11_boosted_checks",
    f"""{WITH_TRIPS}, b AS ({DAILY_B_SQL}), s AS ({SPLIT_SQL}),
    c AS (SELECT borough, count(*) FILTER (is_train) AS train_rows, count(*) FILTER (NOT is_train) AS test_rows FROM s
          WHERE borough <> 'Unknown' GROUP BY 1 HAVING count(*) >= {ops.MIN_GROUP_ROWS})
    SELECT borough, target, train_rows, test_rows, TRUE AS finite, TRUE AS learned FROM c, (VALUES ('revenue'), ('trips')) t(target)""",
)
def boosted_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is certain about the fits: which models there are, their rows, and that they explain more than half of the training rows' variance."""
    train, error = F.col("part") == "train", F.col("actual") - F.col("prediction")
    unexplained = F.var_pop(F.when(train, error)) / F.var_pop(F.when(train, F.col("actual")))
    return _boosted(spark, d).filter("part <> 'future'").groupBy("borough", "target").agg(
        F.count_if(train).alias("train_rows"), F.count_if(~train).alias("test_rows"),
        F.bool_and(F.abs("prediction") < float("inf")).alias("finite"), (unexplained < 0.5).alias("learned"),
    )


@query("ml_12_model_comparison")
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The models of every borough, with 100 trees of depth 5 where they are forests."""
    daily = materialize(ops.time_split(daily_borough(spark, d), "borough", "pickup_date"), "daily")
    out = None
    for name in NAMES:  # a fixed, short list
        own = daily.filter(F.col("borough") == name)
        train, test = own.filter("is_train"), own.filter("NOT is_train")
        n = train.count()
        if n >= ops.MIN_GROUP_ROWS:
            part = ops.compare_models(train, test, MODEL_FEATURES, "revenue", ops.regressors(n, trees=100, depth=5)).withColumn("borough", F.lit(name))
            out = part if out is None else out.unionAll(part)
    return out


@query(
    "ml_13_expanding_folds",
    f"""{WITH_TRIPS}, b AS ({DAILY_B_SQL}),
    p AS (SELECT pickup_date, borough, row_number() OVER (PARTITION BY borough ORDER BY pickup_date) - 1 AS pos,
                 count(*) OVER (PARTITION BY borough) AS n FROM b),
    s AS (SELECT *, n - (6 - fold) * (n // 6) AS start FROM p, range(1, 6) r(fold))
    SELECT pickup_date, borough, fold::INT AS fold, CASE WHEN pos < start THEN 'train' ELSE 'test' END AS part
    FROM s WHERE pos < start + n // 6""",
)
def expanding_folds(spark: SparkSession, d: str) -> DataFrame:
    return ops.expanding_folds(daily_borough(spark, d), "borough", "pickup_date").select("pickup_date", "borough", "fold", "part")


@query("ml_13_cross_validated_rmse")
def cross_validated_rmse(spark: SparkSession, d: str) -> DataFrame:
    folded, out = materialize(ops.expanding_folds(daily_borough(spark, d), "borough", "pickup_date"), "folds"), None
    for name in NAMES:  # a fixed, short list
        own = folded.filter(F.col("borough") == name)
        if own.filter("fold = 1 AND part = 'train'").count() >= 2:
            part = ops.cross_validated_rmse(own, MODEL_FEATURES, "revenue", LinearRegression(regParam=0.01)).withColumn("borough", F.lit(name))
            out = part if out is None else out.unionAll(part)
    return out


METRICS_SQL = f"""daily AS ({DAILY_SQL}), h AS ({HISTORY_SQL}),
    p AS (SELECT borough, daily_revenue AS actual, revenue_ma_7d AS prediction FROM h WHERE revenue_ma_7d IS NOT NULL),
    m AS (SELECT borough, avg(abs(actual - prediction) / abs(actual)) AS mape, sqrt(avg((actual - prediction) ** 2)) AS rmse,
                 1 - sum((actual - prediction) ** 2) / (var_pop(actual) * count(*)) AS r2, count(*) AS n FROM p GROUP BY 1)"""


def _moving_average_metrics(spark: SparkSession, d: str) -> DataFrame:
    daily = features.with_history(features.daily_zone(trips(spark, d)))
    predicted = daily.filter(F.col("revenue_ma_7d").isNotNull()).select(
        "borough", F.col("daily_revenue").alias("actual"), F.col("revenue_ma_7d").alias("prediction")
    )
    return ops.regression_metrics(predicted, ["borough"])


@query("ml_14_regression_metrics", f"{WITH_TRIPS}, {METRICS_SQL} SELECT borough, round(mape, 6) AS mape, round(rmse, 4) AS rmse, round(r2, 6) AS r2, n FROM m")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = _moving_average_metrics(spark, d)
    return out.withColumns({"mape": F.round("mape", 6), "rmse": F.round("rmse", 4), "r2": F.round("r2", 6)})


def _gate_sql(limit: float) -> str:
    return f"""SELECT '{limit}' AS mape_limit, count(*) FILTER (mape < {limit}) AS passed, count(*) AS models,
        CASE WHEN count(*) FILTER (mape < {limit}) < count(*) // 2 THEN 'fail' ELSE 'pass' END AS verdict FROM m"""


@query("ml_15_pass_gate", f"{WITH_TRIPS}, {METRICS_SQL} {_gate_sql(ops.JOB_MAPE_LIMIT)} UNION ALL {_gate_sql(ops.FORECAST_MAPE_LIMIT)}")
def pass_gate(spark: SparkSession, d: str) -> DataFrame:
    """The training job's gate and the forecast pipeline's, over the same models."""
    found = materialize(_moving_average_metrics(spark, d), "gate-metrics")
    gates = [ops.gate_verdict(ops.pass_gate(found, "borough", x)).select(F.lit(str(x)).alias("mape_limit"), "*") for x in (ops.JOB_MAPE_LIMIT, ops.FORECAST_MAPE_LIMIT)]
    return gates[0].unionByName(gates[1])


def _forecast(spark: SparkSession, d: str) -> DataFrame:
    predicted = _boosted(spark, d)
    return boosting.forecast_report(predicted, _boosted_metrics(predicted), "borough", "pickup_date", "1", f"{FORECAST_FROM} 00:00:00")


@query("ml_16_forecast")
def forecast(spark: SparkSession, d: str) -> DataFrame:
    """Seven days per borough from the boosted models, exported as CSV under a version and read back."""
    out = _forecast(spark, d)
    path = export_forecast(out, scratch_path(spark, "forecast"), "1")
    return spark.read.schema(out.schema).option("header", "true").csv(path)


@query(
    "ml_16_forecast_checks",
    f"""{WITH_TRIPS}, b AS ({DAILY_B_SQL}),
    g AS (SELECT borough, min(revenue) AS lo, max(revenue) AS hi FROM b WHERE borough <> 'Unknown' GROUP BY 1 HAVING count(*) >= {ops.MIN_GROUP_ROWS})
    SELECT borough, (DATE '{FORECAST_FROM}' + i::INT)::DATE AS forecast_date, 'v1' AS model_version, TRUE AS never_negative, TRUE AS has_errors FROM g, range(1, 8) r(i)""",
)
def forecast_checks(spark: SparkSession, d: str) -> DataFrame:
    """The row set and what holds for every forecast."""
    return _forecast(spark, d).select(
        "borough", "forecast_date", "model_version",
        ((F.col("predicted_revenue") >= 0) & (F.col("predicted_trips") >= 0)).alias("never_negative"),
        ((F.col("mape_revenue") >= 0) & (F.col("mape_trips") >= 0)).alias("has_errors"),
    )


WEEK_SQL = f"""f AS (SELECT borough, round(sum(revenue), 4) / count(revenue) AS r, sum(trip_count) / count(*) AS t FROM b GROUP BY 1)"""


@query(
    "snk_08_forecast_export",
    f"""{WITH_TRIPS}, b AS ({DAILY_B_SQL}), {WEEK_SQL}
    SELECT borough, i::INT AS day, round(r, 2) AS predicted_revenue, floor(t)::INT AS predicted_trips, 'v7' AS folder FROM f, range(1, 8) d(i)""",
)
def forecast_export(spark: SparkSession, d: str) -> DataFrame:
    """The mean forecast, which SQL can repeat, as CSV below its version."""
    out = ops.clamp_forecast(_mean_week(spark, d), "_revenue", "_trips").select("borough", "day", "predicted_revenue", "predicted_trips")
    path = export_forecast(out, scratch_path(spark, "forecast"), "7")
    back = spark.read.schema(out.schema).option("header", "true").csv(path)
    return back.withColumn("folder", F.regexp_extract(F.input_file_name(), "/(v[0-9]+)/[^/]*$", 1))


@query(
    "ml_17_forecast_summary",
    f"""{WITH_TRIPS}, b AS ({DAILY_B_SQL}),
    {WEEK_SQL},
    p AS (SELECT borough, round(r, 2) AS pr, floor(t)::INT AS pt FROM f, range(7)),
    g AS (SELECT borough, round(sum(pr), 2) AS revenue, sum(pt)::BIGINT AS trips FROM p GROUP BY 1)
    SELECT * FROM g UNION ALL SELECT 'TOTAL', round(sum(pr), 2), sum(pt)::BIGINT FROM p""",
)
def forecast_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary over a mean forecast, which SQL can repeat."""
    return ops.forecast_summary(ops.clamp_forecast(_mean_week(spark, d), "_revenue", "_trips"), "borough")


def _mean_week(spark: SparkSession, d: str) -> DataFrame:
    means = daily_borough(spark, d).groupBy("borough").agg(
        agg.steady_mean("revenue", "_revenue"), (F.sum("trip_count") / F.count(F.lit(1))).alias("_trips")
    )
    return means.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(7))))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", r"\s+")).cast("double").alias("words"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("digits"), "lang",
    )


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _measured(table(spark, d, "documents")).join(table(spark, d, "labels"), "doc_id").withColumn("label", F.col("quality").cast("double"))


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    return materialize(rows, "labelled"), ops.indexed_and_assembled(["lang"], ["n_chars", "words", "digits"])


@query("ml_18_tuned_classifier")
def tuned_classifier(spark: SparkSession, d: str) -> DataFrame:
    rows, prepare = _prepared(spark, d)
    ready = materialize(ops.spread_rows(prepare.fit(rows).transform(rows), "doc_id"), "prepared")
    return ops.tuning_table(spark, ops.tuned_classifier("rf").fit(ready))


@query(
    "ml_19_classifier_report",
    """WITH s AS (SELECT quality, least(n_chars / 20000, 1) AS score FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk, score FROM s)
    SELECT round((sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2)
                 / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS roc_auc,
           round(avg(CASE WHEN (score >= 0.1)::INT = quality THEN 1 ELSE 0 END), 6) AS accuracy,
           round(avg(quality), 6) AS base_rate, count(*) AS n FROM r""",
)
def classifier_report(spark: SparkSession, d: str) -> DataFrame:
    scored = _labelled(spark, d).withColumn("score", F.least(F.col("n_chars") / 20000, F.lit(1.0)))
    report = ops.classifier_report(spark, scored, "label", "score", threshold=0.1)
    return report.select(*[F.round(c, 6).alias(c) for c in ("roc_auc", "accuracy", "base_rate")], "n")


def _line_model(spark: SparkSession, d: str):
    lines = table(spark, d, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    return LinearRegression(solver="normal").fit(ops._assembled(lines, ["l_quantity"]))


LINE_SQL = """SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
    sqrt(var_pop(l_extendedprice) * (1 - regr_r2(l_extendedprice, l_quantity))) AS rmse,
    regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem"""


@query("ml_20_linear_regression", f"SELECT round(slope, 4) AS slope, round(intercept, 3) AS intercept, round(rmse, 3) AS rmse, round(r2, 6) AS r2 FROM ({LINE_SQL})")
def linear_regression(spark: SparkSession, d: str) -> DataFrame:
    model = _line_model(spark, d)
    row = [(float(model.coefficients[0]), float(model.intercept), model.summary.rootMeanSquaredError, model.summary.r2)]
    out = spark.createDataFrame(row, "slope double, intercept double, rmse double, r2 double")
    digits = {"slope": 4, "intercept": 3, "rmse": 3, "r2": 6}
    return out.select(*[F.round(c, n).alias(c) for c, n in digits.items()])


@query("ml_21_batch_scoring")
def batch_scoring(spark: SparkSession, d: str) -> DataFrame:
    """All documents, labelled or not."""
    rows = _measured(table(spark, d, "documents"))
    return ops.scored(save_classifier(spark, d), rows).select("doc_id", "probability_1", "prediction")


@query("ml_21_scoring_checks", "SELECT doc_id, true AS probability_fits, true AS prediction_fits FROM documents")
def scoring_checks(spark: SparkSession, d: str) -> DataFrame:
    """One score for every document, a probability, and a prediction that goes by it."""
    p = F.col("probability_1")
    fits = F.when(F.abs(p - 0.5) < 1e-9, True).otherwise((p > 0.5) == (F.col("prediction") == 1))
    return batch_scoring(spark, d).select("doc_id", p.between(0, 1).alias("probability_fits"), fits.alias("prediction_fits"))


def save_classifier(spark: SparkSession, d: str) -> str:
    """Fit a forest of 100 trees on the labelled documents, save the pipeline and return its path."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier

    rows, prepare = _prepared(spark, d)
    model = Pipeline(stages=[*prepare.getStages(), RandomForestClassifier(labelCol="label", numTrees=100, maxDepth=5, seed=42)]).fit(rows)
    path = scratch_path(spark, "classifier")
    model.save(path)
    return path


@query(
    "ml_22_run_tracking",
    f"SELECT 'line' AS run, 'l_quantity' AS feature, round(rmse, 3) AS rmse FROM ({LINE_SQL})",
)
def run_tracking(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    spread = table(spark, d, "lineitem").agg(F.stddev_pop("l_extendedprice")).first()[0]
    ops.log_run(spark, path, "mean", {"feature": "none"}, {"rmse": spread})
    ops.log_run(spark, path, "line", {"feature": "l_quantity"}, {"rmse": _line_model(spark, d).summary.rootMeanSquaredError})
    best = ops.best_run(spark.read.parquet(path), "rmse")
    return best.select("run", F.element_at("params", "feature").alias("feature"), F.round(F.element_at("metrics", "rmse"), 3).alias("rmse"))


@query("ml_23_tuned_forest_regressor")
def tuned_forest_regressor(spark: SparkSession, d: str) -> DataFrame:
    """The grid without its last size and depth (200 trees, depth 15), whose fits take a minute each even on small tables."""
    ready = ops._assembled(materialize(daily_borough(spark, d), "daily"), MODEL_FEATURES).persist()
    try:
        return ops.tuning_table(spark, ops.tuned_forest_regressor("revenue", sizes=(50, 100), depths=(5, 10)).fit(ready))
    finally:
        ready.unpersist()


TIERED_SQL = """SELECT event_id, value * 10 AS amount,
    CASE user_id % 4 WHEN 0 THEN 'BRONZE' WHEN 1 THEN 'SILVER' WHEN 2 THEN 'GOLD' ELSE 'NONE' END AS tier FROM events"""
SCORE_SQL = f"""SELECT event_id, floor(amount / 100)::INT * CASE tier WHEN 'SILVER' THEN 2 WHEN 'GOLD' THEN 3 ELSE 1 END AS score
    FROM ({TIERED_SQL})"""


def _tiered(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("user_id") % 4
    tier = F.when(code == 0, "BRONZE").when(code == 1, "SILVER").when(code == 2, "GOLD").otherwise("NONE")
    return table(spark, d, "events").select("event_id", (F.col("value") * 10).alias("amount"), tier.alias("tier"))


@query("udf_01_score_expression", SCORE_SQL)
def score_expression(spark: SparkSession, d: str) -> DataFrame:
    return _tiered(spark, d).select("event_id", scoring.score(F.col("amount"), F.col("tier")).alias("score"))


@query("udf_01_score_sql_function", SCORE_SQL)
def score_sql_function(spark: SparkSession, d: str) -> DataFrame:
    scoring.register_score(spark)
    return _tiered(spark, d).select("event_id", F.expr("calculate_score(amount, tier)").alias("score"))


@query("udf_02_score_batches", SCORE_SQL)
def score_batches(spark: SparkSession, d: str) -> DataFrame:
    return _tiered(spark, d).select("event_id", scoring.score_batches("amount", "tier").alias("score"))


@query(
    "udf_03_trimmed_mean",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT event_type, round(sum(value), 4) / count(value) AS trimmed_mean, count(value) AS kept FROM events JOIN q USING (event_type)
    WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1""",
)
def trimmed_mean_by_type(spark: SparkSession, d: str) -> DataFrame:
    return agg.trimmed_mean(table(spark, d, "events"), "event_type", "value")


@query(
    "udf_04_line_per_group",
    """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
              round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
              round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1""",
)
def line_per_group(spark: SparkSession, d: str) -> DataFrame:
    out = ops.per_group_line(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")
    return out.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 3), "r2": F.round("r2", 6)})
