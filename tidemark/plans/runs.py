"""Run-metric analytics over application and run tables that Spark derives from lineitem and events.

An *application* is an order and its tasks are the order's lines; a *test* is an event type and one
day of it is a *run*; a *query latency* is an event's value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics as ops
from tidemark.plans.inputs import table
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources.files import read_event_log
from tidemark.sources.sinks import write_line_folders

WIDE_SQL = """SELECT l_orderkey AS app_id, count(*) AS n, round(sum(l_quantity), 2) AS q, min(l_quantity) AS lo, max(l_quantity) AS hi,
    round(sum(l_extendedprice), 2) AS rev, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net,
    round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS spill, max(l_discount) AS disc, max(l_extendedprice) AS top
    FROM lineitem GROUP BY 1"""
METRICS_SQL = f"""SELECT app_id, rev / 20000 AS gc_time, lo AS task_duration_p50, hi * 4 AS task_duration_p99, q / n / 2 AS task_duration_avg,
    rev * 20000 AS shuffle_read, net * 10000 AS shuffle_write, spill * 8000 AS memory_spill, disc * 10 AS cpu_utilization,
    top * 100000 AS executor_memory, n::DOUBLE AS executor_count, CASE WHEN n = 1 THEN -1 ELSE q END AS duration_seconds
    FROM ({WIDE_SQL})"""
DERIVED_SQL = f"""SELECT *, CASE WHEN task_duration_p50 > 0 THEN task_duration_p99 / task_duration_p50 END AS task_skew_ratio,
    CASE WHEN shuffle_write > 0 THEN shuffle_read / shuffle_write END AS shuffle_ratio,
    CASE WHEN task_duration_avg * executor_count > 0 THEN gc_time / (task_duration_avg * executor_count) END AS gc_ratio,
    cpu_utilization / executor_count AS cpu_efficiency FROM ({METRICS_SQL})"""


def apps(spark: SparkSession, d: str) -> DataFrame:
    """(app_id, metrics, config): one row per order."""
    wide = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("app_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.min("l_quantity").alias("lo"),
        F.max("l_quantity").alias("hi"), F.round(F.sum("l_extendedprice"), 2).alias("rev"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("net"),
        F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))), 2).alias("spill"),
        F.max("l_discount").alias("disc"), F.max("l_extendedprice").alias("top"),
    )
    values = {
        "gc_time": F.col("rev") / 20000, "task_duration_p50": F.col("lo"), "task_duration_p99": F.col("hi") * 4,
        "task_duration_avg": F.col("q") / F.col("n") / 2, "shuffle_read": F.col("rev") * 20000,
        "shuffle_write": F.col("net") * 10000, "memory_spill": F.col("spill") * 8000, "cpu_utilization": F.col("disc") * 10,
        "executor_memory": F.col("top") * 100000, "executor_count": F.col("n").cast("double"),
        "duration_seconds": F.when(F.col("n") == 1, -1.0).otherwise(F.col("q")),
    }
    entries = [x for name, value in values.items() for x in (F.lit(name), value)]
    app = F.col("app_id")
    config = {
        "spark.executor.memory": F.concat((app % 8 + 1).cast("string"), F.lit("Gi")),
        "spark.executor.cores": (app % 6 + 1).cast("string"),
        "spark.executor.instances": (app % 10 + 1).cast("string"),
        "spark.sql.shuffle.partitions": F.when(app % 3 != 0, "200").otherwise(""),
    }
    settings = [x for name, value in config.items() for x in (F.lit(name), value)]
    return wide.select(
        "app_id", F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()).alias("metrics"), F.create_map(*settings).alias("config")
    )


@query(
    "met_01_derived",
    f"SELECT app_id, task_skew_ratio, shuffle_ratio, gc_ratio, cpu_efficiency FROM ({DERIVED_SQL})",
)
def derived(spark: SparkSession, d: str) -> DataFrame:
    names = ["task_skew_ratio", "shuffle_ratio", "gc_ratio", "cpu_efficiency"]
    return ops.with_derived(apps(spark, d)).select("app_id", *[ops.metric(n).alias(n) for n in names])


# How each sampled metric is aggregated.
SAMPLE_RULES = {"gc_time": "sum", "task_duration": "avg", "peak_memory": "max", "free_memory": "min", "start_size": "value"}


@query(
    "met_02_sampled",
    """WITH s AS (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_tax * 100 END AS gc FROM lineitem)
    SELECT l_orderkey AS app_id, m.metric, round(CASE m.metric WHEN 'gc_time' THEN coalesce(sum(gc), 0)
        WHEN 'task_duration' THEN round(sum(l_quantity), 2) / count(l_quantity) WHEN 'peak_memory' THEN max(l_extendedprice)
        WHEN 'free_memory' THEN min(l_extendedprice)
        ELSE arg_min(l_extendedprice, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) END, 6) AS value
    FROM s, (VALUES ('gc_time'), ('task_duration'), ('peak_memory'), ('free_memory'), ('start_size')) m(metric) GROUP BY 1, 2""",
)
def sampled(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    samples = {
        "gc_time": F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 100), "task_duration": F.col("l_quantity"),
        "peak_memory": F.col("l_extendedprice"), "free_memory": F.col("l_extendedprice"), "start_size": F.col("l_extendedprice"),
    }
    long = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("app_id"), at.alias("at"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in samples.items()])).alias("s"),
    ).select("app_id", "at", "s.*")
    out = ops.sampled_metrics(long, SAMPLE_RULES)
    return out.withColumn("value", F.round("value", 6))


def _values(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        return f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


RULE_VALUES = _values([(i, r, m, c, float(w), float(x), a) for i, (r, m, c, w, x, a) in enumerate(ops.RULES)])
METRIC_NAMES = ["gc_ratio", "memory_spill", "task_skew_ratio", "cpu_utilization", "shuffle_write", "task_duration_p99"]
ISSUES_SQL = f"""SELECT app_id, rule_order, issue_type,
    CASE WHEN (c = 'gt' AND v >= critical) OR (c = 'lt' AND v <= critical) THEN 'critical' ELSE 'warning' END AS severity, v AS metric_value,
    CASE WHEN (c = 'gt' AND v >= critical) OR (c = 'lt' AND v <= critical) THEN critical ELSE warning END AS threshold, recommendation
    FROM (UNPIVOT (SELECT app_id, {', '.join(METRIC_NAMES)} FROM ({DERIVED_SQL})) ON {', '.join(METRIC_NAMES)} INTO NAME metric VALUE v) u
    JOIN (VALUES {RULE_VALUES}) r(rule_order, issue_type, metric, c, warning, critical, recommendation) ON u.metric = r.metric
    WHERE (c = 'gt' AND v >= warning) OR (c = 'lt' AND v <= warning)"""


@query("met_03_issues", f"SELECT app_id, issue_type, severity, metric_value, threshold, recommendation FROM ({ISSUES_SQL})")
def issues(spark: SparkSession, d: str) -> DataFrame:
    found = ops.issues(ops.with_derived(apps(spark, d)))
    return found.select("app_id", "issue_type", "severity", "metric_value", "threshold", "recommendation")


@query(
    "met_04_workload",
    f"""WITH s AS (SELECT app_id, (shuffle_write > 1e8)::INT + (task_duration_avg > 1.0)::INT AS etl,
        (shuffle_write < 1e7)::INT + (task_duration_avg < 0.5)::INT AS inter,
        (executor_memory > 8e9)::INT + (task_duration_avg > 10.0)::INT AS ml, (duration_seconds = -1)::INT AS stream FROM ({DERIVED_SQL}))
    SELECT app_id, CASE WHEN greatest(etl, inter, ml, stream) = 0 THEN 'etl_batch' WHEN etl = greatest(etl, inter, ml, stream) THEN 'etl_batch'
        WHEN inter = greatest(etl, inter, ml, stream) THEN 'interactive' WHEN ml = greatest(etl, inter, ml, stream) THEN 'ml_training'
        ELSE 'streaming' END AS workload_type FROM s""",
)
def workload(spark: SparkSession, d: str) -> DataFrame:
    return ops.workload(ops.with_derived(apps(spark, d))).select("app_id", "workload_type")


@query("met_05_confidence", f"SELECT app_id, count(memory_spill) / 6 + 5 / 6 AS confidence FROM ({DERIVED_SQL}) GROUP BY 1")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    return ops.with_derived(apps(spark, d)).select("app_id", ops.confidence().alias("confidence"))


ACTION_VALUES = _values([(r, c, i, *a) for r, c, steps in ops.ACTIONS for i, a in enumerate(steps)])
BOUND_VALUES = _values(ops.BOUNDS)


def _bytes_sql(x: str) -> str:
    number = f"nullif(regexp_extract({x}, '^([0-9.]+)(Ki|Mi|Gi|Ti)?$', 1), '')::DOUBLE"
    unit = f"regexp_extract({x}, '^([0-9.]+)(Ki|Mi|Gi|Ti)?$', 2)"
    return f"coalesce(floor({number} * CASE {unit} WHEN 'Ki' THEN 1024 WHEN 'Mi' THEN 1048576 WHEN 'Gi' THEN 1073741824 WHEN 'Ti' THEN 1099511627776 ELSE 1 END), 0)"


def _text_sql(x: str) -> str:
    shown = f"CASE WHEN ({x}) / 1073741824 >= 1 THEN round_even(({x}) / 1073741824, 0) ELSE round_even(({x}) / 1073741824, 1) END"
    return f"(CASE WHEN {shown} = floor({shown}) THEN ({shown})::BIGINT::VARCHAR ELSE ({shown})::VARCHAR END || 'Gi')"


RECOMMEND_SQL = f"""WITH j AS (
    SELECT i.*, a.parameter, a.operation, a.argument, a.step, b.format, b.low, b.high, b.increase,
        CASE a.parameter WHEN 'spark.executor.memory' THEN (app_id % 8 + 1) || 'Gi' WHEN 'spark.executor.cores' THEN (app_id % 6 + 1)::VARCHAR
            WHEN 'spark.executor.instances' THEN (app_id % 10 + 1)::VARCHAR
            WHEN 'spark.sql.shuffle.partitions' THEN CASE WHEN app_id % 3 <> 0 THEN '200' ELSE '' END ELSE '' END AS current,
        factor * CASE WHEN severity = 'critical' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence
    FROM ({ISSUES_SQL}) i JOIN (VALUES {ACTION_VALUES}) a(issue_type, factor, step, parameter, operation, argument) ON i.issue_type = a.issue_type
    LEFT JOIN (VALUES {BOUND_VALUES}) b(parameter, format, low, high, increase) ON a.parameter = b.parameter
    QUALIFY row_number() OVER (PARTITION BY app_id, a.parameter ORDER BY confidence DESC, rule_order, step) = 1),
p AS (SELECT *, CASE WHEN operation = 'set' THEN argument
        WHEN operation = 'multiply' AND format = 'memory'
            THEN {_text_sql(f"floor(CASE WHEN current = '' THEN {_bytes_sql('low')} ELSE {_bytes_sql('current')} END * TRY_CAST(argument AS DOUBLE))")}
        WHEN operation = 'multiply' THEN (coalesce(TRY_CAST(current AS DOUBLE), 1) * TRY_CAST(argument AS DOUBLE))::VARCHAR
        ELSE greatest(coalesce(TRY_CAST(current AS DOUBLE), TRY_CAST(low AS DOUBLE)) - TRY_CAST(argument AS DOUBLE), TRY_CAST(low AS DOUBLE))::BIGINT::VARCHAR END AS proposed FROM j),
z AS (SELECT *, {_bytes_sql('proposed')} AS size, {_bytes_sql('current')} AS now, {_bytes_sql('low')} AS lo, {_bytes_sql('high')} AS hi,
        TRY_CAST(proposed AS DOUBLE) AS num, coalesce(TRY_CAST(current AS DOUBLE), 0) AS base, 1 + increase / 100 AS grow FROM p),
y AS (SELECT *, least(greatest(CASE WHEN now > 0 AND size > now * grow THEN floor(now * grow) ELSE size END, lo), greatest(hi, lo)) AS fsize,
        CASE WHEN base > 0 AND num > base * grow THEN base * grow ELSE num END AS gnum FROM z),
x AS (SELECT *, least(greatest(gnum, TRY_CAST(low AS DOUBLE)), TRY_CAST(high AS DOUBLE)) AS fnum FROM y)
SELECT app_id, parameter, CASE WHEN current = '' THEN 'not set' ELSE current END AS current_value,
    CASE WHEN format = 'memory' THEN CASE WHEN fsize <> size THEN {_text_sql('fsize')} ELSE proposed END
         WHEN format = 'integer' THEN trunc(fnum)::BIGINT::VARCHAR WHEN format = 'float' THEN fnum::VARCHAR ELSE proposed END AS recommended_value,
    CASE WHEN current = '' THEN 100.0 WHEN now > 0 AND size > 0 THEN (size - now) / now * 100 ELSE 0 END::DOUBLE AS change_pct,
    confidence, CASE WHEN format = 'memory' AND fsize <> size THEN 'capped' WHEN format IN ('integer', 'float') AND fnum <> num THEN 'capped'
                ELSE 'pass' END AS safety_check, issue_type AS source FROM x"""


@query("met_06_recommendations", RECOMMEND_SQL)
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    return ops.recommendations(ops.issues(ops.with_derived(apps(spark, d))))


@query("met_07_capped", f"SELECT parameter, safety_check, count(*) AS n FROM ({RECOMMEND_SQL}) GROUP BY 1, 2")
def capped(spark: SparkSession, d: str) -> DataFrame:
    found = ops.recommendations(ops.issues(ops.with_derived(apps(spark, d))))
    return found.groupBy("parameter", "safety_check").agg(F.count(F.lit(1)).alias("n"))


RUNS_SQL = """SELECT event_type AS test, ts::DATE AS run_day, round(sum(value), 2) / count(*) AS duration_sec, count(*)::DOUBLE AS throughput,
    count(DISTINCT user_id)::DOUBLE AS cpu_usage_pct, max(value) AS memory_usage_pct FROM events GROUP BY 1, 2"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One row per test and run."""
    n = F.count(F.lit(1))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("test"), F.to_date("ts").alias("run_day")).agg(
        (F.round(F.sum("value"), 2) / n).alias("duration_sec"), n.cast("double").alias("throughput"),
        F.countDistinct("user_id").cast("double").alias("cpu_usage_pct"), F.max("value").alias("memory_usage_pct"),
    )


@query(
    "met_08_baseline_stats",
    f"""SELECT test, round(avg(duration_sec), 6) AS mean, min(duration_sec) AS min, max(duration_sec) AS max,
        round(stddev_pop(duration_sec), 6) AS stddev, list_sort(list(duration_sec))[count(*) // 2 + 1] AS median
    FROM ({RUNS_SQL}) WHERE duration_sec > 0 GROUP BY 1""",
)
def baseline_stats(spark: SparkSession, d: str) -> DataFrame:
    out = ops.baseline_stats(runs(spark, d), "test", "duration_sec")
    return out.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query(
    "met_09_against_baseline",
    f"""WITH r AS ({RUNS_SQL}), b AS (SELECT test, avg(duration_sec) AS bd, avg(throughput) AS bt FROM r WHERE run_day < DATE '2024-01-30' GROUP BY 1),
    p AS (SELECT test, (duration_sec - bd) / bd * 100 AS dp, (throughput - bt) / bt * 100 AS tp FROM r JOIN b USING (test) WHERE run_day = DATE '2024-01-30')
    SELECT test, round(dp, 4) AS duration_diff_pct, dp > 20 AS duration_regression, round(tp, 4) AS throughput_diff_pct, tp < -20 AS throughput_regression FROM p""",
)
def against_baseline(spark: SparkSession, d: str) -> DataFrame:
    all_runs = runs(spark, d)
    last = F.lit("2024-01-30").cast("date")
    base = all_runs.filter(F.col("run_day") < last).groupBy("test").agg(
        F.avg("duration_sec").alias("base_duration_sec"), F.avg("throughput").alias("base_throughput")
    )
    out = ops.against_baseline(all_runs.filter(F.col("run_day") == last), base, "test")
    return out.withColumns({c: F.round(c, 4) for c in ("duration_diff_pct", "throughput_diff_pct")})


MEASURES = ["duration_sec", "throughput", "cpu_usage_pct", "memory_usage_pct"]
PAIRS_SQL = f"""SELECT test, metric, run, max(v) FILTER (half = 0) AS baseline, max(v) FILTER (half = 1) AS current FROM (
    SELECT test, metric, v, (dayofmonth(run_day) - 1) % 15 AS run, (dayofmonth(run_day) - 1) // 15 AS half
    FROM (UNPIVOT ({RUNS_SQL}) ON {', '.join(MEASURES)} INTO NAME metric VALUE v)) WHERE half < 2 GROUP BY 1, 2, 3"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(test, metric, run, baseline, current): the first 15 days against the next 15."""
    day = F.dayofmonth("run_day") - 1
    long = runs(spark, d).select(
        "test", (day % 15).alias("run"), F.floor(day / 15).alias("half"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in MEASURES])).alias("e"),
    ).filter("half < 2").select("test", "run", "half", "e.*")
    return long.groupBy("test", "metric", "run").agg(
        F.max(F.when(F.col("half") == 0, F.col("v"))).alias("baseline"), F.max(F.when(F.col("half") == 1, F.col("v"))).alias("current")
    )


def t_p_sql(t: str, df: str) -> str:
    """P(|T| >= |t|) by the finite trigonometric series for whole degrees of freedom."""
    theta = f"atan(abs({t}) / sqrt({df}))"
    even = f"""sin({theta}) * list_sum(list_transform(range(0, greatest(({df})::BIGINT // 2, 1)),
        lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) - ln(pi()) / 2) * pow(cos({theta}), 2 * j)))"""
    odd = f"""2 / pi() * ({theta} + CASE WHEN ({df}) = 1 THEN 0 ELSE sin({theta}) * cos({theta}) * list_sum(list_transform(
        range(0, greatest((({df})::BIGINT - 1) // 2, 1)),
        lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(cos({theta}), 2 * j))) END)"""
    return f"(1 - CASE WHEN ({df})::BIGINT % 2 = 0 THEN {even} ELSE {odd} END)"


PAIRED_SQL = f"""SELECT test, metric, count(baseline) AS na, count(current) AS nb, avg(baseline) AS ma, avg(current) AS mb,
    avg(baseline - current) / (stddev_samp(baseline - current) / sqrt(count(baseline))) AS t FROM ({PAIRS_SQL}) GROUP BY 1, 2"""
TESTED_SQL = f"""SELECT *, (mb - ma) / ma * 100 AS pct, CASE WHEN na = nb AND na >= 2 THEN {t_p_sql('t', 'na - 1')} END AS p FROM ({PAIRED_SQL})"""
REGRESSED = "(pct > {limit} AND (p IS NULL OR p < 0.05))"


@query(
    "met_10_regressions",
    f"""SELECT test, metric, round(ma, 4) AS baseline_mean, round(mb, 4) AS current_mean, round(pct, 4) AS change_pct, round(p, 6) AS p_value,
        coalesce(p < 0.05, false) AS significant, {REGRESSED.format(limit=20)} AS regression FROM ({TESTED_SQL})""",
)
def regressions(spark: SparkSession, d: str) -> DataFrame:
    out = ops.regressions(pairs(spark, d), ["test", "metric"], "baseline", "current")
    return out.withColumns({c: F.round(c, 4) for c in ("baseline_mean", "current_mean", "change_pct")} | {"p_value": F.round("p_value", 6)})


@query(
    "met_11_trade_offs",
    f"""WITH r AS (SELECT *, pct > 0 AND (p IS NULL OR p < 1) AS worse FROM ({TESTED_SQL}))
    SELECT a.test, a.metric AS "primary", round(a.pct, 4) AS primary_pct, b.metric AS resource, round(b.pct, 4) AS resource_pct
    FROM r a JOIN r b USING (test) WHERE a.worse AND a.metric IN ('duration_sec', 'throughput')
      AND b.metric IN ('cpu_usage_pct', 'memory_usage_pct') AND b.pct < -1""",
)
def trade_offs(spark: SparkSession, d: str) -> DataFrame:
    """With looser limits than the defaults, as the derived runs differ little between the halves."""
    results = ops.regressions(pairs(spark, d), ["test", "metric"], "baseline", "current", limit=0.0, alpha=1.0)
    out = ops.trade_offs(results, "test", ["duration_sec", "throughput"], ["cpu_usage_pct", "memory_usage_pct"], drop_pct=1.0)
    return out.withColumns({c: F.round(c, 4) for c in ("primary_pct", "resource_pct")})


@query(
    "met_12_mean_interval",
    f"""WITH s AS (SELECT test, count(*) AS n, avg(duration_sec) AS m, stddev_samp(duration_sec) AS sd FROM ({RUNS_SQL}) GROUP BY 1),
    c AS (SELECT *, 2.0452296421327034::DOUBLE * sd / sqrt(n) AS w FROM s)
    SELECT test, n, round(m, 4) AS mean, round(m - w, 4) AS lower, round(m + w, 4) AS upper FROM c""",
)
def mean_interval(spark: SparkSession, d: str) -> DataFrame:
    """The SQL states the t value of 29 degrees of freedom: every test has a run on each of the 30 days."""
    out = ops.mean_interval(runs(spark, d), ["test"], "duration_sec")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "lower", "upper")})


@query("met_13_paired_t", f"SELECT test, metric, na AS n, round(t, 6) AS t, round(p, 6) AS p_value FROM ({TESTED_SQL})")
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    out = ops.paired_t(pairs(spark, d), ["test", "metric"], "baseline", "current")
    return out.select("test", "metric", "n", F.round("t", 6).alias("t"), F.round("p_value", 6).alias("p_value"))


LATENCY_SQL = "SELECT event_id, event_type, value FROM events"


def _latencies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", "value")


@query(
    "met_14_iqr_outliers",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM events GROUP BY 1)
    SELECT event_id, event_type, value FROM events JOIN q USING (event_type)
    WHERE n >= 4 AND q1 <> q3 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))""",
)
def iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    return ops.iqr_outliers(_latencies(spark, d), ["event_type"], "value")


@query(
    "met_15_index_iqr_outliers",
    """WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1),
    q AS (SELECT event_type, n, v[n // 4 + 1] AS q1, v[3 * n // 4 + 1] AS q3 FROM s)
    SELECT event_id, event_type, value FROM events JOIN q USING (event_type)
    WHERE n >= 4 AND q1 <> q3 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))""",
)
def index_iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    return ops.index_iqr_outliers(_latencies(spark, d), ["event_type"], "value")


@query(
    "met_16_zscore_outliers",
    """WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd, count(*) AS n FROM events GROUP BY 1)
    SELECT event_id, event_type, value, round((value - m) / sd, 6) AS z FROM events JOIN s USING (event_type)
    WHERE n >= 3 AND sd > 0 AND abs((value - m) / sd) > 3""",
)
def zscore_outliers(spark: SparkSession, d: str) -> DataFrame:
    return ops.zscore_outliers(_latencies(spark, d), ["event_type"], "value").withColumn("z", F.round("z", 6))


TREND_SQL = f"""WITH m AS (SELECT test, row_number() OVER w - 5 AS x, avg(duration_sec) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS y
        FROM ({RUNS_SQL}) WINDOW w AS (PARTITION BY test ORDER BY run_day)),
    f AS (SELECT test, regr_slope(y, x) AS slope, corr(x, y) AS r, count(*) AS points FROM m WHERE x >= 0 GROUP BY 1),
    g AS (SELECT *, r * sqrt((points - 2) / (1 - r * r)) AS t FROM f), h AS (SELECT *, {t_p_sql('t', 'points - 2')} AS p FROM g)"""


@query(
    "met_17_trends",
    f"""{TREND_SQL} SELECT test, CASE WHEN p > 0.05 THEN 'no_significant_trend' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend,
        round(slope, 6) AS slope, round(r * r, 6) AS r_squared, round(p, 6) AS p_value, points FROM h""",
)
def trends(spark: SparkSession, d: str) -> DataFrame:
    out = ops.trends(runs(spark, d), ["test"], "run_day", "duration_sec")
    return out.withColumns({c: F.round(c, 6) for c in ("slope", "r_squared", "p_value")})


PERCENTILE_COLUMNS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query(
    "met_18_percentiles",
    "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for n, q in PERCENTILE_COLUMNS.items()) + " FROM events GROUP BY 1",
)
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = ops.percentiles(_latencies(spark, d), ["event_type"], "value")
    return out.withColumns({n: F.round(n, 6) for n in PERCENTILE_COLUMNS})


SUMMARY_SQL = """SELECT {key} AS grp, count(*) AS queries_total, count(*) FILTER (value > 150) AS queries_failed, avg(value) AS latency_avg_ms,
    count(*) / (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))) AS throughput_qps,
    count(*) FILTER (value > 150) / count(*) AS error_rate, list_sort(list(value))[count(*) // 2 + 1] AS latency_p50_ms,
    list_sort(list(value))[floor(count(*) * 0.95::DOUBLE)::BIGINT + 1] AS latency_p95_ms,
    list_sort(list(value))[floor(count(*) * 0.99::DOUBLE)::BIGINT + 1] AS latency_p99_ms FROM events {where} GROUP BY 1"""
BY_TYPE_SQL = SUMMARY_SQL.format(key="event_type", where="")


def _summary(events: DataFrame) -> DataFrame:
    return ops.latency_summary(events.withColumn("grp", F.col("event_type")), ["grp"], "value", "ts", F.col("value") > 150)


@query(
    "met_19_latency_summary",
    f"""SELECT grp, queries_total, queries_failed, round(latency_avg_ms, 6) AS latency_avg_ms, round(throughput_qps, 9) AS throughput_qps,
        round(error_rate, 6) AS error_rate, latency_p50_ms, latency_p95_ms, latency_p99_ms FROM ({BY_TYPE_SQL})""",
)
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    out = _summary(table(spark, d, "events"))
    return out.withColumns(
        {"latency_avg_ms": F.round("latency_avg_ms", 6), "throughput_qps": F.round("throughput_qps", 9), "error_rate": F.round("error_rate", 6)}
    )


@query(
    "met_20_load_errors",
    f"""SELECT grp, list_filter([
        CASE WHEN error_rate > 0.01 THEN printf('Error rate too high: %.2f%% > 1.00%%', error_rate * 100) END,
        CASE WHEN throughput_qps < 0.5 THEN printf('Throughput too low: %.2f qps < 0.50 qps', throughput_qps) END,
        CASE WHEN latency_p95_ms > 140 THEN printf('P95 latency too high: %.1fms > 140.0ms', latency_p95_ms) END], lambda x: x IS NOT NULL) AS errors
    FROM ({BY_TYPE_SQL})""",
)
def load_errors(spark: SparkSession, d: str) -> DataFrame:
    return ops.load_errors(_summary(table(spark, d, "events")), max_p95=140.0).select("grp", "errors")


FIRST_HALF, SECOND_HALF = "ts < TIMESTAMP '2024-01-16'", "ts >= TIMESTAMP '2024-01-16'"


@query(
    "met_21_version_comparison",
    f"""WITH a AS ({SUMMARY_SQL.format(key='event_type', where='WHERE ' + FIRST_HALF)}), b AS ({SUMMARY_SQL.format(key='event_type', where='WHERE ' + SECOND_HALF)})
    SELECT grp, round((b.throughput_qps - a.throughput_qps) * 100 / a.throughput_qps, 4) AS qps_diff_pct, b.throughput_qps < a.throughput_qps * 0.8 AS qps_regression,
        round((b.latency_p95_ms - a.latency_p95_ms) * 100 / a.latency_p95_ms, 4) AS p95_diff_pct, b.latency_p95_ms > a.latency_p95_ms * 1.2 AS p95_regression
    FROM a JOIN b USING (grp)""",
)
def version_comparison(spark: SparkSession, d: str) -> DataFrame:
    events, cut = table(spark, d, "events"), F.lit("2024-01-16").cast("timestamp_ntz")
    out = ops.compare_versions(_summary(events.filter(F.col("ts") < cut)), _summary(events.filter(F.col("ts") >= cut)), ["grp"])
    return out.select(
        "grp", F.round("qps_diff_pct", 4).alias("qps_diff_pct"), "qps_regression", F.round("p95_diff_pct", 4).alias("p95_diff_pct"), "p95_regression"
    )


@query(
    "met_22_roll_up",
    """SELECT count(*) AS total, count(*) FILTER (event_type IN ('click', 'view')) AS passed,
        count(*) FILTER (event_type IN ('purchase', 'error')) AS failed, count(*) FILTER (event_type = 'signup') AS skipped,
        round(sum(value) FILTER (event_type <> 'error'), 2) AS duration,
        round(count(*) FILTER (event_type IN ('click', 'view')) / count(*) * 100, 2) AS pass_rate FROM events""",
)
def roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Events written as result files; an 'error' event is a cut-off JSON text."""
    kind = F.col("event_type")
    status = F.when(kind.isin("click", "view"), "passed").when(kind == "purchase", "failed").otherwise("skipped")
    text = F.to_json(F.struct(F.col("event_id").cast("string").alias("scenario"), status.alias("status"), F.col("value").alias("duration")))
    path = scratch_path(spark, "results")
    whole = table(spark, d, "events").withColumn("text", text)
    lines = whole.select(F.when(kind == "error", F.substring("text", 1, 15)).otherwise(F.col("text")).alias("value"))
    lines.write.text(path)
    return ops.roll_up(ops.read_results(spark, path)).withColumn("duration", F.round("duration", 2))


@query(
    "met_23_run_summary",
    f"""WITH r AS (SELECT *, CASE WHEN dayofmonth(run_day) % 7 = 0 THEN 1 ELSE 0 END AS exit_code, duration_sec > 55 AS regression FROM ({RUNS_SQL}))
    SELECT count(*) AS total_tests, count(*) FILTER (exit_code = 0) AS successful, count(*) FILTER (exit_code <> 0) AS failed,
        count(*) FILTER (regression) AS regressions, round(avg(duration_sec), 6) AS avg_duration, round(sum(duration_sec), 4) AS total_duration FROM r""",
)
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    marked = runs(spark, d).withColumns(
        {"exit_code": F.when(F.dayofmonth("run_day") % 7 == 0, 1).otherwise(0), "regression": F.col("duration_sec") > 55}
    )
    out = ops.run_summary(marked)
    return out.withColumns({"avg_duration": F.round("avg_duration", 6), "total_duration": F.round("total_duration", 4)})


@query(
    "met_24_stage_health",
    """WITH s AS (SELECT l_suppkey AS app_id, l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS f,
        sum(l_extendedprice) AS rd, sum(CASE WHEN l_tax > 0.06 THEN l_extendedprice ELSE 0 END) AS sp FROM lineitem GROUP BY 1, 2)
    SELECT app_id, sum(f)::BIGINT AS failed_tasks, count(*) FILTER (f > 1) AS failed_stages, round(sum(sp) * 100 / sum(rd), 4) AS spill_pct FROM s GROUP BY 1""",
)
def stage_health(spark: SparkSession, d: str) -> DataFrame:
    """A supplier is an application, an order its stage and a returned line a failed task; read from JSON."""
    path = scratch_path(spark, "stages")
    stages = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("app_id"), F.col("l_orderkey").alias("stage_id")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("num_failed_tasks"), F.sum("l_extendedprice").alias("shuffle_read"),
        F.sum(F.when(F.col("l_tax") > 0.06, F.col("l_extendedprice")).otherwise(0.0)).alias("spilled"),
    )
    stages.withColumn("status", F.when(F.col("num_failed_tasks") > 1, "FAILED").otherwise("COMPLETE")).write.json(path)
    log = spark.read.schema("app_id LONG, stage_id LONG, num_failed_tasks LONG, shuffle_read DOUBLE, spilled DOUBLE, status STRING").json(path)
    return ops.stage_health(log, log).withColumn("spill_pct", F.round("spill_pct", 4))


@query("met_25_throughput", f"SELECT test, run_day, round(throughput / duration_sec, 6) AS rows_per_sec FROM ({RUNS_SQL})")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    rate = F.when(F.col("duration_sec") > 0, F.col("throughput") / F.col("duration_sec"))
    return runs(spark, d).select("test", "run_day", F.round(rate, 6).alias("rows_per_sec"))


@query(
    "met_26_skew_by_median",
    """WITH r AS (SELECT l_orderkey, max(l_quantity) / quantile_cont(l_quantity, 0.5) AS ratio FROM lineitem GROUP BY 1)
    SELECT l_orderkey, round(ratio, 6) AS ratio, CASE WHEN ratio > 4 THEN 'severe' WHEN ratio > 2 THEN 'moderate' ELSE 'balanced' END AS skew FROM r""",
)
def skew_by_median(spark: SparkSession, d: str) -> DataFrame:
    return ops.skew_by_median(table(spark, d, "lineitem"), "l_orderkey", "l_quantity").withColumn("ratio", F.round("ratio", 6))


@query(
    "met_27_hot_keys",
    """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT l_partkey, n, round(n / (SELECT sum(n) FROM c), 9) AS share, round(n / (SELECT quantile_cont(n, 0.5) FROM c), 6) AS ratio_to_median
    FROM c ORDER BY n DESC, l_partkey LIMIT 20""",
)
def hot_keys(spark: SparkSession, d: str) -> DataFrame:
    out = ops.key_skew(table(spark, d, "lineitem"), "l_partkey")
    return out.withColumns({"share": F.round("share", 9), "ratio_to_median": F.round("ratio_to_median", 6)})


@query(
    "met_28_resource_wait",
    """SELECT user_id AS app_id, (epoch_us(min(ts) FILTER (event_type = 'view')) - epoch_us(min(ts) FILTER (event_type = 'signup'))) / 1e6 AS wait_seconds
    FROM events GROUP BY 1 HAVING wait_seconds IS NOT NULL""",
)
def resource_wait(spark: SparkSession, d: str) -> DataFrame:
    """A sign-up stands for the application start and a view for an executor, in a JSON event log."""
    kind = F.when(F.col("event_type") == "signup", "ApplicationStart").when(F.col("event_type") == "view", "ExecutorAdded").otherwise("Other")
    log = table(spark, d, "events").select(
        F.col("user_id").alias("app_id"), kind.alias("event"), F.col("event_id").cast("string").alias("executor_id"), F.col("ts").alias("time")
    )
    return ops.resource_wait(log)


@query(
    "met_28_event_log",
    """SELECT 'app-' || user_id AS app_id, (epoch_us(min(ts) FILTER (event_type = 'view')) // 1000 - epoch_us(min(ts) FILTER (event_type = 'signup')) // 1000) / 1e3 AS wait_seconds
    FROM events GROUP BY user_id HAVING wait_seconds IS NOT NULL""",
)
def resource_wait_of_logs(spark: SparkSession, d: str) -> DataFrame:
    """The same waits from JSON event logs: one folder per application, its first sign-up as start, the driver as an executor to skip."""
    e = table(spark, d, "events")
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    app = F.concat(F.lit("app-"), F.col("user_id"))

    def line(event: str, time: Column, **more: Column) -> Column:
        return F.to_json(F.struct(F.lit(f"SparkListener{event}").alias("Event"), time.alias("Timestamp"), *[c.alias(n.replace("_", " ")) for n, c in more.items()]))

    started = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min(millis).alias("_t"))
    starts = started.select("user_id", F.explode(F.array(
        line("ApplicationStart", F.col("_t"), App_ID=app), line("ExecutorAdded", F.col("_t") - 1, Executor_ID=F.lit("driver")), line("JobStart", F.col("_t"))
    )).alias("value"))
    added = e.filter("event_type = 'view'").select("user_id", line("ExecutorAdded", millis, Executor_ID=F.col("event_id").cast("string")).alias("value"))
    path = scratch_path(spark, "event-logs")
    write_line_folders(starts.unionAll(added).withColumn("log", app), "log", "value", path)
    return ops.resource_wait(read_event_log(spark, path))


@query(
    "met_29_shuffle_class",
    f"""SELECT CASE WHEN shuffle_ratio - 0.6 < 0.5 THEN 'excellent' WHEN shuffle_ratio - 0.6 <= 1.5 THEN 'good'
            WHEN shuffle_ratio - 0.6 <= 3 THEN 'warning' ELSE 'bad' END AS shuffle_class, count(*) AS n FROM ({DERIVED_SQL}) GROUP BY 1""",
)
def shuffle_class(spark: SparkSession, d: str) -> DataFrame:
    ratio = ops.with_derived(apps(spark, d)).select((ops.metric("shuffle_ratio") - 0.6).alias("ratio"))
    return ratio.groupBy(ops.shuffle_class(F.col("ratio")).alias("shuffle_class")).agg(F.count(F.lit(1)).alias("n"))


WEEK = "SELECT event_type AS metric, round(sum(value), 2) / count(*) AS value FROM events WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}' GROUP BY 1"


@query(
    "met_30_drift",
    f"""WITH c AS ({WEEK.format(a='2024-01-15', b='2024-01-22')}), p AS ({WEEK.format(a='2024-01-08', b='2024-01-15')})
    SELECT metric, c.value, p.value AS previous, round((c.value - p.value) / p.value * 100, 4) AS change_pct,
        (c.value - p.value) / p.value * 100 > 2 AS regressed FROM c JOIN p USING (metric)""",
)
def drift(spark: SparkSession, d: str) -> DataFrame:
    def week(first: str, last: str) -> DataFrame:
        a, b = (F.lit(x).cast("timestamp_ntz") for x in (first, last))
        held = table(spark, d, "events").filter((F.col("ts") >= a) & (F.col("ts") < b))
        return held.groupBy(F.col("event_type").alias("metric")).agg((F.round(F.sum("value"), 2) / F.count("value")).alias("value"))

    out = ops.metric_drift(week("2024-01-15", "2024-01-22"), week("2024-01-08", "2024-01-15"), limit_pct=2.0)
    return out.withColumn("change_pct", F.round("change_pct", 4))


@query(
    "met_30_health",
    """SELECT ts::DATE AS day, list_filter([CASE WHEN count(*) FILTER (event_type = 'error') > 100 THEN 'task_failures' END,
        CASE WHEN count(*) FILTER (event_type = 'signup' AND value > 180) > 5 THEN 'executors_lost' END,
        CASE WHEN max(value) / avg(value) > 5 THEN 'skew' END], lambda x: x IS NOT NULL) AS broken FROM events GROUP BY 1""",
)
def health(spark: SparkSession, d: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    broken = ops.health_checks(
        F.count_if(kind == "error"), F.count_if((kind == "signup") & (value > 180)), F.max(value) / F.avg(value)
    )
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(broken.alias("broken"))


ERFC = """(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END
    * exp((2 * k + 1) * ln(x) - lgamma(k + 1)) / (2 * k + 1))))"""


@query(
    "met_31_ab_decision",
    f"""WITH s AS (SELECT avg(value) FILTER (event_type = 'click') AS c, avg(value) FILTER (event_type = 'purchase') AS t,
        stddev_samp(value) FILTER (event_type = 'click') AS sd, count(value) FILTER (event_type = 'click') AS n FROM events),
    z AS (SELECT *, (t - c) / (sd / sqrt(n)) AS z, greatest(abs((t - c) / (sd / sqrt(n))) / sqrt(2), 1e-12) AS x FROM s), p AS (SELECT *, {ERFC} AS p FROM z)
    SELECT round(c, 6) AS control_mean, round(t, 6) AS treatment_mean, n, round(z, 6) AS z, round(p, 6) AS p_value,
        CASE WHEN p < 0.05 THEN CASE WHEN t < c THEN 'rollout' ELSE 'rollback' END ELSE 'no difference' END AS decision, 784 AS samples_needed FROM p""",
)
def ab_decision(spark: SparkSession, d: str) -> DataFrame:
    """Includes the sample size of met_32: 784 per group for a 10% effect."""
    out = ops.ab_decision(table(spark, d, "events"), "event_type", "click", "purchase", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("control_mean", "treatment_mean", "z", "p_value")})


@query("met_33_rows_per_partition")
def rows_per_partition(spark: SparkSession, d: str) -> DataFrame:
    return ops.rows_per_partition(table(spark, d, "lineitem").repartition(8, "l_orderkey"))


@query("met_33_partition_checks", "SELECT count(*)::BIGINT AS rows, true AS partitions_fit FROM lineitem")
def partition_checks(spark: SparkSession, d: str) -> DataFrame:
    """A whole number of partitions, 8 at most, holds the table's rows, and the figures are in order."""
    rows = table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("rows"))
    parts = F.col("rows") / F.col("mean")
    whole = (F.abs(parts - F.round(parts)) < 1e-6) & (parts < 8.5)
    ordered = (F.col("min") <= F.col("median")) & (F.col("median") <= F.col("max")) & (F.abs(F.col("max_over_mean") * F.col("mean") - F.col("max")) < 1e-6)
    return rows.join(F.broadcast(rows_per_partition(spark, d)), F.lit(True)).select("rows", (whole & ordered).alias("partitions_fit"))  # one row each


@query(
    "met_34_skew_by_mean",
    """WITH r AS (SELECT l_orderkey, max(l_quantity) / avg(l_quantity) AS ratio FROM lineitem GROUP BY 1)
    SELECT l_orderkey, round(ratio, 6) AS ratio, CASE WHEN ratio > 5 THEN 'severe' WHEN ratio > 3 THEN 'moderate' ELSE 'low' END AS skew FROM r""",
)
def skew_by_mean(spark: SparkSession, d: str) -> DataFrame:
    return ops.skew_by_mean(table(spark, d, "lineitem"), "l_orderkey", "l_quantity").withColumn("ratio", F.round("ratio", 6))
