"""Run-metric analytics: issue detection, recommendations, baselines, tests, outliers, trends.

Application metrics come as one row per application with a map metric -> value, so that every rule is
a column expression and needs no shuffle. Run tables hold one row per (test, run).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import MEMORY_UNITS, memory_bytes, number, safe_ratio
from tidemark.functions.stats import normal_p_value, t_critical, t_p_value
from tidemark.operators.joins import join_group_stats
from tidemark.operators.order_stats import index_quartile, linear_quantiles, nearest_rank, upper_median, values_at_ranks

GB = 1073741824

# Fixed values: (rule, metric, condition, warning, critical, recommendation).
RULES = [
    ("gc_pressure", "gc_ratio", "gt", 0.10, 0.20, "increase_memory"),
    ("memory_spill", "memory_spill", "gt", 1, GB, "increase_memory_or_reduce_storage_fraction"),
    ("data_skew", "task_skew_ratio", "gt", 3.0, 5.0, "enable_skew_join_or_salting"),
    ("low_cpu_utilization", "cpu_utilization", "lt", 0.60, 0.40, "reduce_cores_or_increase_parallelism"),
    ("high_cpu_utilization", "cpu_utilization", "gt", 0.95, 0.99, "add_executors_or_reduce_parallelism"),
    ("high_shuffle_bytes", "shuffle_write", "gt", GB, 10 * GB, "increase_partitions_or_broadcast_join"),
    ("long_task_duration", "task_duration_p99", "gt", 60, 300, "increase_parallelism_or_optimize_query"),
]

# Fixed values: (workload, [(metric, condition, value)]), in order of preference on ties.
WORKLOADS = [
    ("etl_batch", [("shuffle_write", "gt", 1e8), ("task_duration_avg", "gt", 1.0)]),
    ("interactive", [("shuffle_write", "lt", 1e7), ("task_duration_avg", "lt", 0.5)]),
    ("ml_training", [("executor_memory", "gt", 8e9), ("task_duration_avg", "gt", 10.0)]),
    ("streaming", [("duration_seconds", "eq", -1.0)]),
]

# The metrics that make an analysis complete.
KEY_METRICS = ["gc_ratio", "memory_spill", "task_skew_ratio", "cpu_utilization", "shuffle_write", "task_duration_avg"]

# The metrics that derived ratios are made of.
DIVIDED = ["task_duration_p99", "task_duration_p50", "shuffle_read", "shuffle_write", "gc_time", "task_duration_avg", "executor_count",
           "cpu_utilization"]

# Fixed values: (rule, confidence, [(parameter, operation, argument)]).
ACTIONS = [
    ("gc_pressure", 0.9, [("spark.executor.memory", "multiply", "1.2"), ("spark.memory.fraction", "set", "0.7")]),
    ("memory_spill", 0.95, [("spark.executor.memory", "multiply", "1.3"), ("spark.memory.storageFraction", "set", "0.3")]),
    ("data_skew", 0.85, [("spark.sql.adaptive.skewJoin.enabled", "set", "true"),
                         ("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "set", "5"),
                         ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "set", "268435456")]),
    ("low_cpu_utilization", 0.7, [("spark.executor.cores", "decrease", "1")]),
    ("high_cpu_utilization", 0.8, [("spark.executor.instances", "multiply", "1.5"), ("spark.executor.cores", "set", "4")]),
    ("high_shuffle_bytes", 0.75, [("spark.sql.shuffle.partitions", "multiply", "2.0"),
                                  ("spark.sql.autoBroadcastJoinThreshold", "set", "104857600")]),
    ("long_task_duration", 0.65, [("spark.sql.shuffle.partitions", "multiply", "1.5")]),
]

# Fixed values: (parameter, format, min, max, max increase %). No figure means 100 %.
BOUNDS = [
    ("spark.executor.memory", "memory", "1Gi", "32Gi", 100),
    ("spark.executor.memoryOverhead", "memory", "384Mi", "8Gi", 100),
    ("spark.executor.cores", "integer", "1", "8", 50),
    ("spark.executor.instances", "integer", "1", "100", 100),
    ("spark.sql.shuffle.partitions", "integer", "10", "2000", 200),
    ("spark.sql.autoBroadcastJoinThreshold", "memory", "10MB", "500MB", 500),
    ("spark.memory.fraction", "float", "0.5", "0.8", 100),
    ("spark.memory.storageFraction", "float", "0.2", "0.7", 100),
    ("spark.driver.memory", "memory", "1Gi", "16Gi", 100),
    ("spark.driver.maxResultSize", "memory", "1Gi", "4Gi", 100),
    ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "memory", "32MB", "512MB", 100),
]


def metric(name: str) -> Column:
    return F.try_element_at(F.col("metrics"), F.lit(name))


def _looked_up(apps: DataFrame, names: Iterable[str]) -> DataFrame:
    """Adds one column ``_name`` per metric, so that rules read columns and each metric is searched in the map once."""
    return apps.withColumns({f"_{name}": metric(name) for name in dict.fromkeys(names)})


# ---- application metrics ----------------------------------------------------------------------

def sampled_metrics(samples: DataFrame, rules: Mapping[str, str], app: str = "app_id") -> DataFrame:
    """Samples (app, metric, value, at) to (app, metric, value) by each metric's rule; 0 without samples.

    ``rules`` maps metric -> sum | avg | max | min | value (the first sample). Figures of all metrics are one row per application,
    so a shuffle moves one row where samples of all metrics were, and only first samples, kept with their ``at``, are sorted.
    """
    figures = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}
    named = F.col(app).isNotNull()  # samples without an application are no figures of one

    def of(name: str, column: str = "value") -> Column:
        return F.when(named & (F.col("metric") == name), F.col(column))

    plain = [figures[how](of(name)).cast("double").alias(name) for name, how in rules.items() if how != "value"]
    firsts = [name for name, how in rules.items() if how == "value"]
    wide = samples.groupBy(app).agg(F.count(F.lit(1)).alias("_n"), *plain)
    if firsts:
        held = samples.filter(named & F.col("metric").isin(firsts) & F.col("value").isNotNull())
        wide = wide.join(held.groupBy(app).agg(*[F.min_by("value", of(name, "at")).cast("double").alias(name) for name in firsts]), app, "left")
    long = F.array(*[F.struct(F.lit(name).alias("metric"), F.coalesce(F.col(f"`{name}`"), F.lit(0.0)).alias("value")) for name in rules])
    return wide.select(app, F.inline(long))


def with_derived(apps: DataFrame) -> DataFrame:
    """Adds skew, shuffle, gc and cpu ratios to the map; a ratio whose divisor is not positive is left out."""
    def value(name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(f"_{name}"), F.lit(default))

    executors = F.when(value("executor_count", 1.0) == 0, 1.0).otherwise(value("executor_count", 1.0))
    derived = {
        "task_skew_ratio": safe_ratio(value("task_duration_p99"), value("task_duration_p50"), None),
        "shuffle_ratio": safe_ratio(value("shuffle_read"), value("shuffle_write"), None),
        "gc_ratio": safe_ratio(value("gc_time"), value("task_duration_avg") * executors, None),
        "cpu_efficiency": value("cpu_utilization") / executors,
    }
    entries = [x for name, ratio in derived.items() for x in (F.lit(name), ratio)]
    kept = F.map_filter("metrics", lambda k, _: ~k.isin(list(derived)))
    ratios = F.map_filter(F.map_concat(kept, F.create_map(*entries)), lambda _, v: v.isNotNull())
    return _looked_up(apps, DIVIDED).withColumn("metrics", ratios).drop(*[f"_{name}" for name in DIVIDED])


def _severity(value: Column, condition: str, warning: float, critical: float) -> Column:
    if condition == "gt":
        return F.when(value >= critical, "critical").when(value >= warning, "warning")
    return F.when(value <= critical, "critical").when(value <= warning, "warning")


def issues(apps: DataFrame) -> DataFrame:
    """One row per (application, broken rule); bounds are inclusive and critical wins."""
    rules = []
    for order, (rule, name, condition, warning, critical, advice) in enumerate(RULES):
        severity = _severity(F.col(f"_{name}"), condition, float(warning), float(critical))
        rules.append(
            F.struct(
                F.lit(order).alias("rule_order"), F.lit(rule).alias("issue_type"), severity.alias("severity"),
                F.col(f"_{name}").alias("metric_value"),
                F.when(severity == "critical", float(critical)).otherwise(float(warning)).alias("threshold"),
                F.lit(advice).alias("recommendation"),
            )
        )
    names = [name for _, name, *_ in RULES]
    tested = _looked_up(apps, names).withColumn("_issue", F.explode(F.array(*rules))).filter("_issue.severity IS NOT NULL")
    return tested.select("*", "_issue.*").drop("_issue", *[f"_{name}" for name in names])


def workload(apps: DataFrame) -> DataFrame:
    """Adds ``workload_type``: most indicators met, the first listed on ties, etl_batch when none is."""
    compare = {"gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "eq": lambda a, b: a == b}
    scores = []
    for order, (name, indicators) in enumerate(WORKLOADS):
        met = sum((F.coalesce(compare[c](metric(m), F.lit(v)), F.lit(False)).cast("int") for m, c, v in indicators), F.lit(0))
        scores.append(F.struct(met.alias("score"), F.lit(-order).alias("preference"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return apps.withColumn("workload_type", F.when(best["score"] > 0, best["name"]).otherwise("etl_batch"))


def confidence() -> Column:
    """Share of the key metrics that are present."""
    return sum((metric(m).isNotNull().cast("int") for m in KEY_METRICS), F.lit(0)) / len(KEY_METRICS)


def _memory_text(size: str) -> Column:
    gigs = F.col(size) / GB
    shown = F.bround(gigs, 0).cast("long").cast("string")
    small = F.bround(gigs, 1)
    text = F.when(gigs >= 1, shown).when(small == F.floor(small), small.cast("long").cast("string")).otherwise(small.cast("string"))
    return F.concat(text, F.lit("Gi"))


def _fixed_bytes(text: str) -> int:
    """Bytes of a bound; MB is not among the units and gives 0."""
    for unit, size in MEMORY_UNITS.items():
        if text.endswith(unit):
            return int(float(text[: -len(unit)]) * size)
    return int(float(text)) if text.replace(".", "", 1).isdigit() else 0


def _steps() -> Column:
    """Rule -> its actions with the bounds of their parameters: a constant, folded once, so no join is needed."""
    bounds = {}
    for parameter, form, low, high, increase in BOUNDS:
        limits = [float(_fixed_bytes(x) if form == "memory" else x) for x in (low, high)]
        bounds[parameter] = (form, *limits, 1 + increase / 100)
    names = ["factor", "step", "parameter", "operation", "argument", "format", "low", "high", "grow"]
    table = {
        rule: [dict(zip(names, (factor, i, *action, *bounds.get(action[0], (None,) * 4)))) for i, action in enumerate(actions)]
        for rule, factor, actions in ACTIONS
    }
    fields = "factor double, step int, parameter string, operation string, argument string, format string, low double, high double, grow double"
    return F.from_json(F.lit(json.dumps(table)), f"map<string, array<struct<{fields.replace(' ', ': ').replace(',:', ',')}>>>")


def recommendations(found: DataFrame, app: str = "app_id") -> DataFrame:
    """Issues (with a ``config`` map of current settings) to bounded recommendations.

    Per parameter the higher confidence wins and the earlier rule on ties. Bounds apply in the order
    allowed increase, minimum, maximum. The setting is looked up before the shuffle, so that maps do not pass it.
    Memory bounds given in MB parse to 0 bytes, as the unit table knows Ki, Mi, Gi and Ti only.
    """
    steps = found.select(app, "issue_type", "severity", "rule_order", "config", F.explode(F.try_element_at(_steps(), F.col("issue_type"))).alias("_do"))
    joined = steps.select(
        app, "issue_type", "rule_order", "_do.*", F.coalesce(F.try_element_at("config", F.col("_do.parameter")), F.lit("")).alias("current"),
        (F.col("_do.factor") * F.when(F.col("severity") == "critical", 1.0).otherwise(0.8)).alias("confidence"),
    )
    best = Window.partitionBy(app, "parameter").orderBy(F.desc("confidence"), "rule_order", "step")
    kept = joined.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1")

    memory, unset = F.col("format") == "memory", F.col("current") == ""
    parsed = kept.withColumns(
        {"now": memory_bytes(F.col("current")), "base": number(F.col("current")), "arg": number(F.col("argument"))}
    )
    new_size = F.floor(F.when(unset, F.col("low")).otherwise(F.col("now")) * F.col("arg"))
    new_number = F.when(F.col("operation") == "multiply", F.coalesce("base", F.lit(1.0)) * F.col("arg")).otherwise(
        F.greatest(F.coalesce("base", "low") - F.col("arg"), F.col("low")).cast("long")
    )
    moved = parsed.withColumns({"_size": new_size, "_number": new_number.cast("double")})
    proposed = (
        F.when(F.col("operation") == "set", F.col("argument"))
        .when(memory, _memory_text("_size"))
        .when(F.col("operation") == "multiply", F.col("_number").cast("string"))
        .otherwise(F.col("_number").cast("long").cast("string"))
    )
    sized = moved.withColumn("proposed", proposed).withColumns(
        {"size": memory_bytes(F.col("proposed")), "number": number(F.col("proposed"))}
    )
    value = F.when(memory, F.col("size").cast("double")).otherwise(F.col("number"))
    start = F.when(memory, F.col("now").cast("double")).otherwise(F.coalesce("base", F.lit(0.0)))
    limited = sized.withColumns({"_value": value, "_start": start}).withColumn(
        "_grown", F.when((F.col("_start") > 0) & (F.col("_value") > F.col("_start") * F.col("grow")), F.col("_start") * F.col("grow")).otherwise(F.col("_value"))
    )
    grown = F.when(memory, F.floor("_grown").cast("double")).otherwise(F.col("_grown"))
    final = F.when(grown < F.col("low"), F.col("low")).when(grown > F.col("high"), F.col("high")).otherwise(grown)
    bounded = limited.withColumn("_final", F.when(F.col("format").isNotNull(), final))
    capped = F.coalesce(F.col("_final") != F.col("_value"), F.lit(False))
    shown = (
        F.when(memory, F.when(capped, _memory_text("_final")).otherwise(F.col("proposed")))
        .when(F.col("format") == "integer", F.col("_final").cast("long").cast("string"))
        .when(F.col("format") == "float", F.col("_final").cast("string"))
        .otherwise(F.col("proposed"))
    )
    both = (F.col("now") > 0) & (F.col("size") > 0)
    change = F.when(unset, 100.0).when(both, (F.col("size") - F.col("now")) / F.col("now") * 100).otherwise(0.0)
    return bounded.select(
        app, "parameter", F.when(unset, "not set").otherwise(F.col("current")).alias("current_value"),
        shown.alias("recommended_value"), change.alias("change_pct"), "confidence",
        F.when(capped, "capped").otherwise("pass").alias("safety_check"), F.col("issue_type").alias("source"),
    )


# ---- baselines and tests ----------------------------------------------------------------------

def baseline_stats(runs: DataFrame, test: str, value: str) -> DataFrame:
    """Mean, upper median, min, max and population deviation per test; values that are not positive are dropped."""
    held = runs.filter(F.col(value) > 0)
    basics = held.groupBy(test).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("stddev")
    )
    return basics.join(values_at_ranks(held, [test], value, {"median": upper_median}).drop("_n"), test)


def against_baseline(current: DataFrame, baseline: DataFrame, test: str, limit: float = 20.0) -> DataFrame:
    """Percent change per test; duration regresses above +limit, throughput below -limit."""
    def pct(name: str) -> Column:
        return F.when(F.col(f"base_{name}") > 0, (F.col(name) - F.col(f"base_{name}")) / F.col(f"base_{name}") * 100).otherwise(0.0)

    joined = current.join(baseline, test)
    return joined.select(
        test, pct("duration_sec").alias("duration_diff_pct"), (pct("duration_sec") > limit).alias("duration_regression"),
        pct("throughput").alias("throughput_diff_pct"), (pct("throughput") < -limit).alias("throughput_regression"),
    )


def paired_t(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Paired t-test per group over rows holding both samples (NULL where one is missing).

    Unequal counts, or fewer than two pairs, give t = 0 and p = 1.
    """
    diff = F.col(a) - F.col(b)
    stats = pairs.groupBy(*keys).agg(
        F.count(a).alias("_na"), F.count(b).alias("_nb"), F.avg(diff).alias("_mean"), F.stddev_samp(diff).alias("_sd"),
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
    )
    usable = (F.col("_na") == F.col("_nb")) & (F.col("_na") >= 2)
    same = F.when(F.col("_mean") != 0, F.signum("_mean") * F.lit(float("inf")))  # all differences equal, and not 0
    t = F.when(usable & (F.col("_sd") > 0), F.col("_mean") / (F.col("_sd") / F.sqrt(F.col("_na")))).when(usable, same)
    t = F.when(usable, t).otherwise(F.lit(0.0))
    with_t = stats.withColumn("t", t).withColumn("usable", usable)
    p = F.when(F.col("usable"), t_p_value(F.col("t"), (F.col("_na") - 1).cast("double"))).otherwise(1.0)
    return with_t.select(*keys, "mean_a", "mean_b", F.col("_na").alias("n"), "t", p.alias("p_value"), "usable")


def regressions(pairs: DataFrame, keys: Sequence[str], baseline: str, current: str, limit: float = 20.0, alpha: float = 0.05) -> DataFrame:
    """Mean up by more than ``limit`` percent and significant, or no test possible. One-sided for every metric."""
    tested = paired_t(pairs, keys, baseline, current)
    change = F.when(F.col("mean_a") > 0, (F.col("mean_b") - F.col("mean_a")) / F.col("mean_a") * 100).otherwise(0.0)
    out = tested.select(
        *keys, F.col("mean_a").alias("baseline_mean"), F.col("mean_b").alias("current_mean"), change.alias("change_pct"),
        F.when(F.col("usable"), F.col("p_value")).alias("p_value"),
    )
    significant = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    return out.withColumns(
        {"significant": significant, "regression": (F.col("change_pct") > limit) & (significant | F.col("p_value").isNull())}
    )


def trade_offs(results: DataFrame, test: str, primary: Sequence[str], resources: Sequence[str], drop_pct: float = 10.0) -> DataFrame:
    """(test, primary metric, resource metric) where the primary regressed while the resource fell by more than 10%."""
    worse = results.filter(F.col("metric").isin(list(primary)) & F.col("regression")).select(
        test, F.col("metric").alias("primary"), F.col("change_pct").alias("primary_pct")
    )
    saved = results.filter(F.col("metric").isin(list(resources)) & (F.col("change_pct") < -drop_pct)).select(
        test, F.col("metric").alias("resource"), F.col("change_pct").alias("resource_pct")
    )
    return worse.join(saved, test)


def mean_interval(df: DataFrame, keys: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Student-t confidence interval of the mean; one sample gives a point, none gives 0."""
    stats = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    critical = t_critical(F.lit((1 + level) / 2), (F.col("n") - 1).cast("double"))
    with_t = stats.withColumn("_t", F.when(F.col("n") >= 2, critical))
    margin = F.coalesce(F.col("_t") * F.col("_sd") / F.sqrt("n"), F.lit(0.0))
    mean = F.coalesce("_mean", F.lit(0.0))
    return with_t.select(*keys, "n", mean.alias("mean"), (mean - margin).alias("lower"), (mean + margin).alias("upper"))


# ---- outliers, trend, percentiles -------------------------------------------------------------

def _outside(df: DataFrame, keys: Sequence[str], value: str, quartiles: DataFrame) -> DataFrame:
    """Rows beyond 1.5 interquartile ranges, for groups of at least 4 values and a spread."""
    iqr = F.col("_q3") - F.col("_q1")
    usable = quartiles.filter((F.col("_n") >= 4) & (iqr != 0)).select(
        *keys, (F.col("_q1") - 1.5 * iqr).alias("_low"), (F.col("_q3") + 1.5 * iqr).alias("_high")
    )
    found = join_group_stats(df, usable, keys).filter((F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high")))
    return found.drop("_low", "_high")


def iqr_outliers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return _outside(df, keys, value, linear_quantiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75}))


def index_iqr_outliers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles picked as sorted[n // 4] and sorted[3n // 4]."""
    return _outside(df, keys, value, values_at_ranks(df, keys, value, {"_q1": index_quartile(1), "_q3": index_quartile(3)}))


def zscore_outliers(df: DataFrame, keys: Sequence[str], value: str, threshold: float = 3.0) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(value).alias("_n"))
    usable = stats.filter((F.col("_n") >= 3) & (F.col("_s") > 0))
    scored = join_group_stats(df, usable, keys).withColumn("z", (F.col(value) - F.col("_m")) / F.col("_s"))
    return scored.filter(F.abs("z") > threshold).drop("_m", "_s", "_n")


def trends(series: DataFrame, keys: Sequence[str], order: str, value: str, window: int = 5) -> DataFrame:
    """Least squares over the moving average of a run series (one row per run) and its direction."""
    along, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    averaged = series.select(
        *keys, (F.row_number().over(along) - window).alias("x"),
        F.avg(value).over(along.rowsBetween(-(window - 1), 0)).alias("y"), F.count(F.lit(1)).over(whole).alias("runs"),
    )
    used = F.col("x") >= 0
    fitted = averaged.groupBy(*keys).agg(
        F.regr_slope(F.when(used, F.col("y")), F.col("x")).alias("slope"),
        F.corr(F.when(used, F.col("x")).cast("double"), F.when(used, F.col("y"))).alias("_r"),
        F.count_if(used).alias("points"),
    )
    df = F.col("points") - 2
    t = F.col("_r") * F.sqrt(df / (1 - F.col("_r") * F.col("_r")))
    tested = fitted.withColumn("_t", F.when((df > 0) & (F.abs("_r") < 1), t)).withColumn("p_value", t_p_value(F.col("_t"), df.cast("double")))
    direction = (
        F.when(F.col("points") < 2, "insufficient_data").when(F.col("p_value") > 0.05, "no_significant_trend")
        .when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    )
    return tested.select(*keys, direction.alias("trend"), "slope", (F.col("_r") * F.col("_r")).alias("r_squared"), "p_value", "points")


def percentiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    points = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return linear_quantiles(df, keys, value, points).drop("_n")


def latency_summary(queries: DataFrame, keys: Sequence[str], latency: str, ts: str, failed: Column) -> DataFrame:
    """Throughput, error rate, nearest-rank percentiles and mean latency per group."""
    seconds = F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))
    basics = queries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries_total"), F.count_if(failed).alias("queries_failed"), seconds.alias("_sec"),
        F.avg(latency).alias("latency_avg_ms"),
    )
    ranks = {"latency_p50_ms": upper_median, "latency_p95_ms": nearest_rank(0.95), "latency_p99_ms": nearest_rank(0.99)}
    picked = values_at_ranks(queries, keys, latency, ranks).drop("_n")
    rates = {
        "throughput_qps": safe_ratio(F.col("queries_total"), F.col("_sec")),
        "error_rate": safe_ratio(F.col("queries_failed"), F.col("queries_total")),
    }
    return basics.withColumns(rates).drop("_sec").join(picked, list(keys), "left")


def load_errors(summary: DataFrame, max_error_rate: float = 0.01, min_qps: float = 0.5, max_p95: float | None = None) -> DataFrame:
    """Adds ``errors``: a message per broken threshold."""
    rate, qps, p95 = F.col("error_rate"), F.col("throughput_qps"), F.col("latency_p95_ms")
    messages = [
        F.when(rate > max_error_rate, F.format_string("Error rate too high: %.2f%% > %.2f%%", rate * 100, F.lit(max_error_rate * 100))),
        F.when(qps < min_qps, F.format_string("Throughput too low: %.2f qps < %.2f qps", qps, F.lit(min_qps))),
    ]
    if max_p95 is not None:
        messages.append(F.when(p95 > max_p95, F.format_string("P95 latency too high: %.1fms > %.1fms", p95, F.lit(max_p95))))
    return summary.withColumn("errors", F.array_compact(F.array(*messages)))


def compare_versions(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """B against A: below 80% throughput or above 120% p95 latency is a regression."""
    left = a.select(*keys, F.col("throughput_qps").alias("qps_a"), F.col("latency_p95_ms").alias("p95_a"))
    right = b.select(*keys, F.col("throughput_qps").alias("qps_b"), F.col("latency_p95_ms").alias("p95_b"))
    pct = lambda x: safe_ratio((F.col(f"{x}_b") - F.col(f"{x}_a")) * 100, F.col(f"{x}_a"))
    return left.join(right, list(keys)).withColumns(
        {
            "qps_diff_pct": pct("qps"), "qps_regression": F.col("qps_b") < F.col("qps_a") * 0.8,
            "p95_diff_pct": pct("p95"), "p95_regression": F.col("p95_b") > F.col("p95_a") * 1.2,
        }
    )


# ---- result files and runs --------------------------------------------------------------------

def roll_up(results: DataFrame) -> DataFrame:
    """Totals over JSON results read with a corrupt-record column; an unreadable result counts as failed."""
    bad = F.col("_corrupt_record").isNotNull()
    out = results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~bad & (F.col("status") == "passed")).alias("passed"),
        F.count_if(bad | (F.col("status") == "failed")).alias("failed"),
        F.count_if(~bad & (F.col("status") == "skipped")).alias("skipped"),
        F.coalesce(F.sum(F.when(~bad, F.col("duration"))), F.lit(0.0)).alias("duration"),
    )
    return out.withColumn("pass_rate", F.when(F.col("total") > 0, F.round(F.col("passed") / F.col("total") * 100, 2)).otherwise(0.0))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    schema = "scenario STRING, status STRING, duration DOUBLE, _corrupt_record STRING"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def run_summary(runs: DataFrame) -> DataFrame:
    """Success by exit code, regressions, mean (of non-zero) and total duration."""
    timed = F.when(F.col("duration_sec") != 0, F.col("duration_sec"))
    return runs.agg(
        F.count(F.lit(1)).alias("total_tests"), F.count_if(F.coalesce("exit_code", F.lit(0)) == 0).alias("successful"),
        F.count_if(F.coalesce("exit_code", F.lit(0)) != 0).alias("failed"), F.count_if("regression").alias("regressions"),
        F.coalesce(F.avg(timed), F.lit(0.0)).alias("avg_duration"), F.coalesce(F.sum(timed), F.lit(0.0)).alias("total_duration"),
    )


def stage_health(stages: DataFrame, executors: DataFrame, app: str = "app_id") -> DataFrame:
    """Failed tasks, failed stages and spilled bytes as a share of shuffle reads, per application."""
    failed = stages.groupBy(app).agg(
        F.sum("num_failed_tasks").alias("failed_tasks"), F.count_if(F.col("status") == "FAILED").alias("failed_stages")
    )
    spill = executors.groupBy(app).agg(F.sum("shuffle_read").alias("_read"), F.sum("spilled").alias("_spilled"))
    pct = safe_ratio(F.col("_spilled") * 100, F.col("_read")).alias("spill_pct")
    return failed.join(spill, app, "full").select(app, "failed_tasks", "failed_stages", F.coalesce(pct, F.lit(0.0)).alias("spill_pct"))


def skew_by_median(tasks: DataFrame, stage: str, duration: str) -> DataFrame:
    """Longest task over the median task: above 4 severe, above 2 moderate."""
    picked = linear_quantiles(tasks.filter(F.col(stage).isNotNull()), [stage], duration, {"_median": 0.5, "_max": 1.0})
    ratio = picked.withColumn("ratio", safe_ratio(F.col("_max"), F.col("_median"), None))
    label = F.when(F.col("ratio") > 4, "severe").when(F.col("ratio") > 2, "moderate").otherwise("balanced")
    return ratio.select(stage, "ratio", label.alias("skew"))


def skew_by_mean(tasks: DataFrame, stage: str, duration: str) -> DataFrame:
    """Longest task over the mean task: above 5 severe, above 3 moderate."""
    ratio = tasks.groupBy(stage).agg(safe_ratio(F.max(duration), F.avg(duration), None).alias("ratio"))
    label = F.when(F.col("ratio") > 5, "severe").when(F.col("ratio") > 3, "moderate").otherwise("low")
    return ratio.withColumn("skew", label)


def key_skew(df: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The k most frequent keys with their share of rows and their ratio to the median key."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    middle = linear_quantiles(counts, [], "n", {"median": 0.5}).select("median").scalar()
    top = counts.orderBy(F.desc("n"), key).limit(k)
    return top.select(key, "n", (F.col("n") / total).alias("share"), (F.col("n") / middle).alias("ratio_to_median"))


def resource_wait(log: DataFrame, app: str = "app_id") -> DataFrame:
    """Seconds from application start to its first executor, the driver not counted."""
    start = F.min(F.when(F.col("event") == "ApplicationStart", F.col("time")))
    first = F.min(F.when((F.col("event") == "ExecutorAdded") & (F.col("executor_id") != "driver"), F.col("time")))
    waits = log.groupBy(app).agg(start.alias("_start"), first.alias("_first"))
    wait = (F.unix_micros(F.col("_first").cast("timestamp")) - F.unix_micros(F.col("_start").cast("timestamp"))) / 1e6
    return waits.filter(F.col("_start").isNotNull() & F.col("_first").isNotNull()).select(app, wait.alias("wait_seconds"))


def shuffle_class(ratio: Column) -> Column:
    """Read/write ratio: below 0.5, up to 1.5, up to 3, above."""
    return F.when(ratio < 0.5, "excellent").when(ratio <= 1.5, "good").when(ratio <= 3, "warning").otherwise("bad")


def metric_drift(current: DataFrame, previous: DataFrame, limit_pct: float = 20.0) -> DataFrame:
    """(metric, value) of two periods: percent change and whether it is above the limit."""
    joined = current.join(previous.withColumnRenamed("value", "previous"), "metric")
    pct = F.when(F.col("previous") > 0, (F.col("value") - F.col("previous")) / F.col("previous") * 100)
    return joined.withColumn("change_pct", pct).withColumn("regressed", F.coalesce(F.col("change_pct") > limit_pct, F.lit(False)))


def health_checks(task_failures: Column, executors_lost: Column, skew: Column) -> Column:
    """Names of the broken fixed limits: failures above 100, lost executors above 5, skew above 5."""
    return F.array_compact(
        F.array(
            F.when(task_failures > 100, "task_failures"), F.when(executors_lost > 5, "executors_lost"), F.when(skew > 5, "skew")
        )
    )


# Normal quantiles of 0.975 and 0.8.
Z_ALPHA, Z_POWER = 1.959963984540054, 0.8416212335729143


def samples_needed(effect: float) -> int:
    """Per group, for 5% two-sided significance and 80% power."""
    return int(((Z_ALPHA + Z_POWER) / effect) ** 2)


def ab_decision(df: DataFrame, arm: str, control: str, treatment: str, value: str, effect: float = 0.1) -> DataFrame:
    """z = (T - C) / (sd_C / sqrt(n_C)); below 5% a lower treatment is rolled out and a higher one rolled back."""
    is_c, is_t = F.col(arm) == control, F.col(arm) == treatment
    stats = df.agg(
        F.avg(F.when(is_c, F.col(value))).alias("control_mean"), F.avg(F.when(is_t, F.col(value))).alias("treatment_mean"),
        F.stddev_samp(F.when(is_c, F.col(value))).alias("_sd"), F.count(F.when(is_c, F.col(value))).alias("n"),
    )
    z = (F.col("treatment_mean") - F.col("control_mean")) / (F.col("_sd") / F.sqrt("n"))
    tested = stats.withColumn("z", z).withColumn("p_value", normal_p_value("z"))
    better = F.col("treatment_mean") < F.col("control_mean")
    decision = F.when(F.col("p_value") < 0.05, F.when(better, "rollout").otherwise("rollback")).otherwise("no difference")
    return tested.drop("_sd").withColumn("decision", decision).withColumn("samples_needed", F.lit(samples_needed(effect)))


def rows_per_partition(df: DataFrame) -> DataFrame:
    """Min, max, mean and median rows of the non-empty partitions and max over mean."""
    sizes = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.expr("percentile(n, 0.5)").alias("median"),
        (F.max("n") / F.avg("n")).alias("max_over_mean"),
    )
