"""Cost, capacity and service-level analytics over a jobs table.

A jobs row carries: job_id, app_id, team, day, hours, executors, cores, memory_gb, spot, and for the
service levels failed and start_delay_sec.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import safe_ratio
from tidemark.operators.order_stats import linear_quantiles

# Dollars per vCPU hour and per GB hour, on demand and on spot nodes.
RATES = {"vcpu": 0.0252, "gb": 0.014, "spot_vcpu": 0.00756, "spot_gb": 0.0042}

# Rates of the component breakdown (per CPU hour, GB hour, GB month, GB moved).
COMPONENT_RATES = {"cpu": 0.192, "memory": 0.002, "storage": 0.023, "network": 0.09}


def job_costs(jobs: DataFrame) -> DataFrame:
    """Adds vcpu_hours, gb_hours, vcpu_cost, memory_cost and total_cost."""
    spot = F.col("spot")
    with_hours = jobs.withColumns(
        {"vcpu_hours": F.col("executors") * F.col("cores") * F.col("hours"), "gb_hours": F.col("executors") * F.col("memory_gb") * F.col("hours")}
    )
    with_cost = with_hours.withColumns(
        {
            "vcpu_cost": F.col("vcpu_hours") * F.when(spot, RATES["spot_vcpu"]).otherwise(RATES["vcpu"]),
            "memory_cost": F.col("gb_hours") * F.when(spot, RATES["spot_gb"]).otherwise(RATES["gb"]),
        }
    )
    return with_cost.withColumn("total_cost", F.col("vcpu_cost") + F.col("memory_cost"))


def team_costs(costs: DataFrame) -> DataFrame:
    return costs.groupBy("team").agg(
        F.round(F.sum("total_cost"), 4).alias("total_cost"), F.count(F.lit(1)).alias("jobs"),
        F.round(F.sum("vcpu_hours"), 4).alias("vcpu_hours"), F.round(F.sum("gb_hours"), 4).alias("gb_hours"),
        F.round(F.avg("total_cost"), 6).alias("avg_cost"),
    )


def component_breakdown(jobs: DataFrame, storage_gb: float = 100, network_gb: float = 10) -> DataFrame:
    """Driver, executor, storage and network cost per job; the driver is one core and one memory share."""
    hours, r = F.col("hours"), COMPONENT_RATES
    driver = hours * r["cpu"] + F.col("memory_gb") * hours * r["memory"]
    workers = F.col("executors") * F.col("cores") * hours * r["cpu"] + F.col("executors") * F.col("memory_gb") * hours * r["memory"]
    storage = F.lit(storage_gb * r["storage"] / 30) * (hours / 720)
    parts = jobs.select("job_id", driver.alias("driver_cost"), workers.alias("executor_cost"), storage.alias("storage_cost"), F.lit(network_gb * r["network"]).alias("network_cost"))
    return parts.withColumn("total_cost", F.col("driver_cost") + F.col("executor_cost") + F.col("storage_cost") + F.col("network_cost"))


def budget_status(spend: DataFrame, budgets: DataFrame, team: str = "team") -> DataFrame:
    """Percent of budget, cut to a whole number for the status; a zero budget counts as 0 percent."""
    pct = F.when(F.col("budget") > 0, F.col("total_cost") / F.col("budget") * 100).otherwise(0.0)
    whole = F.floor("pct")
    status = F.when(whole >= 100, "EXCEED").when(whole >= 90, "CRITICAL").when(whole >= 70, "WARNING").otherwise("OK")
    return spend.join(budgets, team).withColumn("pct", pct).withColumn("status", status)


def cost_anomalies(costs: DataFrame, days: int = 30, threshold: float = 3.0) -> DataFrame:
    """Days whose team cost lies ``threshold`` deviations from the mean of the ``days`` calendar days before."""
    daily = costs.groupBy("team", "day").agg(F.round(F.sum("total_cost"), 6).alias("cost"))
    before = Window.partitionBy("team").orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    scored = daily.withColumns(
        {"mean": F.avg("cost").over(before), "stddev": F.stddev_pop("cost").over(before)}
    ).withColumn("z", F.when(F.col("stddev") > 0, (F.col("cost") - F.col("mean")) / F.col("stddev")))
    direction = F.when(F.col("z") > 0, "spike").otherwise("drop")
    return scored.filter(F.abs("z") >= threshold).withColumn("direction", direction)


def top_apps(costs: DataFrame, anomalies: DataFrame, k: int = 5) -> DataFrame:
    """The k costliest applications of each anomalous (team, day)."""
    per_app = costs.join(anomalies.select("team", "day"), ["team", "day"], "left_semi").groupBy("team", "day", "app_id").agg(
        F.round(F.sum("total_cost"), 6).alias("cost")
    )
    rank = F.row_number().over(Window.partitionBy("team", "day").orderBy(F.desc("cost"), "app_id"))
    return per_app.withColumn("rank", rank).filter(F.col("rank") <= k)


def monthly_forecast(costs: DataFrame, group: str, months: int = 3) -> DataFrame:
    """Least-squares line through the monthly totals of a group, continued ``months`` ahead; at least two months."""
    totals = costs.groupBy(group, F.trunc("day", "month").alias("month")).agg(F.sum("total_cost").alias("cost"))
    numbered = totals.withColumn("x", F.row_number().over(Window.partitionBy(group).orderBy("month")))
    fitted = numbered.groupBy(group).agg(
        F.regr_slope("cost", "x").alias("slope"), F.regr_intercept("cost", "x").alias("intercept"),
        F.max("x").alias("n"), F.max("month").alias("last_month"), F.max_by("cost", "month").alias("last_cost"),
    )
    ahead = fitted.filter(F.col("n") >= 2).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(months))))
    return ahead.select(
        group, F.add_months("last_month", F.col("step")).alias("month"),
        (F.col("slope") * (F.col("n") + F.col("step")) + F.col("intercept")).alias("forecast"),
        (F.col("slope") * 100 / F.col("last_cost")).alias("growth_pct"),
    )


def compound(cost: Column, growth: float) -> Column:
    return cost * (1 + growth)


def capacity(current: Column, growth: float, periods: float) -> Column:
    return current * (1 + growth * periods)


def utilization_advice(usage: DataFrame) -> DataFrame:
    """CPU and memory apart: below 30% of the request x0.7, above 90% x1.5, else unchanged."""
    def pct(kind: str) -> Column:
        return F.floor(safe_ratio(F.col(f"{kind}_used") * 100, F.col(f"{kind}_request")))

    def resized(kind: str) -> Column:
        util = F.col(f"{kind}_util")
        return F.when(util < 30, F.col(f"{kind}_request") * 0.7).when(util > 90, F.col(f"{kind}_request") * 1.5).otherwise(F.col(f"{kind}_request"))

    measured = usage.withColumns({"cpu_util": pct("cpu"), "mem_util": pct("mem")})
    cpu = F.when(F.col("cpu_util") < 30, "SCALE_DOWN_CPU").when(F.col("cpu_util") > 90, "SCALE_UP_CPU").otherwise("NO_ACTION")
    mem = F.when(F.col("mem_util") < 30, "_MEMORY").when(F.col("mem_util") > 90, "_SCALE_UP_MEMORY").otherwise("")
    return measured.withColumns({"action": F.concat(cpu, mem), "recommended_cpu": resized("cpu"), "recommended_mem": resized("mem")})


def job_advice(usage: DataFrame) -> DataFrame:
    """Low CPU, then low memory; high GC overrides both, and spill fills an empty advice. Both void savings."""
    cpu, mem = F.col("cpu_pct"), F.col("mem_pct")
    advice = (
        F.when(F.col("gc_pct") > 20, "Increase executor memory to reduce GC")
        .when(cpu < 20, "Reduce executor count or cores")
        .when(mem < 30, "Reduce executor memory")
        .when(F.col("spill_bytes") > 1e9, "Increase memory to reduce shuffle spill")
    )
    saved = F.greatest(F.when(cpu < 20, 100 - F.floor(cpu)).otherwise(0), F.when(mem < 30, 100 - F.floor(mem)).otherwise(0))
    void = (F.col("gc_pct") > 20) | (F.col("spill_bytes") > 1e9)
    return usage.withColumns({"recommendation": advice, "savings_pct": F.when(void, 0).otherwise(saved)})


def slo_forecast(daily: DataFrame, rate: str, threshold: float, days: int = 7) -> DataFrame:
    """The mean rate grown by 1% per day, and whether it breaches the threshold."""
    mean = daily.agg(F.avg(rate).alias("_mean")).withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))
    value = F.col("_mean") * (1 + 0.01 * F.col("day"))
    return mean.select("day", value.alias("forecast"), (value > threshold).alias("will_breach"))


def service_levels(jobs: DataFrame, day: str = "day") -> DataFrame:
    """Success rate, p95 start delay, jobs per hour and error rate per day."""
    basics = jobs.groupBy(day).agg(F.count(F.lit(1)).alias("jobs"), F.count_if("failed").alias("_failed"))
    delay = linear_quantiles(jobs, [day], "start_delay_sec", {"p95_start_sec": 0.95}).drop("_n")
    return basics.join(delay, day, "left").select(
        day, "jobs", ((F.col("jobs") - F.col("_failed")) * 100 / F.col("jobs")).alias("success_rate"), "p95_start_sec",
        (F.col("jobs") / 24).alias("jobs_per_hour"), (F.col("_failed") / F.col("jobs")).alias("error_rate"),
    )


# Fixed values: (cores, memory in MB) of the executor sizes.
PRESETS = {"small": (1, 1024), "medium": (2, 4096), "large": (4, 8192), "xlarge": (8, 16384)}


def executor_sizing(
    datasets: DataFrame, preset: str = "medium", cluster_cores: int | None = None, cluster_memory_gb: int | None = None
) -> DataFrame:
    """Executors per dataset from its ``size_mb``: the larger of the parallelism and the memory need, capped by the cluster."""
    cores, memory_mb = PRESETS[preset]
    size = F.col("size_mb")
    by_cores = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(200), F.floor(size / 128)) / cores))
    by_memory = F.greatest(F.lit(1), F.floor(size * 3 / memory_mb))
    count = F.greatest(by_cores, by_memory)
    if cluster_cores:
        count = F.least(count, F.lit(cluster_cores // cores))
    if cluster_memory_gb:
        count = F.least(count, F.lit(int(cluster_memory_gb / (memory_mb / 1024))))
    sized = datasets.withColumn("executors", count.cast("long"))
    return sized.withColumns(
        {
            "min_executors": F.greatest(F.lit(1), F.floor(F.col("executors") / 4)), "max_executors": F.col("executors") * 2,
            "total_cores": F.col("executors") * cores, "total_memory_gb": (F.col("executors") + 1) * (memory_mb / 1024),
        }
    )


def tuning_figures(datasets: DataFrame, cores: int = 4, target_mb: int = 128) -> DataFrame:
    """Shuffle partitions, executor memory (rounded up to a standard size) and executor count per dataset."""
    gigs = F.col("size_mb") / 1024
    need = cores * 3 * 1.2
    memory = next((size for size in (4, 8, 16, 32, 64) if need <= size), 64)
    executors = F.floor(F.floor(gigs / 2 / cores) * F.lit(1.2))
    return datasets.withColumns(
        {
            "partitions": F.greatest(F.lit(200), F.floor(gigs * 1024 / target_mb)), "executor_memory_gb": F.lit(memory),
            "executor_count": F.greatest(F.lit(2), F.least(executors, F.lit(100))),
        }
    )
