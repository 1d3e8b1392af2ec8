"""Cost, capacity and service levels over a jobs table: an order is a job, its priority the team."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cost as ops
from tidemark.plans.inputs import table
from tidemark.plans.registry import query

JOBS_SQL = """SELECT o_orderkey AS job_id, o_custkey AS app_id, o_orderpriority AS team, o_orderdate::DATE AS day, o_totalprice / 100000 AS hours,
    o_orderkey % 8 + 1 AS executors, o_custkey % 4 + 1 AS cores, o_orderkey % 16 + 1 AS memory_gb, o_orderstatus = 'P' AS spot,
    o_orderstatus = 'F' AND o_orderkey % 9 = 0 AS failed, (o_orderkey * 37 % 9000) / 1000 AS start_delay_sec,
    (o_orderkey * 13 % 101)::DOUBLE AS cpu_pct, (o_custkey * 7 % 101)::DOUBLE AS mem_pct, (o_orderkey % 29)::DOUBLE AS gc_pct,
    o_custkey % 11 * 2e8::DOUBLE AS spill_bytes FROM orders"""
COST_SQL = f"""SELECT *, executors * cores * hours AS vcpu_hours, executors * memory_gb * hours AS gb_hours,
    executors * cores * hours * CASE WHEN spot THEN 0.00756::DOUBLE ELSE 0.0252::DOUBLE END AS vcpu_cost,
    executors * memory_gb * hours * CASE WHEN spot THEN 0.0042::DOUBLE ELSE 0.014::DOUBLE END AS memory_cost FROM ({JOBS_SQL})"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        key.alias("job_id"), cust.alias("app_id"), F.col("o_orderpriority").alias("team"), F.to_date("o_orderdate").alias("day"),
        (F.col("o_totalprice") / 100000).alias("hours"), (key % 8 + 1).alias("executors"), (cust % 4 + 1).alias("cores"),
        (key % 16 + 1).alias("memory_gb"), (F.col("o_orderstatus") == "P").alias("spot"),
        ((F.col("o_orderstatus") == "F") & (key % 9 == 0)).alias("failed"), (key * 37 % 9000 / 1000).alias("start_delay_sec"),
        (key * 13 % 101).cast("double").alias("cpu_pct"), (cust * 7 % 101).cast("double").alias("mem_pct"),
        (key % 29).cast("double").alias("gc_pct"), (cust % 11 * 2e8).alias("spill_bytes"),
    )


def costs(spark: SparkSession, d: str) -> DataFrame:
    return ops.job_costs(jobs(spark, d))


@query(
    "cst_01_job_costs",
    f"SELECT job_id, vcpu_hours, gb_hours, vcpu_cost, memory_cost, vcpu_cost + memory_cost AS total_cost FROM ({COST_SQL})",
)
def job_costs(spark: SparkSession, d: str) -> DataFrame:
    return costs(spark, d).select("job_id", "vcpu_hours", "gb_hours", "vcpu_cost", "memory_cost", "total_cost")


TEAM_SQL = f"""SELECT team, round(sum(vcpu_cost + memory_cost), 4) AS total_cost, count(*) AS jobs, round(sum(vcpu_hours), 4) AS vcpu_hours,
    round(sum(gb_hours), 4) AS gb_hours, round(avg(vcpu_cost + memory_cost), 6) AS avg_cost FROM ({COST_SQL}) GROUP BY 1"""


@query("cst_02_team_costs", TEAM_SQL)
def team_costs(spark: SparkSession, d: str) -> DataFrame:
    return ops.team_costs(costs(spark, d))


@query(
    "cst_03_component_breakdown",
    f"""WITH p AS (SELECT job_id, hours * 0.192::DOUBLE + memory_gb * hours * 0.002::DOUBLE AS d,
        executors * cores * hours * 0.192::DOUBLE + executors * memory_gb * hours * 0.002::DOUBLE AS e,
        (100 * 0.023::DOUBLE / 30) * (hours / 720) AS s FROM ({JOBS_SQL}))
    SELECT job_id, d AS driver_cost, e AS executor_cost, s AS storage_cost, 10 * 0.09::DOUBLE AS network_cost,
        d + e + s + 10 * 0.09::DOUBLE AS total_cost FROM p""",
)
def component_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return ops.component_breakdown(jobs(spark, d))


# Each team's share of the yearly budget.
BUDGET_SHARES = {"1-URGENT": 0.15, "2-HIGH": 0.19, "3-MEDIUM": 0.21, "4-NOT SPECIFIED": 0.26, "5-LOW": 0.4}
SHARES_SQL = " ".join(f"WHEN '{t}' THEN {s}::DOUBLE" for t, s in BUDGET_SHARES.items())


@query(
    "cst_04_budget_status",
    f"""WITH t AS ({TEAM_SQL}), b AS (SELECT team, total_cost, (SELECT sum(total_cost) FROM t) * CASE team {SHARES_SQL} END AS budget FROM t),
    p AS (SELECT *, total_cost / budget * 100 AS pct FROM b)
    SELECT team, round(pct, 4) AS pct, CASE WHEN floor(pct) >= 100 THEN 'EXCEED' WHEN floor(pct) >= 90 THEN 'CRITICAL'
        WHEN floor(pct) >= 70 THEN 'WARNING' ELSE 'OK' END AS status FROM p""",
)
def budget_status(spark: SparkSession, d: str) -> DataFrame:
    spend = ops.team_costs(costs(spark, d)).select("team", "total_cost")
    whole = spend.agg(F.sum("total_cost").alias("total"))
    shares = spark.createDataFrame(list(BUDGET_SHARES.items()), "team string, share double")
    budgets = shares.select("team", (F.col("share") * whole.scalar()).alias("budget"))
    return ops.budget_status(spend, budgets).select("team", F.round("pct", 4).alias("pct"), "status")


ANOMALY_SQL = f"""WITH c AS ({COST_SQL}), d AS (SELECT team, day, round(sum(vcpu_cost + memory_cost), 6) AS cost FROM c GROUP BY 1, 2),
    w AS (SELECT *, avg(cost) OVER o AS m, stddev_pop(cost) OVER o AS s FROM d
          WINDOW o AS (PARTITION BY team ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
    a AS (SELECT *, (cost - m) / s AS z FROM w WHERE s > 0 AND abs((cost - m) / s) >= 3)"""


@query("cst_05_anomalies", f"{ANOMALY_SQL} SELECT team, day, cost, round(z, 4) AS z, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS direction FROM a")
def anomalies(spark: SparkSession, d: str) -> DataFrame:
    return ops.cost_anomalies(costs(spark, d)).select("team", "day", "cost", F.round("z", 4).alias("z"), "direction")


@query(
    "cst_05_top_apps",
    f"""{ANOMALY_SQL} SELECT team, day, app_id, round(sum(vcpu_cost + memory_cost), 6) AS cost,
        row_number() OVER (PARTITION BY team, day ORDER BY round(sum(vcpu_cost + memory_cost), 6) DESC, app_id) AS rank
    FROM c JOIN (SELECT team, day FROM a) USING (team, day) GROUP BY 1, 2, 3 QUALIFY rank <= 5""",
)
def top_apps(spark: SparkSession, d: str) -> DataFrame:
    priced = costs(spark, d)
    return ops.top_apps(priced, ops.cost_anomalies(priced))


@query(
    "cst_06_monthly_forecast",
    f"""WITH m AS (SELECT team, date_trunc('month', day)::DATE AS month, sum(vcpu_cost + memory_cost) AS cost FROM ({COST_SQL}) GROUP BY 1, 2),
    x AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY month) AS x FROM m),
    f AS (SELECT team, regr_slope(cost, x) AS s, regr_intercept(cost, x) AS i, max(x) AS n, max(month) AS last, arg_max(cost, month) AS lc FROM x GROUP BY 1)
    SELECT team, (last + to_months(step::INT))::DATE AS month, round(s * (n + step) + i, 4) AS forecast, round(s * 100 / lc, 4) AS growth_pct
    FROM f, range(1, 4) r(step)""",
)
def monthly_forecast(spark: SparkSession, d: str) -> DataFrame:
    out = ops.monthly_forecast(costs(spark, d), "team")
    return out.withColumns({"forecast": F.round("forecast", 4), "growth_pct": F.round("growth_pct", 4)})


@query(
    "cst_07_compound_and_capacity",
    f"""SELECT team, round(total_cost * 1.05::DOUBLE, 4) AS next_quarter, round(vcpu_hours * (1 + 0.25::DOUBLE * 0.5), 4) AS capacity FROM ({TEAM_SQL})""",
)
def compound_and_capacity(spark: SparkSession, d: str) -> DataFrame:
    teams = ops.team_costs(costs(spark, d))
    return teams.select(
        "team", F.round(ops.compound(F.col("total_cost"), 0.05), 4).alias("next_quarter"),
        F.round(ops.capacity(F.col("vcpu_hours"), 0.25, 0.5), 4).alias("capacity"),
    )


@query(
    "cst_08_utilization_advice",
    f"""WITH u AS (SELECT job_id, cores::DOUBLE AS cr, memory_gb::DOUBLE AS mr, floor(cores * cpu_pct / cores) AS cu, floor(mem_pct) AS mu FROM ({JOBS_SQL}))
    SELECT job_id, CASE WHEN cu < 30 THEN 'SCALE_DOWN_CPU' WHEN cu > 90 THEN 'SCALE_UP_CPU' ELSE 'NO_ACTION' END
        || CASE WHEN mu < 30 THEN '_MEMORY' WHEN mu > 90 THEN '_SCALE_UP_MEMORY' ELSE '' END AS action,
        round(CASE WHEN cu < 30 THEN cr * 0.7 WHEN cu > 90 THEN cr * 1.5 ELSE cr END, 4) AS recommended_cpu,
        round(CASE WHEN mu < 30 THEN mr * 0.7 WHEN mu > 90 THEN mr * 1.5 ELSE mr END, 4) AS recommended_mem FROM u""",
)
def utilization_advice(spark: SparkSession, d: str) -> DataFrame:
    usage = jobs(spark, d).select(
        "job_id", F.col("cores").cast("double").alias("cpu_request"), F.col("memory_gb").cast("double").alias("mem_request"),
        (F.col("cores") * (F.col("cpu_pct") + 0.001) / 100).alias("cpu_used"), (F.col("memory_gb") * (F.col("mem_pct") + 0.001) / 100).alias("mem_used"),
    )
    out = ops.utilization_advice(usage)
    return out.select("job_id", "action", F.round("recommended_cpu", 4).alias("recommended_cpu"), F.round("recommended_mem", 4).alias("recommended_mem"))


@query(
    "cst_09_job_advice",
    f"""SELECT job_id, CASE WHEN gc_pct > 20 THEN 'Increase executor memory to reduce GC' WHEN cpu_pct < 20 THEN 'Reduce executor count or cores'
        WHEN mem_pct < 30 THEN 'Reduce executor memory' WHEN spill_bytes > 1e9 THEN 'Increase memory to reduce shuffle spill' END AS recommendation,
        CASE WHEN gc_pct > 20 OR spill_bytes > 1e9 THEN 0 ELSE greatest(CASE WHEN cpu_pct < 20 THEN 100 - floor(cpu_pct) ELSE 0 END,
            CASE WHEN mem_pct < 30 THEN 100 - floor(mem_pct) ELSE 0 END) END::BIGINT AS savings_pct FROM ({JOBS_SQL})""",
)
def job_advice(spark: SparkSession, d: str) -> DataFrame:
    return ops.job_advice(jobs(spark, d)).select("job_id", "recommendation", F.col("savings_pct").cast("long").alias("savings_pct"))


LEVELS_SQL = f"""SELECT day, count(*) AS jobs, (count(*) - count(*) FILTER (failed)) * 100 / count(*) AS success_rate,
    quantile_cont(start_delay_sec, 0.95) AS p95_start_sec, count(*) / 24 AS jobs_per_hour, count(*) FILTER (failed) / count(*) AS error_rate
    FROM ({JOBS_SQL}) GROUP BY 1"""


@query(
    "cst_10_slo_forecast",
    f"""WITH m AS (SELECT avg(error_rate) AS m FROM ({LEVELS_SQL}))
    SELECT d::INT AS day, round(m * (1 + 0.01::DOUBLE * d), 8) AS forecast, m * (1 + 0.01::DOUBLE * d) > 0.038 AS will_breach FROM m, range(1, 8) r(d)""",
)
def slo_forecast(spark: SparkSession, d: str) -> DataFrame:
    out = ops.slo_forecast(ops.service_levels(jobs(spark, d)), "error_rate", 0.038)
    return out.withColumn("forecast", F.round("forecast", 8))


@query(
    "cst_11_service_levels",
    f"SELECT day, jobs, round(success_rate, 6) AS success_rate, round(p95_start_sec, 6) AS p95_start_sec, round(jobs_per_hour, 6) AS jobs_per_hour, round(error_rate, 6) AS error_rate FROM ({LEVELS_SQL})",
)
def service_levels(spark: SparkSession, d: str) -> DataFrame:
    out = ops.service_levels(jobs(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("success_rate", "p95_start_sec", "jobs_per_hour", "error_rate")})


DATASETS_SQL = "SELECT o_custkey AS dataset, floor(sum(o_totalprice) / 10)::BIGINT AS size_mb FROM orders GROUP BY 1"


def datasets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("dataset")).agg(F.floor(F.round(F.sum("o_totalprice"), 2) / 10).alias("size_mb"))


@query(
    "cst_12_executor_sizing",
    f"""WITH e AS (SELECT dataset, size_mb, least(greatest(greatest(1, greatest(200, size_mb // 128) // 4), greatest(1, size_mb * 3 // 8192)), 400 // 4, 1000 // 8) AS executors
        FROM ({DATASETS_SQL.replace("sum(o_totalprice)", "round(sum(o_totalprice), 2)")}))
    SELECT dataset, size_mb, executors::BIGINT AS executors, greatest(1, executors // 4)::BIGINT AS min_executors, (executors * 2)::BIGINT AS max_executors,
        (executors * 4)::BIGINT AS total_cores, ((executors + 1) * 8)::DOUBLE AS total_memory_gb FROM e""",
)
def executor_sizing(spark: SparkSession, d: str) -> DataFrame:
    return ops.executor_sizing(datasets(spark, d), "large", cluster_cores=400, cluster_memory_gb=1000)


@query(
    "cst_13_tuning_figures",
    f"""SELECT dataset, size_mb, greatest(200, floor(size_mb / 1024 * 1024 / 128))::BIGINT AS partitions, 16 AS executor_memory_gb,
        greatest(2, least(floor(floor(size_mb / 1024 / 2 / 4) * 1.2::DOUBLE), 100))::BIGINT AS executor_count
    FROM ({DATASETS_SQL.replace("sum(o_totalprice)", "round(sum(o_totalprice), 2)")})""",
)
def tuning_figures(spark: SparkSession, d: str) -> DataFrame:
    return ops.tuning_figures(datasets(spark, d))
