import pytest

from tidemark.functions.stats import t_quantile, t_two_sided
from tidemark.operators import metrics as ops
from tidemark.operators.control import plan_text

SAMPLE = {
    "gc_time": 5.2, "memory_spill": 1.5e9, "task_duration_p50": 2.5, "task_duration_p99": 12.5, "task_duration_avg": 3.2,
    "shuffle_read": 2.1e9, "shuffle_write": 1.8e9, "cpu_utilization": 0.55, "executor_memory": 1.2e10, "executor_count": 2.0,
    "gc_ratio": 0.08, "task_skew_ratio": 5.0, "duration_seconds": 45.0,
}


def app(spark, metrics, config=None):
    return spark.createDataFrame([("app", metrics, config or {})], "app_id string, metrics map<string,double>, config map<string,string>")


def found(spark, metrics):
    return {r["issue_type"]: r["severity"] for r in ops.issues(app(spark, metrics)).collect()}


def test_sample_application(spark):
    assert found(spark, SAMPLE) == {
        "memory_spill": "critical", "data_skew": "critical", "low_cpu_utilization": "warning", "high_shuffle_bytes": "warning",
    }
    row = ops.workload(app(spark, SAMPLE)).select("workload_type", ops.confidence().alias("c")).first()
    assert tuple(row) == ("etl_batch", 1.0)


@pytest.mark.parametrize(
    "metrics, severity",
    [({"gc_ratio": 0.0999}, None), ({"gc_ratio": 0.10}, "warning"), ({"gc_ratio": 0.20}, "critical"), ({"cpu_utilization": 0.60}, "warning"),
     ({"cpu_utilization": 0.40}, "critical"), ({"cpu_utilization": 0.61}, None), ({"cpu_utilization": 0.99}, "critical"), ({}, None)],
)
def test_rule_bounds_are_inclusive(spark, metrics, severity):
    assert list(found(spark, metrics).values()) == ([severity] if severity else [])


def test_workloads(spark):
    def kind(**metrics):
        return ops.workload(app(spark, metrics)).first()["workload_type"]

    assert kind() == "etl_batch"
    assert kind(shuffle_write=1e6, task_duration_avg=0.1) == "interactive"
    assert kind(duration_seconds=-1.0) == "streaming"
    assert kind(executor_memory=9e9, task_duration_avg=11.0) == "ml_training"


def test_derived_ratios_need_a_positive_divisor(spark):
    out = ops.with_derived(app(spark, {"task_duration_p99": 4.0, "task_duration_p50": 0.0, "cpu_utilization": 0.8})).first()["metrics"]
    assert "task_skew_ratio" not in out and "gc_ratio" not in out and out["cpu_efficiency"] == 0.8


def advice(spark, metrics, config):
    out = ops.recommendations(ops.issues(app(spark, metrics, config)))
    return {r["parameter"]: (r["recommended_value"], r["safety_check"], r["source"]) for r in out.collect()}


def test_recommendations(spark):
    config = {"spark.executor.memory": "8Gi", "spark.executor.cores": "4", "spark.sql.shuffle.partitions": "200"}
    out = advice(spark, SAMPLE, config)
    assert out["spark.executor.memory"] == ("10Gi", "pass", "memory_spill")
    assert out["spark.executor.cores"] == ("3", "pass", "low_cpu_utilization")
    assert out["spark.sql.shuffle.partitions"] == ("400", "pass", "high_shuffle_bytes")
    assert out["spark.sql.adaptive.skewJoin.enabled"] == ("true", "pass", "data_skew")


def test_bounds_cap_and_conflicts_keep_the_higher_confidence(spark):
    out = advice(spark, {"memory_spill": 2e9, "gc_ratio": 0.5}, {"spark.executor.memory": "32Gi"})
    assert out["spark.executor.memory"] == ("32Gi", "capped", "memory_spill")
    assert advice(spark, {"cpu_utilization": 0.1}, {"spark.executor.cores": "1"})["spark.executor.cores"][0] == "1"


def test_student_t():
    assert t_two_sided(2.0, 14) == pytest.approx(0.065287952889, abs=1e-11)
    assert t_quantile(0.975, 1) == pytest.approx(12.706204736, abs=1e-8)
    assert t_quantile(0.975, 29) == pytest.approx(2.045229642133, abs=1e-10)


def test_paired_t_edge_cases(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 5.0), ("b", 1.0, None), ("b", 2.0, 3.0), ("c", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = {r["g"]: (r["t"], r["p_value"]) for r in ops.paired_t(df, ["g"], "x", "y").collect()}
    assert out["a"][0] == pytest.approx(-5.0) and out["a"][1] == pytest.approx(0.0377, abs=1e-4)
    assert out["b"] == (0.0, 1.0) and out["c"] == (0.0, 1.0)


def test_interval_of_one_value_is_a_point(spark):
    out = ops.mean_interval(spark.createDataFrame([("a", 4.0)], "g string, v double"), ["g"], "v").first()
    assert (out["mean"], out["lower"], out["upper"]) == (4.0, 4.0, 4.0)


def test_mean_interval(spark):
    rows = [("a", float(v)) for v in range(10)]
    out = ops.mean_interval(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").first()
    assert out["upper"] - out["mean"] == pytest.approx(2.262157163 * 3.0276503541 / 10**0.5, abs=1e-6)


def test_trend(spark):
    rows = [("up", i, float(i)) for i in range(20)] + [("short", i, 1.0) for i in range(3)]
    out = {r["g"]: r["trend"] for r in ops.trends(spark.createDataFrame(rows, "g string, i int, v double"), ["g"], "i", "v").collect()}
    assert out["short"] == "insufficient_data" and out["up"] == "increasing"


def test_samples_needed():
    assert ops.samples_needed(0.1) == 784


def test_sampled_metrics_by_rule(spark):
    rows = [
        ("a", "gc", 2.0, 2), ("a", "gc", 3.0, 1), ("a", "took", 2.0, 1), ("a", "took", None, 2), ("a", "took", 4.0, 3), ("a", "size", None, 1),
        ("a", "size", 7.0, 3), ("a", "size", 9.0, 2), ("a", "rest", 5.0, 1), ("b", "size", None, 1), ("b", "free", -3.0, 1), ("b", "free", -4.0, 2),
        ("c", "rest", 1.0, 1), (None, "gc", 8.0, 1), (None, "size", 8.0, 1),
    ]
    samples = spark.createDataFrame(rows, "app_id string, metric string, value double, at int").repartition(4)
    rules = {"gc": "sum", "took": "avg", "free": "min", "peak": "max", "size": "value"}
    out = ops.sampled_metrics(samples, rules)
    assert out.columns == ["app_id", "metric", "value"]
    values = {}
    for r in out.collect():
        values.setdefault(r["app_id"], {})[r["metric"]] = r["value"]
    nothing = dict.fromkeys(rules, 0.0)
    assert values == {
        "a": {**nothing, "gc": 5.0, "took": 3.0, "size": 9.0}, "b": {**nothing, "free": -4.0}, "c": nothing, None: nothing,
    }


def test_sampled_metrics_are_sorted_for_first_samples_only(spark):
    """Five samples a row in one sorted aggregate spilled most of their size; the plain figures are hashed, one row per application."""
    samples = spark.createDataFrame([("a", "gc", 2.0, (1, 2))], "app_id string, metric string, value double, at struct<x:int,y:int>")
    plan = plan_text(ops.sampled_metrics(samples, {"gc": "sum", "peak": "max"}), "simple")
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1


def test_skew_by_median_reads_its_tasks_once(spark, tmp_path):
    rows = [(1, 2.0), (1, 4.0), (1, 30.0), (2, 1.0), (2, 1.0), (2, None), (3, None), (None, 5.0), (4, 2.0), (4, 2.0), (4, 5.0)]
    spark.createDataFrame(rows, "stage int, took double").write.parquet(str(tmp_path / "tasks"))
    out = ops.skew_by_median(spark.read.parquet(str(tmp_path / "tasks")), "stage", "took")
    assert str(tmp_path / "tasks") not in plan_text(out)  # all is written by then
    assert {r["stage"]: (r["ratio"], r["skew"]) for r in out.collect()} == {1: (7.5, "severe"), 2: (1.0, "balanced"), 4: (2.5, "moderate")}
