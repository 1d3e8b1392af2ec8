import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import order_stats as ops
from tidemark.session import materialize


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return {"hot": np.round(np.exp(rng.normal(0, 4, 4000)), 3), "few": np.array([2.0, 2.0, 5.0]), "one": np.array([9.5])}


def frame(spark, data):
    return spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", None)], "k string, v double")


def test_linear_quantiles_with_a_long_tail(spark, data):
    wanted = {"p25": 0.25, "p50": 0.5, "p99": 0.99}
    out = {r["k"]: r for r in ops.linear_quantiles(frame(spark, data), ["k"], "v", wanted).collect()}
    for key, values in data.items():
        assert out[key]["_n"] == len(values)
        for name, q in wanted.items():
            assert out[key][name] == pytest.approx(np.percentile(values, q * 100), rel=1e-12)


def test_rank_picks(spark, data):
    ranks = {"upper": ops.upper_median, "q1": ops.index_quartile(1), "q3": ops.index_quartile(3), "p95": ops.nearest_rank(0.95)}
    out = {r["k"]: r for r in ops.values_at_ranks(frame(spark, data), ["k"], "v", ranks).collect()}
    for key, values in data.items():
        s, n = sorted(values), len(values)
        assert [out[key][c] for c in ranks] == [s[n // 2], s[n // 4], s[3 * n // 4], s[int(n * 0.95)]]


def test_without_keys(spark, data):
    out = ops.linear_quantiles(frame(spark, data).filter("k = 'few'"), [], "v", {"m": 0.5}).first()
    assert (out["_n"], out["m"]) == (3, 2.0)


def test_values_that_are_no_common_numbers(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", x) for x in (1.0, inf, -inf, nan, 2.0)] + [("b", nan)] * 3 + [(None, 4.0)] + [("c", 7.0)] * 5000
    df = spark.createDataFrame(rows, "k string, v double")
    out = {r["k"]: r["m"] for r in ops.values_at_ranks(df, ["k"], "v", {"m": ops.upper_median}).collect()}
    assert out["a"] == 2.0 and out["b"] != out["b"] and out[None] == 4.0 and out["c"] == 7.0
    ends = ops.linear_quantiles(df.filter("k = 'a'"), ["k"], "v", {"low": 0.0, "high": 1.0}).first()
    assert ends["low"] == -inf and ends["high"] != ends["high"]


def test_long_integers_and_decimals_are_exact(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big + i,) for i in range(5)], "v long")
    assert ops.values_at_ranks(df, [], "v", {"m": ops.upper_median}).first()["m"] == big + 2
    exact = df.select((F.col("v").cast("decimal(30,5)") + F.lit("0.00001").cast("decimal(30,5)")).alias("v"))
    assert str(ops.values_at_ranks(exact, [], "v", {"m": ops.upper_median}).first()["m"]) == f"{big + 2}.00001"


def test_narrowed_to_cells_equals_whole_groups(spark, data):
    inf, nan = float("inf"), float("nan")
    rows = [("odd", x) for x in (1.0, inf, -inf, nan, -2.5, 0.0, -0.0)] + [(None, -x) for x in (4.0, 4.0, 5.0)] + [("tie", 7.0)] * 3000
    rows += [("near", 1.7e9 + i / 8) for i in range(2000)] + [("none", None)]
    df = frame(spark, data).unionByName(spark.createDataFrame(rows, "k string, v double"))
    ranks = {"low": lambda n: F.lit(0), "q1": ops.index_quartile(1), "mid": ops.upper_median, "p95": ops.nearest_rank(0.95), "top": lambda n: n - 1}
    plain, narrowed = ({r["k"]: str(tuple(r)) for r in ops.values_at_ranks(df, ["k"], "v", ranks, stored).collect()} for stored in (False, True))
    assert plain == narrowed and set(plain) == {"odd", None, "tie", "near", *data}


def test_narrowed_long_integers_and_decimals_are_exact(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big + i,) for i in range(5)], "v long")
    assert ops.values_at_ranks(df, [], "v", {"m": ops.upper_median}, stored=True).first()["m"] == big + 2
    assert ops.values_at_ranks(df.filter("v < 0"), ["v"], "v", {"m": ops.upper_median}, stored=True).count() == 0


def test_totals_are_written_for_cut_groups_only(spark, data, monkeypatch):
    """Groups within one piece need no totals; one group here is cut by borders between pieces."""
    written = {}

    def counted(df, purpose):
        out = materialize(df, purpose)
        written[purpose] = out.count()
        return out

    monkeypatch.setattr(ops, "materialize", counted)
    small = spark.range(6000).select((F.col("id") % 2000).cast("string").alias("k"), F.floor(F.col("id") / 2000).cast("double").alias("v"))
    many = small.unionByName(frame(spark, {"hot": np.arange(60000.0)})).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {r["k"]: (r["_n"], r["m"]) for r in ops.linear_quantiles(many, ["k"], "v", {"m": 0.5}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.pop("hot") == (60000, 29999.5) and len(out) == 2000 and set(out.values()) == {(3, 1.0)}
    assert written["cut-groups"] < 8 and 1 < written["pieces"] < 16
