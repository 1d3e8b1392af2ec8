from pyspark.sql import functions as F

from tidemark.operators import quality as ops


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, amount double")


def test_empty_input(spark):
    empty = frame(spark, [])
    assert ops.load_gate(empty, "amount", "id").first()["verdict"] == "pass"
    assert ops.composite_gate(empty.withColumn("ts", F.lit(None).cast("timestamp_ntz")), "id", "ts", "2024-01-01").first()["verdict"] == "empty"
    assert all(r["success"] for r in ops.run_suite(empty, [ops.not_null("id"), ops.between("amount", 0, 1, mostly=0.5)]).collect())


def test_load_gate(spark):
    assert ops.load_gate(frame(spark, [(1, None), (2, 1.0)]), "amount", "id").first()["verdict"] == "null amounts"
    bad = ops.load_gate(frame(spark, [(1, -1.0), (1, 5.0)]), "amount", "id").first()
    assert bad["verdict"] == "negative amounts" and bad["duplicate_ids"] == 1


def test_gated_load_stops_before_writing(spark, tmp_path):
    path = str(tmp_path / "out")
    good, bad = frame(spark, [(1, 2.0)]), frame(spark, [(None, 2.0)])
    assert ops.gated_load(good, [ops.not_null("id")], lambda d: d, [], path).count() == 1
    try:
        ops.gated_load(bad, [ops.not_null("id")], lambda d: d, [], path)
        raise AssertionError("must fail")
    except ValueError as exc:
        assert "id not null" in str(exc)
    assert spark.read.parquet(path).count() == 1


def test_gate_levels(spark):
    rows = [(99.95, 99.6, 0.5), (99.5, 99.5, 3.0), (96.0, 96.0, 20.0), (99.95, 99.6, 30.0)]
    df = spark.createDataFrame(rows, "c double, a double, l double")
    out = [r[0] for r in df.select(ops.gate_level(F.col("c"), F.col("a"), F.col("l"))).collect()]
    assert out == ["production", "staging", "development", "failed"]


def test_composite_gate_verdicts(spark):
    df = frame(spark, [(1, 1.0)]).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert ops.composite_gate(df, "id", "ts", "2024-01-01 10:00:00").first()["verdict"] == "pass"
    assert ops.composite_gate(df, "id", "ts", "2024-01-03").first()["verdict"] == "stale"
    assert ops.composite_gate(df, "key", "ts", "2024-01-03").first()["verdict"] == "missing column key"
