"""What used to end at a fixed number, and rows at the edges."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.scoring import score, score_batches
from tidemark.operators import governance, joins, metrics, sets
from tidemark.session import scratch_path
from tidemark.streaming import runs


def test_deep_hierarchies_are_whole(spark):
    nodes = spark.createDataFrame([(f"n{i:03d}", f"n{i - 1:03d}" if i else None) for i in range(150)], "id string, parent string").coalesce(1)
    levels = {r.id: r.level for r in sets.levels(nodes, "id", "parent").collect()}
    assert levels == {f"n{i:03d}": i + 1 for i in range(150)}
    assert sets.descendants(nodes, "id", "parent", "n110").count() == 40


def test_cycles_end(spark):
    nodes = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("r", None)], "id string, parent string")
    assert sorted(r.id for r in sets.descendants(nodes, "id", "parent", "a").collect()) == ["a", "b", "c"]
    assert [r.id for r in sets.levels(nodes, "id", "parent").collect()] == ["r"]


def test_long_lineage_is_whole(spark):
    edges = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(60)], "source string, target string").coalesce(1)
    hops = {r.node: r.hops for r in governance.downstream(edges, "t0").collect()}
    assert hops == {f"t{i}": i for i in range(61)}


def test_progress_holds_every_batch(spark):
    path, out, offsets = (scratch_path(spark, p) for p in ("many", "out", "offsets"))
    for i in range(2):
        spark.range(600).repartition(60).write.mode("append").parquet(path)
    with runs.progress_log(spark) as log:
        query = runs.to_parquet(runs.parquet_stream(spark, path, spark.range(1).schema, files_per_batch=1), out, offsets)
        query.awaitTermination()
        rows = log.table(spark, query).collect()
    files = len({r.file for r in spark.read.parquet(path).select(F.input_file_name().alias("file")).collect()})
    assert len([r for r in rows if r.input_rows]) == files > 100 and sum(r.input_rows for r in rows) == 1200


def test_an_empty_last_batch_is_the_last(spark):
    path = scratch_path(spark, "batches")
    handle = runs.batch_folders(path)
    handle(spark.range(3), 0)
    handle(spark.range(3).filter("id > 5"), 1)
    assert runs.last_batch(spark, path).count() == 0


def test_text_keys_may_be_null(spark):
    facts = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "row long, k string")
    lookup = spark.createDataFrame([("a", 10), (None, 99)], "k string, v long")
    got = sorted((r["row"], r["v"]) for r in joins.left_join_spreading_nulls(facts, lookup, "k", ["row"]).select("row", "v").collect())
    assert got == [(1, 10), (2, None), (3, None)]


def test_null_keys_have_no_pairs(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:09"), (None, "2024-01-01 00:00:00")], "k string, t string")
    rows = joins.self_join_summary(df.withColumn("t", F.col("t").cast("timestamp")), "k", "t").collect()
    assert [(r["k"], r["pairs"], r["max_diff_sec"]) for r in rows] == [("a", 4, 9)]


def test_null_amounts_have_no_score(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [250.0, None], "t": ["GOLD", "GOLD"]})).replace(float("nan"), None)
    row = df.select(score_batches("a", "t").alias("x"), score(F.col("a"), F.col("t")).alias("y")).collect()
    assert [(r.x, r.y) for r in row] == [(6, 6), (None, None)]


def test_equal_differences_are_significant(spark):
    df = spark.createDataFrame([("x", 1.0, 3.0), ("x", 2.0, 4.0), ("x", 5.0, 7.0), ("y", 1.0, 1.0), ("y", 2.0, 2.0)], "k string, a double, b double")
    got = {r["k"]: r["p_value"] for r in metrics.paired_t(df, ["k"], "a", "b").collect()}
    assert got["x"] == 0.0
