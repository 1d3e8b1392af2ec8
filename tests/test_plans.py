"""Plan shapes: pushed filters, pruned columns and partitions, no shuffle where none is needed."""

import uuid

from pyspark.sql import functions as F

from tidemark.operators.control import plan_text
from tidemark.operators.windows import top_per_group
from tidemark.plans import QUERIES
from tidemark.sources import files, sinks

SF = "/root/testdata/sf0.001"


def test_filter_reaches_the_scan_and_columns_are_pruned(spark):
    text = plan_text(QUERIES["flt_06_count_matching"](spark, SF))
    assert "GreaterThan(l_extendedprice,0.0)" in text
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in text


def test_partition_filters(spark, tmp_path):
    base = str(tmp_path / "calendar")
    sinks.write_by_calendar(spark.read.parquet(f"{SF}/orders.parquet"), "o_orderdate", base)
    text = plan_text(files.read_partitions(spark, base).filter((F.col("year") == 1997) & (F.col("month") == 2)))
    assert "PartitionFilters: [isnotnull(year" in text.replace("\n", "")


def test_bucketed_join_has_no_shuffle(spark, tmp_path):
    tag = uuid.uuid4().hex[:8]
    orders = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), "l_tax")
    sinks.save_bucketed(orders, f"o_{tag}", "k", 4, str(tmp_path / "o"))
    sinks.save_bucketed(lines, f"l_{tag}", "k", 4, str(tmp_path / "l"))
    joined = spark.table(f"l_{tag}").join(spark.table(f"o_{tag}").hint("merge"), "k")
    assert "Exchange" not in plan_text(joined) and "SortMergeJoin" in plan_text(joined)
    assert joined.count() == 6000


def test_top_k_prunes_before_the_shuffle(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan_text(top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3))
    assert text.count("WindowGroupLimit") >= 2


def test_join_hints(spark):
    assert "ShuffledHashJoin" in plan_text(QUERIES["jn_09_shuffle_hash"](spark, SF))
    assert "SortMergeJoin" in plan_text(QUERIES["jn_10_sort_merge"](spark, SF))
    assert "BroadcastHashJoin" in plan_text(QUERIES["jn_08_broadcast_checked"](spark, SF))


def test_feature_table_reads_each_table_once(spark):
    text = QUERIES["ml_05_feature_table"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") == 2


def test_stays_in_the_jvm(spark):
    for name in ("agg_03_calendar_zone", "ml_05_feature_table", "met_06_recommendations", "gov_05_suspicious", "udf_01_score_sql_function"):
        text = plan_text(QUERIES[name](spark, SF))
        assert "EvalPython" not in text and "InPandas" not in text and "CartesianProduct" not in text, name
