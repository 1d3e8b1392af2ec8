from pyspark.sql import functions as F

from tidemark.operators import learning as ops


def test_rows_are_spread_over_cores_before_a_fit(spark):
    """One file or row group, one partition: a tree model would be fitted by one core."""
    rows = spark.range(25000).coalesce(1)
    spread = ops.spread_rows(rows, "id")
    assert spread.rdd.getNumPartitions() == 5 and spread.distinct().count() == 25000
    assert min(spread.rdd.mapPartitions(lambda i: [sum(1 for _ in i)]).collect()) > 4000
    assert ops.spread_rows(rows.limit(5000).coalesce(1), "id").rdd.getNumPartitions() == 1
    assert ops.spread_rows(spark.range(60000), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_forests_of_the_grid_keep_the_nodes_of_their_rows(spark):
    """Rows are not walked down from the root at every level; the trees are those that walking gives."""
    rows = spark.range(600).select(F.rand(3).alias("a"), F.rand(4).alias("b")).selectExpr("a", "b", "CAST(a + b * b + (a * 7919) % 0.6 > 1 AS DOUBLE) AS label")
    rows = ops._assembled(rows, ["a", "b"]).coalesce(1)
    forest = ops.tuned_classifier("rf", trees=6).getEstimator()
    assert forest.getCacheNodeIds()
    grown = [forest.copy({forest.cacheNodeIds: keep, forest.maxDepth: 8}).fit(rows).toDebugString.split("\n", 1)[1] for keep in (True, False)]
    assert grown[0] == grown[1] and grown[0].count("If") > 60
