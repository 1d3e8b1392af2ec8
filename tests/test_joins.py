import random

from pyspark.sql import functions as F

from tidemark.operators import joins as ops
from tidemark.operators.control import plan_text


def facts(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 99, None]), float(i)) for i in range(300)]
    return spark.createDataFrame(rows, "id int, k int, v double")


def lookup(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k int, name string")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_skew_joins_equal_the_plain_join(spark):
    f, d = facts(spark), lookup(spark)
    want = rows(f.join(d, "k"), "id", "name")
    assert rows(ops.salted_join(f, d, "k", ["id"]), "id", "name") == want
    assert rows(ops.hot_key_split_join(f, d, "k", share=0.2), "id", "name") == want
    assert rows(ops.lookup_join(f, d, "k"), "id", "name") == want


def test_a_salted_lookup_is_not_broadcast(spark, tmp_path):
    """Its size estimate leaves out the repeats, one per salt."""
    lookup(spark).write.parquet(str(tmp_path / "lookup"))
    plan = plan_text(ops.salted_join(facts(spark), spark.read.parquet(str(tmp_path / "lookup")), "k", ["id"], salts=1000))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_null_keys_are_spread_and_kept(spark):
    f, d = facts(spark), lookup(spark)
    assert rows(ops.left_join_spreading_nulls(f, d, "k", ["id"]), "id", "k", "name") == rows(f.join(d, "k", "left"), "id", "k", "name")


def test_hot_keys(spark):
    found = {r["k"] for r in ops.hot_keys(facts(spark), "k", 0.3).collect()}
    assert found == {1}


def test_broadcast_only_below_the_limit(spark):
    d = spark.range(10)
    assert ops.broadcast_if_small(d) is not d
    assert ops.broadcast_if_small(d, limit=1) is d
    unknown = lookup(spark)  # rows from the driver have no size estimate
    assert ops.broadcast_if_small(unknown) is unknown


def test_within_time_equals_brute_force(spark):
    rng = random.Random(5)
    left = [(rng.randint(0, 2), i, rng.randint(0, 3000)) for i in range(80)]
    right = [(rng.randint(0, 2), i, rng.randint(0, 3000)) for i in range(80)]
    want = sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and abs(a[2] - b[2]) <= 300)

    def frame(data, id, ts):
        return spark.createDataFrame(data, f"u int, {id} int, s int").select("u", id, F.timestamp_seconds("s").alias(ts))

    got = ops.within_time(frame(left, "a", "ta"), frame(right, "b", "tb"), "u", "ta", "tb", 300)
    assert sorted(map(tuple, got.select("a", "b").collect())) == want


def test_group_stats_join_broadcasts_small_figures(spark):
    f = facts(spark)
    joined = ops.join_group_stats(f, f.groupBy("k").agg(F.avg("v").alias("m")), ["k"])
    assert "BroadcastHashJoin" in plan_text(joined)
    assert joined.count() == f.filter("k IS NOT NULL").count()
