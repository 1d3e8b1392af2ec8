"""Boosted daily models: against a plain tree search, held-out error, odd groups and reruns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.boosting import Trees, boosted_daily


def plain_split(x, y):
    """The best single split by trying every middle between neighbouring values: (feature, border, gain)."""
    best = (None, None, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for border in (values[1:] + values[:-1]) / 2:
            left, right = y[x[:, f] <= border], y[x[:, f] > border]
            gain = ((y - y.mean()) ** 2).sum() - ((left - left.mean()) ** 2).sum() - ((right - right.mean()) ** 2).sum()
            if gain > best[2] + 1e-9:
                best = (f, border, gain)
    return best


def plain_tree(x, y, depth):
    f, border, _ = plain_split(x, y)
    if depth == 0 or f is None:
        return lambda row: y.mean()
    left, right = (plain_tree(x[m], y[m], depth - 1) for m in (x[:, f] <= border, x[:, f] > border))
    return lambda row: left(row) if row[f] <= border else right(row)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees_equal_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 9, (60, 3)).astype(float), rng.normal(size=60)
    got = Trees(rounds=3, depth=3, step=0.5).fit(x, y).predict(x)
    want = np.full(60, y.mean())
    for _ in range(3):
        tree = plain_tree(x, y - want, 3)
        want = want + 0.5 * np.array([tree(row) for row in x])
    assert np.allclose(got, want)


def test_more_values_than_bins_and_constant_columns():
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=2000), np.ones(2000)], axis=1)
    y = np.sin(3 * x[:, 0]) + 0.1 * rng.normal(size=2000)
    model = Trees(200, 6, 0.05).fit(x[:1500], y[:1500])
    assert np.var(y[1500:] - model.predict(x[1500:])) < 0.1 * np.var(y[1500:])
    assert np.allclose(Trees(5, 3, 0.1).fit(x[:, 1:], np.full(2000, 7.0)).predict(x[:3, 1:]), 7.0)


def daily(spark):
    days = spark.range(400).select(F.col("id").cast("int").alias("day"), (F.col("id") % 7).alias("weekday"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("gaps"))
    names = F.explode(F.array(*[F.lit(n) for n in ("a", "b", "Unknown")])).alias("zone")
    rows = days.select("*", names).withColumn("money", F.col("weekday") * 10 + F.coalesce("gaps", F.lit(0)) + F.when(F.col("zone") == "a", 100).otherwise(0))
    few = spark.createDataFrame([(i, i % 7, None, "few", 1) for i in range(50)], "day int, weekday long, gaps long, zone string, money long")
    part = F.when(F.col("day") < 300, "train").when(F.col("day") < 390, "test").otherwise("future")
    return rows.unionByName(few).withColumn("part", part).withColumn("money", F.when(F.col("part") != "future", F.col("money")))


def test_groups_are_fitted_alike_and_skipped(spark):
    out = boosted_daily(daily(spark), "zone", "day", "part", ["weekday", "gaps"], {"m": "money"}).cache()
    assert {r[0]: r[1] for r in out.groupBy("zone").count().collect()} == {"a": 400, "b": 400}
    assert out.filter("part = 'future' AND actual IS NULL AND prediction IS NOT NULL").count() == 20
    assert out.filter("part = 'test'").agg(F.max(F.abs(F.col("actual") - F.col("prediction")))).first()[0] < 1.0
    again = boosted_daily(daily(spark).repartition(5), "zone", "day", "part", ["weekday", "gaps"], {"m": "money"})
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, out.collect()), key=str)
    out.unpersist()


def test_empty_table_and_no_training_rows(spark):
    rows = daily(spark)
    for odd in (rows.limit(0), rows.filter("part <> 'train'")):
        assert boosted_daily(odd, "zone", "day", "part", ["weekday", "gaps"], {"m": "money"}, min_rows=1).count() == 0
