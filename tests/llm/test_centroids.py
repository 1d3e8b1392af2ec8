"""Clusters against plain k-means with whole numbers, and the search against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from samples import CLASHING

from tidemark.llm import centroids

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])


def table(spark, rows, extra=()):
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in extra])


def plain(rows, dimensions, k, rounds, scale=1024):
    """(vec_id, cluster, distance) and centroids, with Python's whole numbers."""
    good = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(good, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c)) for _, v in good]

    for _ in range(rounds):
        now = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, to) in zip(good, now) if to == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(good, assign())), key=str), c


def clouds(rng, n, dimensions, groups=6):
    middles = [[rng.gauss(0, 1) for _ in range(dimensions)] for _ in range(groups)]
    return [(i, [m + rng.gauss(0, 0.3) for m in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("seed, dimensions, k, rounds", [(1, 5, 7, 6), (2, 1, 4, 10), (3, 3, 1, 2), (4, 2, 30, 4)])
def test_against_plain_k_means(spark, seed, dimensions, k, rounds):
    rows = clouds(random.Random(seed), 300, dimensions)
    found, middles = centroids.fit(table(spark, rows, CLASHING).repartition(3), dimensions=dimensions, k=k, rounds=rounds)
    want, c = plain(rows, dimensions, k, rounds)
    assert sorted([tuple(r) for r in found.collect()], key=str) == want
    assert middles.tolist() == c


def test_ties_and_repeated_rows(spark):
    """Few distinct vectors on a grid: equal centroids, equal distances, a row that is a third of the table."""
    rng = random.Random(7)
    rows = [(i, [float(rng.randrange(3)), float(rng.randrange(3))]) for i in range(120)] + [(5, [1.0, 1.0])] * 60
    found, middles = centroids.fit(table(spark, rows), dimensions=2, k=9, rounds=5)
    want, c = plain(rows, 2, 9, 5)
    assert sorted([tuple(r) for r in found.collect()], key=str) == want and middles.tolist() == c


def test_odd_rows(spark):
    good = [0.5] * 64
    rows = [(1, good), (2, None), (3, []), (4, [0.1] * 63), (5, [None] + [0.1] * 63), (6, [math.nan] + [0.1] * 63), (7, [math.inf] + [0.1] * 63), (None, [-0.0005] * 64), (8, [0.0] * 64), (1, good)]
    out = {(r.vec_id, r.distance) for r in centroids.report(table(spark, rows, CLASHING)).collect()}
    assert out == {(1, 0), (None, 0), (8, 0)}
    assert centroids.report(table(spark, rows[1:7])).collect() == []
    assert centroids.report(table(spark, rows).limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large"):
        centroids.report(table(spark, [(1, [1e30] * 64)])).collect()


def test_search_equals_all_distances_and_takes_fewer():
    rng = np.random.default_rng(3)
    for k in (2, 3, 20, 100):
        x = rng.integers(-400, 400, (2000, 4)) + rng.integers(-5, 6, (2000, 1)) * 2000
        c = x[rng.choice(len(x), k, replace=False)].copy()
        c[-1] = c[0]  # equal centroids
        before = centroids.Shallot(c)
        a, b, da, db = before.all(x)
        upper, lower = before.bounds(da, db)
        moved = rng.integers(-30, 31, c.shape)
        moved[rng.random(k) < 0.5] = 0
        search, plain_ = centroids.Shallot(c + moved), centroids.Shallot(c + moved)
        length = np.sqrt((moved**2).sum(axis=1)) * (1 + centroids.SLACK)
        got = search.step(x, a, b, upper, lower, length)
        want = plain_.all(x)
        assert (got[0] == want[0]).all()
        assert (got[2] >= np.sqrt(want[2]) * (1 - 1e-8)).all() and (got[3] <= np.sqrt(want[3]) * (1 + 1e-8)).all()  # bounds hold
        full = search.search(x, a, b)
        assert (full[0] == want[0]).all() and (full[2] == want[2]).all() and (full[3] == want[3]).all()
        if k >= 20:
            assert search.compared < plain_.compared


def test_vectors_stay_in_their_buckets(spark):
    rows = table(spark, clouds(random.Random(1), 200, 4)).select(F.monotonically_increasing_id().alias("uid"), "vec_id", centroids.whole_numbers("embedding", 4, 1024).alias("v"))
    name = centroids._bucketed(rows, 4)
    state = rows.select("uid", *[F.lit(0).alias(c) for c in "ab"], F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower")).repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = centroids._known(spark.table(name), state)
        assert joined.count() == 200
        plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
    left = plan.split("Scan parquet spark_catalog")[0]
    assert plan.count("hashpartitioning(uid") == 1 and "Bucketed: true" in plan and "hashpartitioning" not in left
