"""Cut windows against plain windows, with a key that holds most rows, NULL keys and ties."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.piecewise import PART, piecewise_frame, piecewise_windows, pieces_of, spread, stitched_sessions


def skewed(spark, n=600, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot", "hot", "hot", "a", None])
        value = rng.choice([None, float(rng.randint(1, 50))])
        rows.append((key, rng.randint(0, 60), i, value))
    return spark.createDataFrame(rows, "k string, t int, id int, v double")


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def plain(df):
    w = Window.partitionBy("k").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ties = Window.partitionBy("k").orderBy("t")
    return df.select(
        "*", F.row_number().over(w).alias("rn"), F.rank().over(ties).alias("rk"), F.dense_rank().over(ties).alias("dr"),
        F.sum("v").over(upto).alias("s"), F.avg("v").over(upto).alias("m"), F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"),
    )


OPTIONS = dict(
    row_number="rn", rank="rk", dense_rank="dr", rank_by=["t"], running_sum={"s": "v"}, running_avg={"m": "v"}, prev={"p": "v"}, next={"n": "v"}
)


def test_windows_equal_plain_windows(spark):
    df = skewed(spark)
    for width in (1, 7, 1000):
        cut = piecewise_windows(df, ["k"], F.floor(F.col("t") / width), ["t", "id"], **OPTIONS)
        same(cut, plain(df))


def test_only_wanted_pieces_are_returned(spark):
    df, piece = skewed(spark), F.floor(F.col("t") / 5)
    wanted = pieces_of(df.filter("t BETWEEN 20 AND 24 OR k = 'a' AND t < 5"), ["k"], piece)
    cut = piecewise_windows(df, ["k"], piece, ["t", "id"], only=wanted, **OPTIONS)
    keep = F.expr("(t BETWEEN 20 AND 24) OR (k = 'a' AND t < 5)")
    kept = plain(df).filter(keep)
    same(cut.filter(keep), kept)
    assert cut.count() == kept.count()


def test_frame_equals_plain_frame(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    for before, after in ((3, 0), (2, 2), (0, 5), (10, 1)):
        want = df.select("*", F.sum("v").over(w.rowsBetween(-before, after)).alias("s"), F.count("v").over(w.rowsBetween(-before, after)).alias("c"))
        for width in (1, 4, 1000):
            got = piecewise_frame(df, ["k"], F.floor(F.col("t") / width), ["t", "id"], before, after, {"s": F.sum("v"), "c": F.count("v")})
            same(got, want)


def test_totals_and_rows_share_one_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderstatus", "o_orderdate", "o_orderkey", "o_totalprice")
    order = ["o_orderdate", "o_orderkey"]
    cut = piecewise_windows(df, ["o_orderstatus"], F.year("o_orderdate"), order, row_number="rn", running_sum={"s": "o_totalprice"})
    cut.collect()
    final = cut._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


def test_sessions_cross_midnight(spark):
    rows = [(1, "2024-01-01 23:50:00"), (1, "2024-01-02 00:15:00"), (1, "2024-01-02 00:46:00"), (1, "2024-01-05 00:00:00"), (2, "2024-01-01 10:00:00")]
    df = spark.createDataFrame(rows, "u int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = {(r["u"], r["session_id"]): r["event_count"] for r in stitched_sessions(df, "u", "ts", "30 MINUTES").collect()}
    assert out == {(1, 0): 2, (1, 1): 1, (1, 2): 1, (2, 0): 1}


def test_frame_of_some_pieces_only(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("t"), (F.col("id") % 7).alias("v"))
    piece = F.floor(F.col("t") / 100)
    every = piecewise_frame(df, ["k"], piece, ["t"], 3, 1, {"s": F.sum("v")})
    some = piecewise_frame(df, ["k"], piece, ["t"], 3, 1, {"s": F.sum("v")}, only=pieces_of(df.filter("t = 450"), ["k"], piece))
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in every.collect() if 400 <= r["t"] < 500)


def largest_task(df):
    """Rows of the largest (key, piece, part) against the row count."""
    return df.groupBy("k", "_part").count().agg(F.max("count")).first()[0]


def test_spread_pieces_equal_plain_windows(spark):
    df = skewed(spark)
    for width, rows in ((7, 20), (1000, 60)):
        piece = F.floor(F.col("t") / width)
        cut = spread(df, ["k"], piece, ["t", "id"], rows)
        assert PART in cut.columns
        same(piecewise_windows(cut, ["k"], piece, ["t", "id"], **OPTIONS), plain(df))
        wanted = pieces_of(df.filter("t < 7"), ["k"], piece)
        some = piecewise_windows(cut, ["k"], piece, ["t", "id"], only=wanted, **OPTIONS)
        sums = piecewise_windows(cut, ["k"], piece, ["t", "id"], only=wanted, running_sum={"s": "v"})
        first = F.expr(f"t < {width}")
        same(some.filter(first), plain(df).filter(first))
        same(sums.filter(first).select("id", "s"), plain(df).filter(first).select("id", "s"))


def test_spread_frames_equal_plain_frames(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    piece = F.floor(F.col("t") / 30)
    cut = spread(df, ["k"], piece, ["t", "id"], 4)
    for before, after in ((10, 1),):
        want = df.select("*", F.sum("v").over(w.rowsBetween(-before, after)).alias("s"))
        same(piecewise_frame(cut, ["k"], piece, ["t", "id"], before, after, {"s": F.sum("v")}), want)


def test_small_pieces_are_left_alone(spark):
    df = skewed(spark)
    assert spread(df, ["k"], F.col("t"), ["t", "id"], 10_000).columns == df.columns
    empty = df.limit(0)
    assert spread(empty, ["k"], F.col("t"), ["t", "id"], 1).columns == df.columns


def test_hot_day_and_hot_value_spread_over_tasks(spark):
    hot = spark.range(200_000).select(F.lit("hot").alias("k"), F.lit(5).alias("t"), (F.col("id") % 3).alias("v"))  # all in one piece, equal rows
    cut = spread(hot, ["k"], F.col("t"), ["t", "v"], 10_000)
    assert largest_task(cut) <= 30_000 and cut.select(PART).distinct().count() >= 15
    out = piecewise_windows(cut, ["k"], F.col("t"), ["t", "v"], row_number="rn", rank="rk", dense_rank="dr", rank_by=["t", "v"])
    found = out.groupBy("v").agg(F.min("rk").alias("lo"), F.max("rk").alias("hi"), F.min("dr").alias("d"), F.max("dr").alias("e")).orderBy("v").collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 1, 1), (1, 66668, 66668, 2, 2), (2, 133335, 133335, 3, 3)]
    assert out.agg(F.countDistinct("rn"), F.max("rn")).first() == (200_000, 200_000)


def test_hot_user_sessions(spark):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.when(F.col("id") < 5000, F.lit(0)).otherwise(F.floor(F.col("id") / 2500) * 1000)  # many equal times, silences of 1000 s
    df = spark.range(20_000).select(F.lit(1).alias("u"), (start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("ts"))
    whole = stitched_sessions(df, "u", "ts", "15 MINUTES")
    for rows in (300, 2500):
        same(stitched_sessions(df, "u", "ts", "15 MINUTES", rows_per_piece=rows), whole)
    assert whole.count() > 3
