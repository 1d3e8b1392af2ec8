import pytest
from pyspark.sql import functions as F

from tidemark.session import shared_folder
from tidemark.sources import files, generate, jdbc


def test_shared_folder_is_the_session_setting(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_drifting_files(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "zone bigint, n int").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(3, 1.5)], "zone int, fee double").write.parquet(str(tmp_path / "b"))
    skipped = []
    out = files.read_drifting(spark, [str(tmp_path / p) for p in ("a", "gone", "b")], {"zone": "int"}, lambda p, e: skipped.append(p))
    assert sorted(map(tuple, out.select("zone", "n", "fee").collect())) == [(1, 2, None), (3, None, 1.5)]
    assert skipped == [str(tmp_path / "gone")]
    with pytest.raises(ValueError):
        files.read_drifting(spark, [str(tmp_path / "gone")])


def test_schema_from_json(spark):
    schema = spark.createDataFrame([], "a int, m map<string,string>").schema
    assert files.schema_from_json(schema.json()) == schema


def test_malformed_message_gives_a_row_of_nulls(spark):
    raw = spark.createDataFrame([(b'{"id": 1}',), (b"{oops",)], "value binary")
    out = files.parse_events(raw, "id INT").select("id").collect()
    assert sorted((r["id"] for r in out), key=str) == [1, None]


def test_generated_ranges(spark):
    n = 1000
    ids = generate.id_range(spark, n)
    assert ids.agg(F.sum("id")).first()[0] == n * (n - 1) // 2
    assert generate.id_range(spark, n, mode="nulls").filter("value IS NULL").count() == 10
    assert generate.id_range(spark, n, mode="skew").select("skew_key").distinct().count() == 10
    with pytest.raises(ValueError):
        generate.id_range(spark, n, mode="other")


def test_synthetic_trips(spark):
    trips = generate.synthetic_trips(spark, 2000, "2024-02-01")
    out = trips.selectExpr(
        "count(*) n", "min(pickup_ts) >= timestamp'2024-02-01' lo", "max(pickup_ts) < timestamp'2024-03-01' hi", "min(passengers) a",
        "max(passengers) b", "min(unix_timestamp(dropoff_ts) - unix_timestamp(pickup_ts)) short", "max(unix_timestamp(dropoff_ts) - unix_timestamp(pickup_ts)) far",
        "min(distance) >= 0.5 dist", "max(abs(total - fare - tip - extra - mta_tax - tolls - improvement - congestion)) < 1e-9 adds", "max(tip / fare) <= 0.3 tips",
    ).first()
    assert out["n"] == 2000 and out["lo"] and out["hi"] and out["dist"] and out["adds"] and out["tips"]
    assert out["a"] == 1 and out["b"] <= 6 and out["short"] >= 300 and out["far"] < 1800


def test_jdbc_options():
    conn = jdbc.connection("postgres", "db", "sales", "u", "p")
    assert conn["url"] == "jdbc:postgresql://db:5432/sales"
    with pytest.raises(ValueError):
        jdbc.connection("mystery", "db", "sales", "u", "p")
    assert jdbc.source_options(query="SELECT 1")["dbtable"] == "(SELECT 1) AS pushed"
    with pytest.raises(ValueError):
        jdbc.source_options()
    assert jdbc.partition_options("id", 1, 900, 4)["numPartitions"] == "4"
    assert jdbc.partition_options("id", None, None, 4) == {}
    assert [jdbc.batch_size(n) for n in (999, 1000, 9999, 10_000, 99_999, 100_000)] == [100, 1000, 1000, 5000, 5000, 10_000]
    assert jdbc.write_options("t", 500)["batchsize"] == "100"
