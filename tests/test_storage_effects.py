"""Operators with effects on storage or the cache: one evaluation, dropped partitions, blocks, footers, event logs."""

import gc
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import control, governance, metrics, quality
from tidemark.sources.files import read_bytes, read_event_log
from tidemark.sources.sinks import write_line_folders


def test_gated_load_evaluates_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x * 2

    raw, path = spark.range(1000), str(tmp_path / "out")
    twice = lambda df: df.select(counted("id").alias("id"))
    out = quality.gated_load(raw, [quality.not_null("id")], twice, [quality.between("id", low=0), quality.not_null("id")], path)
    assert out.count() == 1000 and seen.value == 1000
    with pytest.raises(ValueError, match="transformed data failed: id between"):
        quality.gated_load(raw, [], twice, [quality.between("id", high=10)], path)
    with pytest.raises(ValueError, match="raw data failed: id between"):
        quality.gated_load(raw, [quality.between("id", high=10, mostly=0.5)], twice, [], path)
    assert spark.read.parquet(path).count() == 1000  # refused loads leave what was there, and nothing beside it
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    assert quality.gated_load(raw, [quality.between("id", high=990, mostly=0.9)], twice, [], path).count() == 1000
    assert quality.gated_load(raw.limit(0), [quality.not_null("id")], twice, [], path).count() == 0


def test_expired_partitions_leave_storage(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = [(1, "2024-01-01 10:00:00", "read"), (2, "2024-01-05 00:00:00", "read"), (3, "2024-01-04 23:59:59", "write")]
    governance.append_audit(spark.createDataFrame(rows, "id int, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")), path)
    gone = governance.expire_audit(spark, path, "2024-01-05")
    assert [g.split("/audit/")[1] for g in gone] == ["event_type=read/date=2024-01-01", "event_type=write/date=2024-01-04"]
    assert sorted(str(p.relative_to(path)) for p in Path(path).glob("*/*")) == ["event_type=read/date=2024-01-05"]
    assert governance.expire_audit(spark, path, "2024-01-05") == []


def test_block_checksums(spark, tmp_path):
    contents = {"a": bytes(range(256)) * 40, "b": b"", "c d%": b"x" * 1000, "e": b"y" * 1001}
    for name, content in contents.items():
        (tmp_path / f"{name}.bin").write_bytes(content)
    listed = read_bytes(spark, str(tmp_path), "*.bin").select("path", "length")
    assert listed.count() == 3  # Spark lists no empty files
    files = listed.unionAll(spark.createDataFrame([(f"file:{tmp_path}/b.bin", 0)], "path string, length long"))
    found = {r["path"].rsplit("/", 1)[1]: r["md5"] for r in governance.block_checksums(files, 1000).collect()}

    def plain(content):
        blocks = [content[i : i + 1000] for i in range(0, max(len(content), 1), 1000)]
        return hashlib.md5("".join(hashlib.md5(b).hexdigest() for b in blocks).encode()).hexdigest()

    assert len(found) == 4 and sorted(found.values()) == sorted(map(plain, contents.values()))


def test_schema_of_many_files(spark, tmp_path):
    for i in range(12):
        odd = F.col("id").cast("string") if i in (4, 7) else F.col("id")
        spark.range(3).select(odd.alias("id"), F.lit(1.5).alias("x"), *([F.lit(True).alias("new")] if i == 7 else [])).coalesce(1).write.parquet(str(tmp_path / f"f{i:02}"))
    paths = [str(tmp_path / f"f{i:02}") for i in range(12)]
    found = {(r["path"].split("/")[-2], *r[1:]) for r in governance.schema_consistency(spark, paths).collect()}
    assert found == {("f04", "id", "bigint", "string"), ("f07", "id", "bigint", "string"), ("f07", "new", "", "boolean")}


def test_event_log_of_spark(spark, tmp_path):
    start = {"Event": "SparkListenerApplicationStart", "App Name": "x", "App ID": "app-1", "Timestamp": 1_000_000, "User": "u"}
    added = [{"Event": "SparkListenerExecutorAdded", "Timestamp": t, "Executor ID": e, "Executor Info": {"Host": "h"}} for t, e in ((1_000_100, "driver"), (1_007_500, "1"), (1_003_250, "0"))]
    (tmp_path / "app-1").write_text("\n".join(map(json.dumps, [{"Event": "SparkListenerLogStart", "Spark Version": "4"}, start, *added])))
    rolled = tmp_path / "eventlog_v2_app-2"
    rolled.mkdir()
    (rolled / "events_1_app-2").write_text(json.dumps({**start, "App ID": "app-2"}))
    (rolled / "events_2_app-2").write_text(json.dumps({**added[1], "Timestamp": 1_000_000}))
    (tmp_path / "app-3").write_text(json.dumps({**start, "App ID": "app-3"}))  # never got an executor
    waits = {r["app_id"]: r["wait_seconds"] for r in metrics.resource_wait(read_event_log(spark, str(tmp_path))).collect()}
    assert waits == {"app-1": 3.25, "app-2": 0.0}


def test_caches_live_as_long_as_their_owner(spark):
    df = spark.range(100).filter("id > 5")
    kept = control.keep(df)
    result = kept.attach(kept.df.groupBy(F.col("id") % 2).count())
    assert "InMemoryRelation" in result._jdf.queryExecution().withCachedData().toString() and df.is_cached
    assert sum(r["count"] for r in result.collect()) == 94
    kept.close()
    assert not df.storageLevel.useMemory
    view = control.keep_table(spark, "tidemark_kept", "SELECT 1 AS x", lazy=True)
    result = view.attach(view.df.select("x"))
    assert spark.catalog.isCached("tidemark_kept")
    del view, result
    gc.collect()
    assert not spark.catalog.isCached("tidemark_kept")


def test_line_folders(spark, tmp_path):
    """One file per name whatever the names and the order of rows; again over the same folder; no rows."""
    rows = [(n, f"{n} line {i}") for n in ("app-1", "a/b c:%", "é", None) for i in range(3000)]
    df = spark.createDataFrame(rows, "log string, value string").repartition(7)
    for _ in range(2):
        assert write_line_folders(df, "log", "value", str(tmp_path / "logs")) == 4
    assert sorted(p.name for p in (tmp_path / "logs").rglob("*") if p.is_file()) == ["part-00000.txt"] * 4
    read = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "logs")).selectExpr("value", "_metadata.file_path AS file")
    found = {}
    for r in read.collect():
        found.setdefault(r.file, []).append(r.value)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v for m, v in rows if m == n) for n in ("app-1", "a/b c:%", "é", None))
    assert write_line_folders(df.limit(0), "log", "value", str(tmp_path / "none")) == 0
    assert read_event_log(spark, str(tmp_path / "none")).count() == 0
