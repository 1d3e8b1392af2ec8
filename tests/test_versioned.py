import pytest
from pyspark.sql import functions as F

from tidemark.operators.versioned import Conflict, VersionedTable


@pytest.fixture
def make(spark, tmp_path):
    def build(rows, schema="id int, value string", partition_by=()):
        table = VersionedTable(spark, str(tmp_path / "t"))
        table.create(spark.createDataFrame(rows, schema), partition_by, at="2024-01-01 00:00:00")
        return table

    return build


def pairs(table, **where):
    return sorted(map(tuple, table.read(**where).collect()))


def test_append_makes_four_rows_and_two_versions(spark, make):
    t = make([(1, "a"), (2, "b")])
    t.append(spark.createDataFrame([(3, "c"), (4, "d")], "id int, value string"))
    assert t.read().count() == 4 and t.history().count() == 2


def test_update_and_delete(make):
    t = make([(1, "a"), (2, "b"), (3, None)])
    t.update({"value": F.lit("z")}, F.col("id") == 1)
    assert pairs(t)[0] == (1, "z")
    t.delete(F.col("value") == "b")
    assert pairs(t) == [(1, "z"), (3, None)]  # a NULL condition keeps the row


def test_merge_updates_and_inserts(spark, make):
    t = make([(1, "a"), (2, "b")])
    t.merge(spark.createDataFrame([(2, "B"), (3, "C")], "id int, value string"), ["id"])
    assert pairs(t) == [(1, "a"), (2, "B"), (3, "C")]


def test_merge_refuses_a_repeated_key_and_skips_a_known_batch(spark, make):
    t = make([(1, "a")])
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([(1, "x"), (1, "y")], "id int, value string"), ["id"])
    change = spark.createDataFrame([(1, "x")], "id int, value string")
    first = t.merge(change, ["id"], batch="s-0")
    assert t.merge(spark.createDataFrame([(1, "again")], "id int, value string"), ["id"], batch="s-0") == first
    assert pairs(t) == [(1, "x")]


def test_merge_expressions_see_both_sides(spark, make):
    t = make([(1, "a"), (2, "b")])
    t.merge(spark.createDataFrame([(2, "+")], "id int, value string"), ["id"], {"value": F.concat("t.value", "s.value")}, insert=False)
    assert pairs(t) == [(1, "a"), (2, "b+")]


def test_only_touched_partitions_are_rewritten(make):
    t = make([(1, "a"), (2, "b"), (3, "b")], partition_by=["value"])
    t.delete(F.col("id") == 3)
    last = t.entry()
    assert [x["folder"] for x in last["removed"]] == ["p0=b"]
    assert pairs(t) == [(1, "a"), (2, "b")]


def test_awkward_partition_values(make):
    t = make([(1, "a b/c"), (2, "50%"), (3, "ü:=")], partition_by=["value"])
    t.update({"id": F.col("id") + 10}, F.col("value") == "50%")
    t.delete(F.col("value") == "ü:=")
    assert pairs(t) == [(1, "a b/c"), (12, "50%")]


def test_time_travel_and_rollback(spark, make):
    t = make([(1, "a")])
    t.append(spark.createDataFrame([(2, "b")], "id int, value string"), at="2024-01-02 00:00:00")
    assert pairs(t, version=0) == [(1, "a")] and pairs(t, as_of="2024-01-01 10:00:00") == [(1, "a")]
    t.rollback(version=0)
    assert pairs(t) == [(1, "a")]
    t.cherry_pick(1)
    assert pairs(t) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        t.read(as_of="2023-01-01 00:00:00")


def test_two_writers_of_one_version(spark, make, monkeypatch):
    t = make([(1, "a")])
    stale = t.entry()
    t.append(spark.createDataFrame([(2, "b")], "id int, value string"))
    monkeypatch.setattr(t, "entry", lambda version=None: stale)
    with pytest.raises(Conflict):
        t.append(spark.createDataFrame([(3, "c")], "id int, value string"))


def test_schema_changes(spark, make):
    t = make([(1, "a")])
    t.add_column("n", "int", default="7")
    t.rename_column("value", "label")
    t.append(spark.createDataFrame([(2, "b", 1)], "id int, label string, n int"))
    assert pairs(t) == [(1, "a", 7), (2, "b", 1)]
    t.drop_column("label")
    t.add_column("label", "string")
    assert pairs(t) == [(1, 7, None), (2, 1, None)]  # a new column of an old name starts empty
    t.widen_column("n", "bigint")
    assert dict(t.read().dtypes)["n"] == "bigint"
    with pytest.raises(ValueError):
        t.widen_column("n", "int")


def test_changes_on_an_empty_partitioned_table(spark, make):
    t = make([], partition_by=["value"])
    t.update({"id": F.lit(1)}, F.col("id") == 2)
    t.merge(spark.createDataFrame([(1, "a")], "id int, value string"), ["id"])
    t.delete(F.col("id") == 1)
    assert pairs(t) == []


def test_expired_versions_cannot_be_read(spark, make):
    t = make([(1, "a")])
    t.delete(F.col("id") == 1, at="2024-01-02 00:00:00")
    t.append(spark.createDataFrame([(5, "e")], "id int, value string"), at="2024-01-03 00:00:00")
    t.expire(keep_last=1)
    assert pairs(t) == [(5, "e")]
    with pytest.raises(ValueError):
        t.read(version=0)


def test_bucket_and_day_layouts(spark, make):
    t = make([(i, f"2024-01-0{1 + i % 3}") for i in range(9)], partition_by=[("days", "value"), ("bucket", "id", 2)])
    assert t.read().count() == 9
    assert {r["partition"].split("/")[0] for r in t.partitions().collect()} == {"p0=2024-01-01", "p0=2024-01-02", "p0=2024-01-03"}
