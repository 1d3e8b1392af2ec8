"""WARC archives: round trips, revisits, predicates that reach the reader, archives of others."""

import base64
import gzip
import hashlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from samples import CLASHING, plain

from tidemark.llm import warc

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def pages(spark, rows, extra=()):
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in extra])


def expected(rows):
    """By the definition: per payload the largest id answers for all."""
    top = {}
    for i, _, html in rows:
        top[html or ""] = max(top.get(html or "", -(10**9)), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        again = top[html or ""] != i
        out.append((i, len(body), digest, "revisit" if again else "response", top[html or ""] if again else None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", "same page" if i % 3 == 0 else rng.choice(["", None, f"<p>{rng.randrange(40)} é😀</p>", f"own {i}\r\n\r\nWARC/1.1\r\n"])) for i in range(600)]
    rng.shuffle(rows)
    got = [tuple(r) for r in warc.report(pages(spark, rows, CLASHING).repartition(5)).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_shuffled_revisits_agree_with_sent_ones(spark, monkeypatch):
    rows = [(i, None, f"text {i % 7}") for i in range(100)]
    monkeypatch.setattr(warc, "SENT_ROWS", 0)
    assert sorted([tuple(r) for r in warc.report(pages(spark, rows)).collect()], key=str) == expected(rows)


def test_odd_rows(spark):
    long_page = "<p>" + "word " * 400_000 + "</p>"
    rows = [(None, None, None), (None, "u", "a"), (3, "http://a b\r\nX: 1", "a"), (4, "é%41", long_page), (5, "", ""), (6, "u", "b"), (6, "u", "b"), (6, "v", "b")]
    out = plain(warc.report(pages(spark, rows, CLASHING)), "page_id", "payload_bytes", "record_type", "refers_to")
    assert out == sorted(
        [(None, 0, "revisit", 5), (None, 1, "revisit", 3), (3, 1, "response", None), (4, len(long_page), "response", None), (5, 0, "response", None), (6, 1, "response", None), (6, 1, "revisit", 6), (6, 1, "revisit", 6)],
        key=lambda r: tuple((x is not None, x) for x in r),
    )
    assert warc.report(pages(spark, rows[:1]).limit(0)).collect() == []


def test_small_payloads_stay_responses_below_the_least_size(spark, tmp_path):
    warc.write(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), str(tmp_path / "w"), least=3)
    got = {r.source_id: (r.record_type, r.payload, r.refers_to_source) for r in warc.read(spark, str(tmp_path / "w")).filter("record_type <> 'warcinfo'").collect()}
    assert got == {"1": ("response", b"ab", None), "2": ("response", b"ab", None), "3": ("revisit", None, "4"), "4": ("response", b"abc", None)}


def test_revisits_name_the_record_they_repeat(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.write(pages(spark, [(i, f"http://h/{i}", f"t{i % 3}") for i in range(30)]), folder, file_bytes=2000)
    rows = {r.record_id: r for r in warc.read(spark, folder).filter("record_type <> 'warcinfo'").collect()}
    assert len(rows) == 30 and sum(r.record_type == "response" for r in rows.values()) == 3
    for r in rows.values():
        if r.record_type == "revisit":
            top = rows[r.refers_to]
            assert top.record_type == "response" and top.payload_digest == r.payload_digest and r.headers["warc-profile"] == warc.PROFILE
            assert int(top.source_id) > int(r.source_id) and r.payload_bytes == top.payload_bytes
    for name in os.listdir(folder):  # any reader of gzip sees the same bytes
        if name.endswith(".gz"):
            text = gzip.decompress(open(os.path.join(folder, name), "rb").read())
            assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.endswith(b"\r\n\r\n")


def test_predicates_reach_the_reader(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.write(pages(spark, [(i, f"http://{'a' if i % 2 else 'b'}.example/{i}", f"t{i % 9}") for i in range(90)]), folder)
    whole = warc.read(spark, folder).cache()
    tests = [
        "record_type = 'response'", "record_type IN ('revisit', 'warcinfo')", "target_uri LIKE 'http://a.%'", "record_type <> 'response' AND target_uri LIKE '%7'",
        "refers_to IS NULL", "refers_to IS NOT NULL AND content_length > 3", "NOT (target_uri LIKE '%example%')", "target_uri <=> 'http://b.example/4'", "content_length <= 80",
    ]
    for test in tests:
        df = warc.read(spark, folder).filter(test)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Filter " not in plan, test
        assert plain(df, "record_id", "payload") == plain(whole.filter(test), "record_id", "payload"), test
    mixed = warc.read(spark, folder).filter("payload_bytes = 2 AND record_type = 'response' AND length(target_uri) > 5")
    assert mixed.count() == 9 and "record_type" not in mixed._jdf.queryExecution().executedPlan().toString().split("Filter")[1].split("BatchScan")[0]
    whole.unpersist()


class Counting(io.BytesIO):
    """A file that knows how much of it was read."""

    count = 0

    def read(self, n=-1):
        out = super().read(n)
        self.count += len(out)
        return out


def _archive(packed, sizes=(4_000_000, 10, 4_000_000, 10)):
    rng = random.Random(1)
    out, bodies = [], []
    for k, n in enumerate(sizes):
        bodies.append(rng.randbytes(n))
        out.append(warc.record([("WARC-Type", "resource" if n > 100 else "metadata"), ("WARC-Record-ID", f"<urn:x:{k}>"), ("Content-Type", "application/octet-stream")], bodies[-1]))
    return b"".join(map(packed, out)), bodies


@pytest.mark.parametrize("packed", [warc.member, bytes])
def test_unwanted_payloads_are_not_read(packed):
    data, bodies = _archive(packed)
    file = Counting(data)
    got = [r["payload"] for r in warc.records(file, packed is warc.member, lambda r: r["record_type"] == "metadata")]
    assert got == [bodies[1], bodies[3]]
    assert file.count < len(data) // 4


@pytest.mark.parametrize("shape", ["plain", "sized members", "members", "one member"])
def test_archives_of_others(spark, tmp_path, shape):
    data, bodies = _archive({"sized members": warc.member, "members": gzip.compress}.get(shape, bytes), (300_000, 5, 0, 70_000))
    name = "x.warc" if shape == "plain" else "x.warc.gz"
    (tmp_path / name).write_bytes(gzip.compress(data) if shape == "one member" else data)
    (tmp_path / "notes.txt").write_text("no archive")
    rows = {r.record_id: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert [rows[f"<urn:x:{k}>"].payload for k in range(4)] == [bytearray(b) for b in bodies]
    assert [r.payload for r in warc.read(spark, str(tmp_path)).filter("record_id = '<urn:x:3>'").collect()] == [bodies[3]]
    lean = warc.read(spark, str(tmp_path), payload=False).collect()
    assert sorted((r.record_id, r.payload, r.payload_bytes) for r in lean) == [(f"<urn:x:{k}>", None, len(b)) for k, b in enumerate(bodies)]


def test_damage_is_an_error_and_uncommitted_files_are_not_read(spark, tmp_path):
    data, _ = _archive(warc.member, (1000,))
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(data[:-200]), True))
    bad = warc.record([("WARC-Type", "resource"), ("WARC-Payload-Digest", "sha1:" + warc.base32(hashlib.sha1(b"x").digest()))], b"y")
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(io.BytesIO(bad), False, verify=True))
    folder = tmp_path / "w"
    warc.write(pages(spark, [(1, "u", "a")]), str(folder))
    (folder / "left-by-a-lost-task.warc.gz").write_bytes(data[:-200])
    assert warc.read(spark, str(folder)).filter("record_type = 'response'").count() == 1
    warc.write(pages(spark, [(2, "u", "b")]), str(folder))
    assert warc.read(spark, str(folder)).filter("record_type = 'response'").count() == 2


def test_files_are_planned_by_size(tmp_path):
    for k in range(10):
        (tmp_path / f"{k}.warc").write_bytes(b"x" * 100)
    plan = warc.WarcReader({"path": str(tmp_path), "partition_bytes": 250}).partitions()
    assert [len(p.value) for p in plan] == [2] * 5
