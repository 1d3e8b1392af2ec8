"""WARC archives as a Spark data source, with identical payloads written once.

**Writing.** Payloads are compared by their SHA-1, as archives do: of the records with equal payloads of at least ``least`` bytes one is
a ``response``, the others are ``revisit`` records (profile identical-payload-digest) that hold no payload. Digests are grouped with
map-side combine; rows meet the responses by digest in a join that Spark can split, so a payload that a third of all pages share costs no
more than others. Payloads are shuffled only if the revisits are too many to send (``SENT_ROWS``). Every task writes its own files
of records that are gzip members each, with their sizes in the member's ``sl`` field; a file gets a name that no other attempt uses, and the
commit lists the files that count, so what a lost executor began is never read.

**Reading.** ``spark.read.format("warc")`` (a ``DataSource`` in Python) plans partitions of whole files, small ones together. Predicates on the
type and the other header fields are pushed down: headers are parsed first, and a record that fails is skipped by its size, without
inflating its payload (in archives of others, which lack the ``sl`` field, it is inflated in pieces and thrown away). Options: ``payload``
(``true``; with ``false`` only headers are decoded), ``verify`` (compare decoded payloads with their digest), ``partition_bytes``.

Edge cases: a null payload is empty; equal ids with equal payloads: the row that was read first is the response; a null id is the
smallest; ids and addresses may hold any characters (control characters are percent-encoded); a null address has no
WARC-Target-URI; an empty table gives an archive without files, read as no rows; other columns are ignored. A record that is cut off is an
error that names its file and position. One record (header and payload) must fit into a task's memory.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
import operator
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tidemark.session import materialize, scratch_path

#: At most so many revisits are sent to every task to find their rows; more are joined by a shuffle.
SENT_ROWS = 100_000
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES, READ_BYTES = 1 << 28, 1 << 27, 8 << 20, 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Columns that come from header fields, and the fields.
FIELDS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "warc_date": "warc-date", "target_uri": "warc-target-uri", "source_id": "warc-source-id",
    "refers_to": "warc-refers-to", "refers_to_source": "warc-refers-to-source-id", "payload_digest": "warc-payload-digest", "content_type": "content-type",
}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", content_length long, payload_bytes long, payload binary, headers map<string,string>, file string, position long"
ARROW = pa.schema(
    [(c, pa.string()) for c in FIELDS]
    + [("content_length", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("headers", pa.map_(pa.string(), pa.string())), ("file", pa.string()), ("position", pa.int64())]
)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else f"/{uri}")


def _plain(value: str, percent: bool) -> str:
    """A header value on one line; ``percent`` keeps it reversible."""
    out = re.sub(r"[%\x00-\x1f\x7f]" if percent else r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)
    return re.sub(r"^ +| +$", lambda m: "%20" * len(m[0]), out)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# ---- records


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field ``sl`` holds its compressed and uncompressed size."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(record) + press.flush()
    size = 24 + len(body) + 8
    if max(size, len(record)) >= 1 << 32:  # the field has 32 bits
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + body + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")
    extra = b"sl" + (8).to_bytes(2, "little") + size.to_bytes(4, "little") + len(record).to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + len(extra).to_bytes(2, "little") + extra
    return head + body + zlib.crc32(record).to_bytes(4, "little") + len(record).to_bytes(4, "little")


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


class Bytes:
    """The records' bytes of a file, in order. What is skipped is not inflated if the member's size is known."""

    def __init__(self, file, packed: bool):
        self.file, self.packed = file, packed
        self.raw, self.buffer, self.at = b"", b"", 0
        self.inflate, self.left, self.ends = None, None, None  # of the open member: inflated bytes not yet handed out, and where it ends

    def _more(self) -> bool:
        """Reads on; False at the end."""
        if not self.packed:
            chunk = self.file.read(READ_BYTES)
            self.buffer += chunk
            return bool(chunk)
        while True:
            if not self.raw:
                self.raw = self.file.read(READ_BYTES)
                if not self.raw:
                    if self.inflate is not None:
                        raise EOFError("a gzip member is cut off")
                    return False
            if self.inflate is None:
                self._begin()
            out = self.inflate.decompress(self.raw, READ_BYTES)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.inflate = None
            if out:
                self.buffer += out
                return True

    def _begin(self) -> None:
        while len(self.raw) < 24 and (chunk := self.file.read(READ_BYTES)):
            self.raw += chunk
        start = self.file.tell() - len(self.raw)
        self.inflate, self.left, self.ends = zlib.decompressobj(31), None, None
        if len(self.raw) >= 24 and self.raw[3] == 4 and self.raw[12:16] == b"sl\x08\x00":
            self.ends = start + int.from_bytes(self.raw[16:20], "little")
            self.left = int.from_bytes(self.raw[20:24], "little") + len(self.buffer)

    def take(self, n: int) -> bytes:
        parts, need = [], n
        while need:
            if not self.buffer and not self._more():
                raise EOFError("a record is cut off")
            part, self.buffer = self.buffer[:need], self.buffer[need:]
            need -= len(part)
            parts.append(part)
        self._past(n)
        return b"".join(parts)

    def head(self, most: int = 1 << 20) -> bytes | None:
        """Up to the next empty line; None at the end of the file."""
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if len(self.buffer) > most:
                raise ValueError("no end of the header")
            if not self._more():
                if self.buffer.strip():
                    raise EOFError("a header is cut off")
                return None
        out, self.buffer = self.buffer[: end + 4], self.buffer[end + 4 :]
        self._past(end + 4)
        return out

    def _past(self, n: int) -> None:
        self.at += n
        if self.left is not None:
            self.left -= n

    def skip(self, n: int) -> None:
        if self.left == n and self.ends is not None:  # the rest of the member
            self.file.seek(self.ends)
            self.raw, self.buffer, self.inflate = b"", b"", None
            self._past(n)
            return
        if not self.packed and n > len(self.buffer):
            self.file.seek(n - len(self.buffer), 1)
            self.buffer = b""
            self._past(n)
            return
        while n:
            n -= len(self.take(min(n, READ_BYTES)))


def _fields(head: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(file, packed: bool, wanted=lambda row: True, payload: bool = True, verify: bool = False) -> Iterator[dict]:
    """The records that ``wanted`` (a test on the header columns) takes. Payloads of others stay packed."""
    source = Bytes(file, packed)
    while True:
        position = source.at
        head = source.head()
        if head is None:
            return
        if not head.lstrip().startswith(b"WARC/"):
            raise ValueError(f"no record at byte {position}")
        fields = _fields(head.lstrip())
        n = int(fields["content-length"])
        row = {c: fields.get(k) for c, k in FIELDS.items()} | {"content_length": n, "headers": list(fields.items()), "position": position}
        for c in ("source_id", "refers_to_source"):
            row[c] = None if row[c] is None else unquote(row[c])
        if not wanted(row):
            source.skip(n + 4)
            continue
        http = (row["content_type"] or "").startswith("application/http")
        if payload or verify:
            block = source.take(n)
            source.take(4)
            body = block[block.find(b"\r\n\r\n") + 4 :] if http else block
            top = block[: len(block) - len(body)]
        else:
            top = source.take(min(n, 1 << 14)) if http else b""
            source.skip(n - len(top) + 4 if http else n + 4)
            top, body = top[: top.find(b"\r\n\r\n") + 4], None
        size = n - len(top)
        if row["record_type"] == "revisit" and http:  # the payload is elsewhere; its size is in the HTTP header
            size = int(_fields(top).get("content-length", size))
        elif verify and (row["payload_digest"] or "").startswith("sha1:") and base32(hashlib.sha1(body).digest()) != row["payload_digest"][5:]:
            raise ValueError(f"the payload at byte {position} has another digest than its header says")
        yield row | {"payload_bytes": size, "payload": body if payload and row["record_type"] != "revisit" else None}


# ---- data source

_COMPARE = {
    ds.EqualTo: operator.eq, ds.EqualNullSafe: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt,
    ds.LessThanOrEqual: operator.le, ds.In: lambda v, x: v in x, ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: operator.contains,
}


def _test(f: ds.Filter):
    """A test on a row's header columns (True, False or None, as SQL has it), or None if the filter needs more than headers."""
    if isinstance(f, ds.Not):
        inner = _test(f.child)
        return inner and (lambda row: None if (x := inner(row)) is None else not x)
    name = getattr(f, "attribute", (None,))
    if len(name) != 1 or name[0] not in {*FIELDS, "content_length"}:
        return None
    column = name[0]
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        return lambda row: (row[column] is None) == isinstance(f, ds.IsNull)
    compare = _COMPARE.get(type(f))
    if compare is None or isinstance(f, ds.EqualNullSafe) and f.value is None:
        return None
    empty = False if isinstance(f, ds.EqualNullSafe) else None
    return lambda row: empty if row[column] is None else compare(row[column], f.value)


class WarcPartition(ds.InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.payload, self.verify = str(options.get("payload", "true")).lower() == "true", str(options.get("verify", "false")).lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self):
        fs, place = _open(self.folder)
        found = {x.base_name: x.size for x in fs.get_file_info(pafs.FileSelector(place, recursive=False)) if x.is_file}
        lists = [name for name in found if name.startswith("_files-")]
        if lists:  # written here: only what was committed counts
            names = []
            for name in lists:
                with fs.open_input_stream(f"{place}/{name}") as file:
                    names += json.loads(file.read())
        else:
            names = [x for x in found if x.endswith((".warc", ".warc.gz"))]
        parts, total = [], 0
        for name in sorted(names):
            if not parts or total + found[name] > self.partition_bytes:
                parts, total = [*parts, []], 0
            parts[-1].append(f"{place}/{name}")
            total += found[name]
        return [WarcPartition(p) for p in parts] or [WarcPartition([])]

    def read(self, partition):
        tests = [_test(f) for f in self.filters]
        fs, _ = _open(self.folder)
        rows, size = [], 0
        for path in partition.value:
            with fs.open_input_file(path) as file:
                try:
                    for row in records(file, path.endswith(".gz"), lambda row: all(t(row) is True for t in tests), self.payload, self.verify):
                        rows.append(row | {"file": path})
                        size += len(row["payload"] or b"") + 1000
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, ARROW)
                            rows, size = [], 0
                except (EOFError, ValueError, zlib.error) as e:
                    raise ValueError(f"{path}: {e}") from e
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcWriter(ds.DataSourceArrowWriter):
    """Rows (source_id, target_uri, uid, sha1 in hex, payload, refers_uid, refers_to_source) as records of one file per task, or more if it grows."""

    def __init__(self, options: dict):
        self.folder, self.date = options["path"], options.get("date") or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator):
        fs, place = _open(self.folder)
        fs.create_dir(place, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = fs.open_output_stream(f"{place}/{names[-1]}", compression=None)
                    size = out.write(member(self._info(names[-1])))
                size += out.write(member(self._record(row)))
        if out is not None:
            out.close()
        return Written(names)

    def _info(self, name: str) -> bytes:
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
        return record(fields, b"format: WARC File Format 1.1\r\n")

    def _record(self, row: dict) -> bytes:
        again = row["refers_uid"] is not None
        payload = row["payload"] or b""
        fields = [
            ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", _urn(row["uid"], row["sha1"])), ("WARC-Date", self.date),
            ("WARC-Target-URI", None if row["target_uri"] is None else _plain(row["target_uri"], False)),
            ("WARC-Source-Id", None if row["source_id"] is None else _plain(row["source_id"], True)),
            ("WARC-Payload-Digest", "sha1:" + base32(bytes.fromhex(row["sha1"]))),
            ("WARC-Profile", PROFILE if again else None), ("WARC-Refers-To", _urn(row["refers_uid"], row["sha1"]) if again else None),
            ("WARC-Refers-To-Source-Id", None if row["refers_to_source"] is None else _plain(row["refers_to_source"], True)),
            ("Content-Type", "application/http; msgtype=response"),
        ]
        return record(fields, http_head(row["payload_bytes"]) + (b"" if again else payload))

    def commit(self, messages):
        fs, place = _open(self.folder)
        fs.create_dir(place, recursive=True)
        with fs.open_output_stream(f"{place}/_files-{uuid.uuid4().hex}", compression=None) as out:
            out.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages):
        fs, place = _open(self.folder)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{place}/{name}")


def _urn(uid: int, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uid}:{sha1}')}>"


class Written(ds.WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets predicates reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- the operator


def read(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """The records of an archive folder, with the columns of ``SCHEMA``."""
    register(spark)
    return spark.read.format("warc").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(folder)


def with_revisits(pages: DataFrame, id_column: str, uri_column: str, payload_column: str, least: int = 0) -> DataFrame:
    """uid, source_id, target_uri, sha1, payload_bytes, payload; refers_uid and refers_to_source in rows whose payload another row keeps.

    The payloads are written once to the shared folder, so that rows keep their number (uid).
    """
    payload = F.coalesce(F.col(f"`{payload_column}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{uri_column}`").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    rows = materialize(rows, "warc-rows")
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("sha1").agg(F.max(F.struct("id", (-F.col("uid")).alias("first"))).alias("top"), F.count("*").alias("many")).filter("many > 1")
    groups = materialize(groups.select("sha1", F.col("top.id").cast("string").alias("refers_to_source"), (-F.col("top.first")).alias("refers_uid")), "warc-groups")
    again = rows.select("uid", "sha1", "payload_bytes").filter(F.col("payload_bytes") >= least).join(groups, "sha1").filter("uid <> refers_uid")
    again = materialize(again.select("uid", "refers_uid", "refers_to_source"), "warc-revisits")
    out = rows.join(F.broadcast(again) if again.count() <= SENT_ROWS else again, "uid", "left")
    # what is not kept need not reach the writer
    kept = F.when(F.col("refers_uid").isNull(), F.col("payload"))
    return out.select("uid", F.col("id").cast("string").alias("source_id"), "target_uri", "sha1", "payload_bytes", kept.alias("payload"), "refers_uid", "refers_to_source")


def write(pages: DataFrame, folder: str, id_column: str = "page_id", uri_column: str = "url", payload_column: str = "html", least: int = 0, **options: object) -> None:
    """One record per row, committed as a whole; runs jobs."""
    register(pages.sparkSession)
    rows = with_revisits(pages, id_column, uri_column, payload_column, least)
    rows.write.format("warc").options(**{k: str(v) for k, v in options.items()}).mode("append").save(folder)


def report(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads the archives back, payloads checked against their digests: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write(pages, folder)
    kind = pages.schema["page_id"].dataType
    back = read(spark, folder, payload=False, verify=True).filter(F.col("record_type").isin("response", "revisit"))
    return back.select(
        F.col("source_id").cast(kind).alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type", F.col("refers_to_source").cast(kind).alias("refers_to"),
    )


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, hex, list_aggregate(list_transform(range(32), lambda i:
    substr('{_BASE32}', CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> top THEN top END AS refers_to FROM b
"""
