"""Versioned tables on plain Parquet: snapshots, time travel, row changes, schema and partition evolution.

A table is a folder. Every commit writes its rows to a new folder below ``data/`` and then creates
``manifest/<version>.json``, which names the live folders, the schema and the partition spec of that
version. Nothing already written changes, so readers of a version are never disturbed, and a writer
that loses the race for a version number gets ``Conflict``.

Columns are stored under ids (``c1``, ``c2``, ...), which makes rename and drop a matter of metadata.
Row changes rewrite only the partition folders that hold affected rows. The driver handles folder
names (as many as there are partitions), never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# Type changes that lose nothing.
WIDENINGS = {("int", "bigint"), ("float", "double"), ("smallint", "int"), ("smallint", "bigint"), ("tinyint", "int"), ("date", "timestamp")}

TRANSFORMS = ("identity", "days", "months", "bucket")


class Conflict(Exception):
    """Another writer committed this version first."""


def put_key(column: Column, key: str, value: Column) -> Column:
    """A map column with ``key`` set to ``value``."""
    return F.map_concat(F.map_filter(column, lambda k, _: k != key), F.create_map(F.lit(key), value))


def _utc(at: datetime | str | None) -> str:
    if at is None:
        at = datetime.now(timezone.utc).replace(tzinfo=None)
    return at.isoformat(sep=" ", timespec="microseconds") if isinstance(at, datetime) else at


class VersionedTable:
    """A handle on one table folder. Methods that write run jobs and return the new version number."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- manifest -----------------------------------------------------------------------------

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where, fs = self._hadoop(f"{self.root}/manifest")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("_"))

    def entry(self, version: int | None = None) -> dict:
        if version is None:
            known = self.versions()
            if not known:
                raise ValueError(f"no table at {self.root}")
            version = known[-1]
        path = f"{self.root}/manifest/{version:012d}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _commit(self, entry: dict) -> int:
        """Write the entry aside and rename it to its number, which fails when the number is taken."""
        jvm, name = self.spark._jvm, f"{entry['version']:012d}.json"
        aside, fs = self._hadoop(f"{self.root}/manifest/_{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        target, _ = self._hadoop(f"{self.root}/manifest/{name}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, target, no_overwrite)
        except Exception as exc:
            fs.delete(aside, False)
            if fs.exists(target):
                raise Conflict(f"version {entry['version']} of {self.root} exists") from exc
            raise
        return entry["version"]

    def _next(self, operation: str, base: dict | None, at: datetime | str | None, **changes) -> dict:
        start = base or {"version": -1, "live": [], "fields": [], "spec": [], "next_id": 1, "expired": []}
        return {
            **start, "version": start["version"] + 1, "parent": start["version"], "operation": operation,
            "committed_at": _utc(at), "added": [], "removed": [], "batch": None, **changes,
        }

    # ---- create and read ----------------------------------------------------------------------

    def create(self, df: DataFrame, partition_by: Sequence[str | tuple] = (), at=None) -> int:
        """Create the table, or replace its contents and schema in a new version.

        ``partition_by`` holds column names or (transform, column[, n]) with days, months or bucket.
        """
        base = self.entry() if self.versions() else None
        first = base["next_id"] if base else 1
        fields = [
            {"id": f"c{first + i}", "name": f.name, "type": f.dataType.simpleString(), "default": None}
            for i, f in enumerate(df.schema)
        ]
        spec = [self._spec(p) for p in partition_by]
        draft = self._next("create" if base is None else "replace", base, at, fields=fields, spec=spec, next_id=first + len(fields))
        added = self._write(df, draft)
        return self._commit({**draft, "live": added, "added": added})

    @staticmethod
    def _spec(part: str | tuple) -> dict:
        kind, column, *rest = ("identity", part) if isinstance(part, str) else part
        if kind not in TRANSFORMS:
            raise ValueError(f"unknown partition transform {kind!r}")
        return {"transform": kind, "column": column, "n": rest[0] if rest else None}

    def read(self, version: int | None = None, as_of: datetime | str | None = None) -> DataFrame:
        """The rows of the current version, of a version number, or of the last version at a time."""
        return self._frame(self._at(version, as_of))

    def _at(self, version: int | None, as_of: datetime | str | None) -> dict:
        if as_of is not None:
            found = self.history().filter(F.col("committed_at") <= F.lit(_utc(as_of))).agg(F.max("version")).first()[0]
            if found is None:
                raise ValueError(f"no version at {as_of}")
            version = found
        entry = self.entry(version)
        if version is not None and version in self.entry().get("expired", []):
            raise ValueError(f"version {version} has expired")
        return entry

    def _frame(self, entry: dict, folders: list[dict] | None = None, where: bool = False) -> DataFrame:
        """Rows of the given live folders under the entry's column names; ``where`` adds their folder."""
        live = entry["live"] if folders is None else folders
        parts = []
        for segment in dict.fromkeys(x["segment"] for x in live):
            mine = [x for x in live if x["segment"] == segment]
            paths = [f"{self.root}/data/{segment}/{x['folder']}".rstrip("/") for x in mine]
            stored = StructType.fromJson(json.loads(mine[0]["schema"]))
            raw = self.spark.read.schema(stored).option("basePath", f"{self.root}/data/{segment}").parquet(*paths)
            held = {f.name for f in stored}
            columns = [
                (F.col(f["id"]) if f["id"] in held else F.expr(f["default"] or "NULL")).cast(f["type"]).alias(f["name"])
                for f in entry["fields"]
            ]
            if where:
                columns += [F.lit(segment).alias("_segment"), F.url_decode(F.col("_metadata.file_path")).alias("_file")]
            parts.append(raw.select(*columns))
        if not parts:
            schema = ", ".join(f"`{f['name']}` {f['type']}" for f in entry["fields"])
            schema += ", _segment string, _file string" if where else ""
            return self.spark.createDataFrame([], schema)
        return reduce(lambda a, b: a.unionAll(b), parts)

    def _write(self, df: DataFrame, entry: dict) -> list[dict]:
        """Write rows as one new segment in the entry's layout; returns its folders."""
        segment, by_name = uuid.uuid4().hex, {f["name"]: f["id"] for f in entry["fields"]}
        stored = df.select(*[F.col(f"`{f['name']}`").cast(f["type"]).alias(f["id"]) for f in entry["fields"]])
        schema = StructType([StructField(f.name, f.dataType, True) for f in stored.schema])
        hidden = {}
        for i, part in enumerate(entry["spec"]):
            column = F.col(by_name[part["column"]])
            hidden[f"p{i}"] = {
                "identity": lambda: column.cast("string"), "days": lambda: F.to_date(column).cast("string"),
                "months": lambda: F.date_format(column, "yyyy-MM"),
                "bucket": lambda: F.pmod(F.hash(column), F.lit(part["n"])).cast("string"),
            }[part["transform"]]()
        path = f"{self.root}/data/{segment}"
        if hidden:
            # rebalancing gathers each partition into few files and splits a hot one over several tasks
            stored = stored.withColumns(hidden).hint("rebalance", *[F.col(h) for h in hidden])
            stored.write.partitionBy(*hidden).parquet(path)
        else:
            stored.write.parquet(path)
        return [{"segment": segment, "folder": f, "schema": schema.json()} for f in self._folders(path)]

    def _folders(self, path: str) -> list[str]:
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
        base = path.rsplit("/data/", 1)[1]
        folder = F.regexp_extract("path", f"/data/{base}/(?:(.*)/)?[^/]+$", 1)
        return sorted(r[0] for r in files.select(folder.alias("f")).distinct().collect())

    # ---- row changes --------------------------------------------------------------------------

    def append(self, df: DataFrame, at=None, batch: str | None = None) -> int:
        """Add rows; columns the frame lacks are NULL."""
        base = self.entry()
        draft = self._next("append", base, at, batch=batch)
        for field in base["fields"]:
            if field["name"] not in df.columns:
                df = df.withColumn(field["name"], F.lit(None).cast(field["type"]))
        added = self._write(df, draft)
        return self._commit({**draft, "live": base["live"] + added, "added": added})

    def _touched(self, base: dict, rows: DataFrame) -> list[dict]:
        """The live folders holding the given rows (of ``_frame(where=True)``)."""
        folder = F.regexp_extract("_file", "/data/[0-9a-f]+/(?:(.*)/)?[^/]+$", 1)
        hit = {(r[0], r[1]) for r in rows.select("_segment", folder.alias("f")).distinct().collect()}
        return [x for x in base["live"] if (x["segment"], x["folder"]) in hit]

    def _rewrite(self, operation: str, base: dict, touched: list[dict], rows: DataFrame | None, at, batch: str | None = None) -> int:
        draft = self._next(operation, base, at, batch=batch)
        added = self._write(rows, draft) if rows is not None else []
        kept = [x for x in base["live"] if x not in touched]
        return self._commit({**draft, "live": kept + added, "added": added, "removed": touched})

    def update(self, changes: Mapping[str, Column], where: Column, at=None) -> int:
        """SET columns WHERE the condition is true; expressions see the old row."""
        base = self.entry()
        touched = self._touched(base, self._frame(base, where=True).filter(where))
        rows = self._frame(base, touched)
        hit = F.coalesce(where, F.lit(False))
        changed = rows.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in rows.columns])
        return self._rewrite("update", base, touched, changed if touched else None, at)

    def delete(self, where: Column, at=None) -> int:
        """Remove rows where the condition is true; a NULL condition keeps the row."""
        base = self.entry()
        touched = self._touched(base, self._frame(base, where=True).filter(where))
        rows = self._frame(base, touched).filter(~F.coalesce(where, F.lit(False)))
        return self._rewrite("delete", base, touched, rows if touched else None, at)

    def merge(
        self, source: DataFrame, on: Sequence[str], matched: Mapping[str, Column] | None = None, insert: bool = True,
        at=None, batch: str | None = None,
    ) -> int:
        """Update rows whose key is in ``source``, insert source rows with a new key.

        ``matched`` gives expressions over target columns and ``s.<column>``; by default every column
        the source has is taken over. A key twice in the source is an error. A batch id already
        committed is skipped.
        """
        base = self.entry()
        if batch is not None and self.has_batch(batch):
            return base["version"]
        keys = list(on)
        if not source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            raise ValueError("the source holds a key more than once")
        ids = source.select(*keys)
        touched = self._touched(base, self._frame(base, where=True).join(ids, keys, "left_semi"))
        target = self._frame(base, touched)
        taken = {c: F.col(f"s.{c}") for c in source.columns if c not in keys} if matched is None else dict(matched)
        tagged = source.withColumn("_hit", F.lit(True)).alias("s")
        same = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])
        joined = target.alias("t").join(tagged, same, "left")
        changed = joined.select(
            *[F.when(F.col("s._hit"), taken[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in taken else F.col(f"t.{c}").alias(c) for c in target.columns]
        )
        if insert:
            names = [f["name"] for f in base["fields"]]
            new = source.join(self._frame(base).select(*keys), keys, "left_anti")
            for field in base["fields"]:
                if field["name"] not in new.columns:
                    new = new.withColumn(field["name"], F.lit(None).cast(field["type"]))
            changed = changed.unionByName(new.select(*names)) if touched else new.select(*names)
        elif not touched:
            changed = None
        return self._rewrite("merge", base, touched, changed, at, batch)

    def has_batch(self, batch: str) -> bool:
        return not self.history().filter(F.col("batch") == batch).isEmpty()

    # ---- history ------------------------------------------------------------------------------

    def history(self) -> DataFrame:
        """One row per version."""
        schema = (
            "version LONG, parent LONG, operation STRING, committed_at STRING, batch STRING, "
            "live ARRAY<STRUCT<folder: STRING>>, added ARRAY<STRUCT<folder: STRING>>, removed ARRAY<STRUCT<folder: STRING>>"
        )
        log = self.spark.read.schema(schema).option("pathGlobFilter", "0*.json").json(f"{self.root}/manifest")
        return log.select(
            "version", "parent", "operation", "committed_at", "batch", F.size("live").alias("live_folders"),
            F.size("added").alias("added_folders"), F.size("removed").alias("removed_folders"),
        )

    def partitions(self) -> DataFrame:
        """Rows per partition folder of the current version."""
        base = self.entry()
        folder = F.regexp_extract("_file", "/data/[0-9a-f]+/(?:(.*)/)?[^/]+$", 1)
        return self._frame(base, where=True).groupBy(folder.alias("partition")).agg(F.count(F.lit(1)).alias("n"))

    def rollback(self, version: int | None = None, as_of=None, at=None) -> int:
        """Make an earlier (or later) version current again, as a new version."""
        base, old = self.entry(), self._at(version, as_of)
        return self._commit(self._next("rollback", base, at, **{k: old[k] for k in ("live", "fields", "spec")}))

    def cherry_pick(self, version: int, at=None) -> int:
        """Add the folders that an earlier append added to the current version."""
        base, picked = self.entry(), self._at(version, None)
        if picked["removed"]:
            raise ValueError("only appends can be picked")
        new = [x for x in picked["added"] if x not in base["live"]]
        return self._commit(self._next("cherry-pick", base, at, live=base["live"] + new, added=new))

    def expire(self, keep_last: int, older_than=None, at=None) -> int:
        """Expire versions beyond the last ``keep_last`` that were committed before ``older_than``; folders
        no kept version names are deleted."""
        base, known = self.entry(), self.versions()
        gone = [v for v in known[:-keep_last] if v not in base["expired"]]
        if older_than is not None:
            gone = [v for v in gone if self.entry(v)["committed_at"] < _utc(older_than)]
        number = self._commit(self._next("expire", base, at, expired=base["expired"] + gone))
        kept = {(x["segment"], x["folder"]) for v in known if v not in base["expired"] + gone for x in self.entry(v)["live"] + self.entry(v)["added"]}
        dead = {(x["segment"], x["folder"]) for v in gone for x in self.entry(v)["live"]} - kept
        for segment, folder in sorted(dead):
            where, fs = self._hadoop(f"{self.root}/data/{segment}/{folder}".rstrip("/"))
            fs.delete(where, True)
        return number

    def compact(self, target_bytes: int = 512 * 1024 * 1024, at=None) -> int:
        """Rewrite the live rows into files of about ``target_bytes``."""
        base = self.entry()
        paths = [f"{self.root}/data/{x['segment']}/{x['folder']}".rstrip("/") for x in base["live"]]
        size = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(paths).agg(F.sum("length")).first()[0] or 0
        files = max(1, -(-size // target_bytes))
        rows = self._frame(base)
        return self._rewrite("compact", base, base["live"], rows if base["spec"] else rows.repartition(files), at)

    # ---- schema and layout --------------------------------------------------------------------

    def _field(self, base: dict, name: str) -> dict:
        for field in base["fields"]:
            if field["name"] == name:
                return field
        raise ValueError(f"no column {name}")

    def add_column(self, name: str, type: str, default: str | None = None, at=None) -> int:
        """Older rows read ``default`` (a SQL literal) or NULL."""
        base = self.entry()
        if any(f["name"] == name for f in base["fields"]):
            raise ValueError(f"column {name} exists")
        field = {"id": f"c{base['next_id']}", "name": name, "type": type, "default": default}
        return self._commit(self._next("add column", base, at, fields=base["fields"] + [field], next_id=base["next_id"] + 1))

    def drop_column(self, name: str, at=None) -> int:
        base = self.entry()
        self._field(base, name)
        if any(p["column"] == name for p in base["spec"]):
            raise ValueError(f"column {name} partitions the table")
        return self._commit(self._next("drop column", base, at, fields=[f for f in base["fields"] if f["name"] != name]))

    def rename_column(self, old: str, new: str, at=None) -> int:
        base = self.entry()
        self._field(base, old)
        if any(f["name"] == new for f in base["fields"]):
            raise ValueError(f"column {new} exists")
        fields = [{**f, "name": new} if f["name"] == old else f for f in base["fields"]]
        spec = [{**p, "column": new} if p["column"] == old else p for p in base["spec"]]
        return self._commit(self._next("rename column", base, at, fields=fields, spec=spec))

    def widen_column(self, name: str, type: str, at=None) -> int:
        base = self.entry()
        field = self._field(base, name)
        if (field["type"], type) not in WIDENINGS:
            raise ValueError(f"cannot change {name} from {field['type']} to {type} without loss")
        fields = [{**f, "type": type} if f["name"] == name else f for f in base["fields"]]
        return self._commit(self._next("widen column", base, at, fields=fields))

    def set_partitions(self, partition_by: Sequence[str | tuple], at=None) -> int:
        """Later writes use the new layout; folders already written stay as they are."""
        base = self.entry()
        spec = [self._spec(p) for p in partition_by]
        for part in spec:
            self._field(base, part["column"])
        return self._commit(self._next("set partitions", base, at, spec=spec))
