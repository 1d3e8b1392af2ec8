"""Sum-of-squares packing of documents into sequences of at most 1024 tokens.

Documents longer than a sequence are cut into full pieces, after a first piece that holds the rest. A piece goes into the open sequence
whose choice makes the sum over gaps of (open sequences with that gap)^2 smallest; a new sequence is opened only
when none has room. Long pieces come first. Groups of a bounded number of pieces are packed side by side; sequences left open that
could still merge are themselves pieces for the next level, until one group holds them all, so that the number of groups costs no
sequences. These are a few per group whatever the lengths, so no group outgrows the others.

Edge cases: null text is one piece with the end id; repeated doc_ids are packed each; ties go to the smaller gap, then to the
sequence opened last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.llm.tokens import crc, encoded, public_tokenizer
from tidemark.session import materialize

ROOM = 1024
GROUP = 8192


def pack(lengths: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, in the given order of lengths."""
    counts = np.zeros(room + 1, dtype="int64")  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(room + 1)]
    number, offset = np.empty(len(lengths), "int64"), np.empty(len(lengths), "int64")
    opened = 0
    for i, s in enumerate(lengths.tolist()):
        fits = counts[s:room]
        gap = room
        if fits.any():
            # moving a sequence from gap g to g-s changes the sum by 2 - 2 N(g) + 2 N(g-s); closing one by 1 - 2 N(g)
            change = 2 - 2 * fits + 2 * counts[: room - s]
            change[0] = 1 - 2 * fits[0]
            change[fits == 0] = np.iinfo("int64").max
            gap = s + int(change.argmin())
            counts[gap] -= 1
            number[i] = open_by_gap[gap].pop()
        else:
            number[i] = opened
            opened += 1
        offset[i] = room - gap
        if gap > s:
            counts[gap - s] += 1
            open_by_gap[gap - s].append(int(number[i]))
    return number, offset


def pieces(docs: DataFrame, path: str | None = None, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece. Texts are read and encoded once; no ids leave the task."""
    path = path or public_tokenizer()

    def cut(batches):
        for part, ids in encoded(batches, path, 1):
            rows: list[tuple] = []
            for doc_id, x in zip(part.column(0).to_pylist(), ids):
                first = len(x) % room or room
                borders = [0, *range(first, len(x) + 1, room)]
                rows += [(doc_id, k, a, b - a, crc(x[a:b])) for k, (a, b) in enumerate(zip(borders, borders[1:]))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [part.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _pack_groups(items: DataFrame) -> DataFrame:
    """(grp, item, length) -> item, length, at, offset, fill: packed within each group; a sequence is named by the item that opened it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("item", "ascending")])
        number, offset = pack(table["length"].to_numpy())
        fill = np.bincount(number, weights=table["length"].to_numpy()).astype("int64")[number]
        at = table["item"].to_numpy()[np.unique(number, return_index=True)[1]][number]
        return table.append_column("at", pa.array(at)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))

    return items.groupBy("grp").applyInArrow(run, "grp long, item long, length long, at long, offset long, fill long").drop("grp")


def _can_merge(left: DataFrame) -> DataFrame:
    """The open sequences (item, length) that the next level needs for all merges that are possible.

    Two sequences over half full never merge, and a group leaves one of at most half, for the next one would have gone into it. So a
    level saves at most as many sequences as there are half empty ones, and those with the widest gaps, as many, do for that.
    """
    half = ROOM // 2
    sizes = sorted(tuple(r) for r in left.groupBy("length").count().collect())  # at most ROOM rows
    small = sum(n for size, n in sizes if size <= half)
    wanted, border, share = small, half, 0.0
    for size, n in sizes:
        if size > half and wanted > 0:
            # of the last size twice as many as wanted and some more, chosen by digest: too few is next to impossible
            border, share = (size, 1.0) if n <= wanted else (size, min(1.0, (2 * wanted + 64) / n))
            wanted -= n
    if not small:
        return left.limit(0)
    some = F.pmod(F.xxhash64("item", F.lit("share")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    return left.filter((F.col("length") < border) | (F.col("length") <= half) | ((F.col("length") == border) & some))


def place(lengths: DataFrame) -> DataFrame:
    """(item, length below a full sequence) -> item, sequence_id, offset. One job per level; a level packs groups of GROUP items."""
    n = lengths.count()
    groups = max(1, -(-n // GROUP))
    items = lengths
    where = None  # item -> name of the sequence it is in so far, offset there
    level = 0
    while True:
        grouped = items.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)))
        out = materialize(_pack_groups(grouped), "pack-level")
        moved = out.select("item", "at", "offset")
        if where is None:
            where = moved
        else:  # sequences of the last level that were merged; all others stay where they are
            new = moved.select(F.col("item").alias("at"), F.col("at").alias("at2"), F.col("offset").alias("offset2"))
            where = where.join(new, "at", "left").select("item", F.coalesce("at2", "at").alias("at"), (F.col("offset") + F.coalesce("offset2", F.lit(0))).alias("offset"))
        done = where.select("item", F.col("at").alias("sequence_id"), "offset")
        if groups == 1:
            return done
        left = out.filter(F.col("fill") < ROOM).groupBy(F.col("at").alias("item")).agg(F.max("fill").alias("length"))
        items = materialize(_can_merge(materialize(left, "pack-open")), "pack-merge")
        n = items.count()
        if n < 2:
            return done
        groups = min(groups - 1, -(-n // GROUP))  # a few sequences per group are left, so this is the second but for tiny groups
        level += 1


def report(docs: DataFrame) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(docs).withColumn("item", F.monotonically_increasing_id()), "pack-pieces")
    parts = place(cut.filter(F.col("length") < ROOM).select("item", "length"))
    short = cut.filter(F.col("length") < ROOM).join(parts, "item")
    full = cut.filter(F.col("length") == ROOM).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return short.select(*names).unionByName(full.select(*names))
