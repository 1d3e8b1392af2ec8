"""Conversation structure repair by weighted interval parsing.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles: an optional system row, then pairs of user and assistant.
Rows may be kept (K, 0), given the role user or assistant (R, 3) or deleted (D, 4; blank and repeated rows must be), and empty
user or assistant rows inserted (I, 3); a truncated row that stays adds 3. The cheapest edits are wanted, the ASCII-least audit string among equals.

**Method.** A grammar in Chomsky normal form (``RULES``) derives every factor of such a conversation from two shorter ones; ``E`` stands for rows
that are all deleted. A CYK chart has a cell for each span of rows and symbol with the least (cost, audit), filled by span length
from all splits. Inserted rows are empty spans: after each span its cells are closed under rules in which one side is empty. Audits of equal cost
over one span are never prefixes of each other (a longer one would hold more inserts), so the least parts give the least whole.
Spans with the same faults and initials have the same cells, which each worker remembers.

**Scale.** Rows are shuffled once, by conversation, and sorted by turn within it. A conversation passes its task as a stream: a chart covers at
most ``BLOCK`` rows, and the cells of what came before are combined with the next block's as one more level of spans. Each prefix cell carries
a hash of its repaired rows so far, so no text is kept beyond its block, however long the conversation. SHA-256 is sequential and the audit one value, so
one conversation is one stream by the contract. Rows that repeat in conversations of more than ``LONG`` rows are found by a grouped join before; only shorter
ones remember digests in the task.

Edge cases: nulls in any column count as one space (in the key of the damage too); a null turn comes first and takes no part in gaps; a null
conv_id is a conversation of its own; rows with equal turns come in the order of role and text, repeated rows included; a role counts by its first
character, and rows with any other than s, u, a must change or go; a conversation whose rows are all dropped has zeros, an empty audit and the hash of nothing; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os.path
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of one chart, and of a conversation whose repeated rows are found in its task.
BLOCK, LONG = 12, 4096
#: With so much more cost no start of a conversation can win: two inserted rows and a deleted system row bring any other to the same continuation.
HOPELESS = 2 * INSERT + DELETE

#: left, right -> whole. Y: s; V: u(au)*; W: a(ua)*; P: (ua)+; Q: (au)+; T: su(au)*; S: s(ua)+.
RULES = {
    ("V", "W"): "P", ("V", "Q"): "V", ("W", "V"): "Q", ("W", "P"): "W", ("P", "P"): "P", ("P", "V"): "V", ("Q", "Q"): "Q", ("Q", "W"): "W",
    ("Y", "V"): "T", ("Y", "P"): "S", ("T", "W"): "S", ("T", "Q"): "T", ("S", "P"): "S", ("S", "V"): "T",
} | {pair: x for x in "EYVWPQTS" for pair in ((x, "E"), ("E", x))}
WHOLE = "EPS"  # what a whole conversation may be
#: What a conversation may start with, by what may follow: a system row at the start makes no difference once another row is kept.
STARTS = {"E": "E", "Y": "Y", "V": "V", "T": "V", "P": "P", "S": "P"}

Cell = dict[str, tuple[int, str]]


def combined(left: Cell, right: Cell, into: Cell) -> bool:
    """Adds all rules' results to ``into``; whether any was better."""
    better = False
    for a, (ca, wa) in left.items():
        for b, (cb, wb) in right.items():
            x = RULES.get((a, b))
            if x is not None and ((c := ca + cb) < (old := into.get(x, (1 << 62, "")))[0] or c == old[0] and wa + wb < old[1]):
                into[x] = (c, wa + wb)
                better = True
    return better


def closed(cell: Cell, empty: Cell) -> Cell:
    """Insertion closure: until no inserted row on either side makes a symbol cheaper."""
    while combined(empty, dict(cell), cell) | combined(dict(cell), empty, cell):
        pass
    return cell


@lru_cache(maxsize=1)
def nothing() -> Cell:
    """The cells of an empty span: no row, or inserted ones."""
    cell: Cell = {"E": (0, ""), "V": (INSERT, "I"), "W": (INSERT, "I")}
    while combined(dict(cell), dict(cell), cell):
        pass
    return cell


def row_cell(initial: str, fault: str) -> Cell:
    """The cells of one row. ``fault``: D must go, T truncated, - none."""
    cell: Cell = {"E": (DELETE, "D")}
    if fault != "D":
        more = TRUNCATED if fault == "T" else 0
        for symbol, role in (("V", "u"), ("W", "a")):
            cell[symbol] = (more, "K") if initial == role else (REROLE + more, "R")
        if initial == "s":
            cell["Y"] = (more, "K")
    return closed(cell, nothing())


@lru_cache(maxsize=1 << 14)
def chart(rows: str) -> Cell:
    """The cells of a block of rows, two characters (initial, fault) each: all spans bottom-up by length."""
    n = len(rows) // 2
    spans = {(i, i + 1): row_cell(rows[2 * i], rows[2 * i + 1]) for i in range(n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = {}
            for k in range(i + 1, i + length):
                combined(spans[i, k], spans[k, i + length], cell)
            spans[i, i + length] = closed(cell, nothing())
    return spans[0, n] if n else nothing()


class Repair:
    """One conversation, row by row in order."""

    def __init__(self, remember: bool):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.turn = None
        self.turns, self.rows, self.last = 0, 0, None
        self.seen: set[bytes] | None = set() if remember else None
        self.block: list[tuple[str, str, str, str]] = []  # initial, fault, role, text
        # symbol -> cost, audit, its hash so far, how many rows remain in it, whether the first of them is a system row
        self.prefix = {"E": (0, "", hashlib.sha256(), 0, False)}
        self.audit: list[str] = []  # what all prefixes' audits have in common

    def add(self, turn, role: str, text: str, blank: bool, ends: bool, repeated: bool) -> None:
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        initial = role[:1]
        if self.rows and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.rows, self.last = self.rows + 1, initial
        if self.seen is not None:
            digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            repeated = digest in self.seen
            self.seen.add(digest)
        if blank:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif not ends:
            self.truncated += 1
        fault = "D" if blank or repeated else "-" if ends else "T"
        self.block.append((initial if initial in ("s", "u", "a") else "?", fault, role, "" if fault == "D" else text))
        if len(self.block) == BLOCK:
            self.flush()

    def flush(self) -> None:
        """The last level of spans: what came before, and this block."""
        if not self.block:
            return
        cells = chart("".join(i + f for i, f, _, _ in self.block))
        best: dict[str, tuple[int, str, str, str]] = {}
        for a, (cost, audit, *_) in self.prefix.items():
            for b, (more, tail) in cells.items():
                x = STARTS.get(RULES.get((a, b), "-"))
                if x is not None and (x not in best or (cost + more, audit + tail) < best[x][:2]):
                    best[x] = (cost + more, audit + tail, a, tail)
        least = min(c for c, *_ in best.values())
        prefix = {x: (cost, audit, *self._hashed(a, tail)) for x, (cost, audit, a, tail) in best.items() if cost <= least + HOPELESS}
        common = os.path.commonprefix([audit for _, audit, *_ in prefix.values()])
        self.audit.append(common)
        self.prefix = {x: (cost, audit[len(common) :], *rest) for x, (cost, audit, *rest) in prefix.items()}
        self.block = []

    def _hashed(self, symbol: str, tail: str):
        _, _, digest, kept, system = self.prefix[symbol]
        digest, rows = digest.copy(), iter(self.block)
        for edit in tail:
            row = None if edit == "I" else next(rows)
            if edit == "D":
                continue
            if edit == "K":
                role, text = row[2], row[3]
                system = system or kept == 0 and row[0] == "s"
            else:
                role, text = ("assistant" if (kept - system) % 2 else "user"), "" if row is None else row[3]
            digest.update((("\n" if kept else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            kept += 1
        return digest, kept, system

    def result(self) -> dict:
        self.flush()
        ends = nothing()  # rows inserted at the end
        cost, audit, symbol, tail = min((c + d, w + v, a, v) for a, (c, w, *_) in self.prefix.items() for b, (d, v) in ends.items() if RULES.get((a, b), "-") in WHOLE)
        digest = self._hashed(symbol, tail)[0]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {
            "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "cost": cost, "audit": "".join(self.audit) + audit, "repaired_sha256": digest.hexdigest(),
        }


# ---- rows


def damaged(rows: DataFrame, damage: bool = True) -> DataFrame:
    """conv_id, turn, role, text, here (false: the row was dropped), after the contract's damage (``damage`` False: as they are)."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    if not damage:
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *filled, F.lit(True).alias("here"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *filled, (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") < 2, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = out.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("here"), F.explode(copies).alias("copy_"))
    return out.drop("copy_")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def _marked(rows: DataFrame) -> DataFrame:
    """Adds ``long`` (more rows than LONG) and, for these, ``repeated``: not the first row of its role and text. Runs jobs if any are long."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("many")).filter(F.col("many") > LONG)
    long = materialize(sizes.select(F.col("conv_id").alias("long_id")), "dialogue-long")
    if long.isEmpty():
        return rows.select("*", F.lit(False).alias("long"), F.lit(False).alias("repeated"))
    same = rows["conv_id"].eqNullSafe(long["long_id"])
    short = rows.join(long, same, "left_anti").select("*", F.lit(False).alias("long"), F.lit(False).alias("repeated"))
    # rows keep a number, so that of rows that are alike in everything one is the first
    of_long = materialize(rows.join(long, same, "left_semi").select("*", F.md5(F.to_json(F.struct("role", "text"))).alias("line"), F.monotonically_increasing_id().alias("uid")), "dialogue-rows")
    first = of_long.filter("here").groupBy(F.col("conv_id").alias("c_"), F.col("line").alias("l_")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "uid")).alias("first"))
    joined = of_long.join(first, of_long["conv_id"].eqNullSafe(F.col("c_")) & (F.col("line") == F.col("l_")), "left")
    repeated = F.coalesce(F.col("uid") != F.col("first.uid"), F.lit(False))
    of_long = joined.select(*rows.columns, F.lit(True).alias("long"), repeated.alias("repeated"))
    return short.unionByName(of_long)


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation from conv_id, turn, role, text, here."""
    known = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ends = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    marked = _marked(rows).select("conv_id", "turn", "role", "text", "here", "long", "repeated", (~known).alias("blank"), ends.alias("ends"))
    # the first of equal rows comes first, so that the others repeat it
    sorted_rows = marked.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order(), F.col("repeated").asc())

    def run(batches):
        now, talk, out, kind = None, None, [], None

        def batch():
            done = {"conv_id": pa.array([c for c, _ in out], type=kind)}
            done |= {f: pa.array([r[f] for _, r in out], pa.int64()) for f in FIGURES}
            done |= {f: pa.array([r[f] for _, r in out], pa.string()) for f in ("audit", "repaired_sha256")}
            return pa.RecordBatch.from_pydict(done)

        for b in batches:
            kind = b.column(0).type
            for conv, turn, role, text, here, long, repeated, blank, end in zip(*(b.column(i).to_pylist() for i in range(9))):
                if talk is None or conv != now:
                    if talk is not None:
                        out.append((now, talk.result()))
                    now, talk = conv, Repair(remember=not long)
                if here:
                    talk.add(turn, role, text, blank, end, repeated)
            if len(out) >= 4096:
                yield batch()
                out = []
        if talk is not None:
            out.append((now, talk.result()))
            yield batch()

    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{f} long" for f in FIGURES) + ", audit string, repaired_sha256 string"
    return sorted_rows.mapInArrow(run, schema)


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 after the contract's damage."""
    return repaired(damaged(conversations))
