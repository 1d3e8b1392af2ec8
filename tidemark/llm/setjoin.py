"""N-gram Jaccard join with set-relation skipping.

Documents are sets of word shingles. Two link when their Jaccard similarity reaches a percentage; the result
is one row per document with the size of its set and its component. All links between different sets count; equal sets
are one node from the start, whatever their number.

**Index lists, skipped by position.** All shingles have one global order (their digest's). A set of n shingles misses at most ``gone(n)`` of its shingles
in a set it links with, so its first ``gone(n) + spare`` shingles, its region, hold ``spare`` that both have, each in both
regions. Lists of regions are counted, and every set leaves the ``spare - 1`` longest of its shared lists (for the least spare of the sets it could link with): one common list is
still left to both. So passages that many documents share drop out of the index, and most documents with them. Entries keep
their position in blocks; blocks of a list whose positions and sizes already differ in more shingles than the threshold allows are skipped, as are those of sets
that have fewer lists as long or longer than links must share, or too many shingles that no other region has.

**Chance meetings.** The more texts there are, the more shingles of unrelated texts meet. A set that only keeps short lists meets whom it links with in as many of them as links
must share: those lists are paired, and a set that has no such pair leaves the index, so neither families nor whole sets grow with what meets by chance.

**Answers from a similar set's answers.** Sets that share a fifth of their lists with one of them form a family around that centre ``c``. ``D(x)``, the shingles in
which ``x`` and ``c`` differ, answers whether they link; ``x`` and ``y`` differ in exactly ``D(x)`` against ``D(y)``. Members that link with ``c``
are one cluster; a large family is clustered around central members instead, while they gather anything (who links with ``c`` keeps that link). Others that link share
all but ``k`` elements of their difference, so one of the ``k + 1`` rarest must be shared: those are indexed. Clusters meet first: what their centres differ in, less both radii, excludes most, a member that links with the other
centre settles the pair, and only members that the radii leave open are compared one by one. So a group of thousands of copies costs one
comparison per copy, not all pairs.

Shingles and sets travel as 64 and 128 bit digests. Everything runs as joins and map-side combined groups; no list, family or
component is gathered in one task.

Whole sets take several times the disk of the texts, so they are read part by part, and only what they differ in from their family's centre stays.

Edge cases: null or empty text has an empty set, links with nothing and is its own component; fewer words than a shingle are one shingle;
rows that repeat a doc_id are documents of their own, named alike; a null doc_id is never a component's name if another id is there;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, text_of
from tidemark.session import Scratch, Steps, materialize

WORDS, PERCENT = 3, 90
#: Rounds of finding centres of families; later ones find hardly any. Families with more open members get further centres, chosen among about as many members.
ROUNDS, BIG = 4, 256
#: At most so many ids are sent to every task to find their rows; more are joined by a shuffle.
SENT_IDS = 1_000_000
#: Lists of up to so many regions are paired.
SHORT = 4
#: Whole sets are read in parts of about 1 / PARTS of all shingles, but not of fewer than PART.
PARTS, PART = 8, 1 << 24
CHUNK = 1 << 20

U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype="uint8")
_LOW[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_ODD = [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(29))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def line(base: int) -> np.ndarray:
        out = np.full(size, base, "uint64")
        out[0] = 1
        return np.cumprod(out, dtype="uint64")

    return line(_BASE), line(pow(_BASE, -1, 1 << 64))


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of adjoining texts (bytes, lower-cased here), and where each text's words begin."""
    n = len(data)
    if n == 0:
        return np.empty(0, "uint64"), np.zeros(len(starts), "int64")
    word = ~_SEP[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = starts[(starts > 0) & (starts < n)]  # a text's border parts words as well
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(max(CHUNK, 1 << int(n - 1).bit_length()))
    total = np.zeros(n + 1, "uint64")
    np.cumsum((_LOW[data].astype("uint64") + U(1)) * up[:n], out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype("uint64") * U(_ODD[0]))
    return h, np.searchsorted(s, starts)


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word digests of one long text, in pieces cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data):  # to the next white space
            gap = np.flatnonzero(_SEP[data[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + 4096, len(data))
        out.append(_words(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, "uint64")


def _set_of(h: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct shingle digests of a sequence of word digests."""
    if len(h) == 0:
        return h
    if len(h) >= words:
        g = np.zeros(len(h) - words + 1, "uint64")
        for i in range(words):
            g += h[i : len(h) - words + 1 + i] * U(_ODD[i % 7] * (2 * (i // 7) + 1) & (1 << 64) - 1)
    else:
        g = np.array([len(h)], "uint64")
        for i in range(len(h)):
            g += h[i : i + 1] * U(_ODD[6 - i % 7])
    g = np.sort(mix(g))
    return g[np.concatenate(([True], g[1:] != g[:-1]))]


def sets_of(texts: pa.Array, words: int = WORDS):
    """One set per text (null: empty), at most a chunk of bytes at a time."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], "uint8") if texts.buffers()[2] else np.empty(0, "uint8")
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1
        if j <= i:  # a text longer than a chunk
            yield _set_of(_long_words(data[offsets[i] : offsets[i + 1]]), words)
            i += 1
            continue
        h, at = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for a, b in zip(at, at[1:]):
            yield _set_of(h[a:b], words)
        i = j


def gone(n: int, percent: int) -> int:
    """The most shingles of a set of ``n`` that a set it links with lacks."""
    return (100 - percent) * n // 100


def spare(n: int, percent: int) -> int:
    return 1 + gone(n, percent) // 2


def _gone(n: Column, percent: int) -> Column:
    return F.floor(n * (100 - percent) / 100)


def _left_out(n: Column, percent: int) -> Column:
    """How many of its longest lists a set leaves: one less than the least spare of the sets it could link with."""
    return F.floor(_gone(F.ceil(n * percent / 100), percent) / 2)


def _need(alo: Column, ahi: Column, blo: Column, bhi: Column, percent: int) -> Column:
    """The least number of kept lists that linked sets of these ranges of sizes have in common, at least 1.

    The region less the set grows by at most 2 with the set's size; of one size each, the number is exact.
    """
    t = F.ceil((alo + blo) * percent / (100 + percent))
    short = [t - s + _gone(s, percent) + 1 + F.floor(_gone(s, percent) / 2) for s in (ahi, bhi)]
    some = F.when((alo < ahi) | (blo < bhi), 2).otherwise(0)
    return F.greatest(F.least(*short) - F.greatest(_left_out(ahi, percent), _left_out(bhi, percent)) - some, F.lit(1))


def _digests(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum(dtype="uint64").view("int64")), int(mix(s + U(_ODD[2])).sum(dtype="uint64").view("int64"))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype="int32")
    flat = np.concatenate(parts).view("int64") if parts else np.empty(0, "int64")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def digests(docs: DataFrame, words: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, n, c1, c2 and ``items``: the region of each document's set, or (``whole``) the set itself; both in the global order."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = list(sets_of(part.column(1), words))
                c = [_digests(s) for s in sets]
                items = _lists(sets if whole else [s[: gone(len(s), percent) + spare(len(s), percent)] for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in c], pa.int64()), pa.array([y for _, y in c], pa.int64()), items],
                    names=["doc_id", "n", "c1", "c2", "items"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n long, c1 long, c2 long, items array<long>")


def _rows_of(df: DataFrame, ids: DataFrame, on: Column | str) -> DataFrame:
    """The rows of ``df`` that ``ids`` name; ``ids`` is a written table, sent to all tasks only up to SENT_IDS rows."""
    return df.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, on, "left_semi")


def _sent(small: DataFrame) -> DataFrame:
    """A written table of a few numbers per row, sent to all tasks up to SENT_IDS rows; more are joined by a shuffle."""
    return F.broadcast(small) if small.count() <= SENT_IDS else small


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> node, root: the smallest node that can be reached.

    In a round every node goes to its smallest neighbour's smallest neighbour, if that is smaller, and edges follow their ends; what
    was connected stays so, and edges within one node vanish. The work shrinks with the edges; it ends when none is left. Each round is written.
    """
    edges = materialize(edges.select("a", "b"), "links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    state, both = both.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), both.filter("a <> b")
    while not both.isEmpty():
        step = materialize(both.groupBy(F.col("a").alias("root")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "steps")
        jump = step.select(F.col("root").alias("to"), F.col("to").alias("far"))
        step = materialize(step.join(jump, "to").select("root", F.col("far").alias("to")), "steps")
        state = materialize(state.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        ends = both.join(step.select(F.col("root").alias("a"), F.col("to").alias("a_to")), "a").join(step.select(F.col("root").alias("b"), F.col("to").alias("b_to")), "b")
        both = materialize(ends.filter("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "links")
    return state.select("node", "root")


def _kept(nodes: DataFrame, percent: int, tmp: Scratch) -> DataFrame:
    """uid, n, key (the list), from and to (the position block), later (kept lists of the set that are as long or longer, itself included),
    alone_below and alone_above (shingles of the region on that side of the key that no other region has) and last (the region's last shingle, in order as signed numbers).

    These are the entries of shared lists that sets do not leave, of sets that may link with another (``_live``).
    """
    entries = nodes.select("uid", F.posexplode("items").alias("pos", "key"))  # the largest shuffle: sizes come back later, to the few sets that share lists
    lists = tmp.write(entries.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1"), "join-lists")
    shared = entries.join(lists.hint("merge"), "key")  # lists grow with the data: one plan for all sizes, so that small runs tell the growth of large ones
    below = F.col("pos") - F.row_number().over(Window.partitionBy("uid").orderBy("pos")) + 1
    own = shared.withColumn("below", below).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("many", "key", "pos", "below"))).alias("own"))  # at most a region
    own = own.join(nodes.select("uid", "n", F.size("items").alias("region"), F.element_at("items", -1).bitwiseXOR(F.lit(-1 << 63)).alias("last")), "uid")
    own = own.withColumn("stay", F.size("own") - _left_out(F.col("n"), percent).cast("int")).filter("stay > 0").withColumn("alone", F.col("region") - F.size("own"))
    above = F.col("alone") - F.col("e.below")
    stays = F.slice("own", F.lit(1), F.col("stay"))
    long_lists = F.size(F.filter(stays, lambda e: e["many"] > SHORT))
    kept = own.select("uid", "n", "stay", "alone", "last", long_lists.alias("long"), F.posexplode(stays).alias("place", "e"))
    width = F.greatest(F.floor(_gone(F.col("n"), percent) / 4), F.lit(1))
    start = F.floor(F.col("e.pos") / width) * width
    later = (F.col("stay") - F.col("place")).alias("later")
    place = [start.alias("from"), (start + width - 1).alias("to"), later, F.col("e.below").alias("alone_below"), above.alias("alone_above"), "last"]
    kept = tmp.write(kept.select("uid", "n", F.col("e.key").alias("key"), F.col("e.many").alias("many"), "long", *place), "join-kept")
    tmp.release(lists)
    live = _live(kept, percent, tmp)
    kept_live = tmp.write(_rows_of(kept.drop("many", "long"), live, "uid"), "join-kept-live")
    tmp.release(kept, live)
    again = kept_live.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1").select("key")
    out = tmp.write(kept_live.join(again, "key"), "join-entries")
    tmp.release(kept_live)
    return out


def _live(kept: DataFrame, percent: int, tmp: Scratch) -> DataFrame:
    """uid: sets that keep a list longer than SHORT, and those that meet a set they may link with in as many lists as links must share.

    If one of two sets has short lists only, all lists that both keep are short, and every one of them makes a row of the pair.
    """
    rows = kept.filter(F.col("many") <= SHORT).select("uid", "key", "long", F.col("n").alias("lo"), F.col("n").alias("hi"), "from", "to", "alone_below", "alone_above", F.col("last").alias("last_lo"), F.col("last").alias("last_hi"))
    less, more = 100 - percent, 100 + percent
    sizes = (F.col("a.hi") * 100 >= F.col("b.lo") * percent) & (F.col("b.hi") * 100 >= F.col("a.lo") * percent)
    could = sizes & (_least_apart() * more <= (F.col("a.hi") + F.col("b.hi")) * less) & ((F.col("a.long") == 0) | (F.col("b.long") == 0))
    met = rows.alias("a").join(rows.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.uid") < F.col("b.uid")) & could)
    met = met.groupBy(F.col("a.uid").alias("a"), F.col("b.uid").alias("b")).agg(F.count("*").alias("w"), F.first("a.lo").alias("n"), F.first("b.lo").alias("m"))
    n, m = F.col("n"), F.col("m")
    paired = met.filter(F.col("w") >= _need(n, n, m, m, percent)).select(F.explode(F.array("a", "b")).alias("uid"))
    return tmp.write(paired.unionByName(kept.filter("long > 0").select("uid")).distinct(), "join-live")


def _families(entries: DataFrame, tmp: Scratch) -> DataFrame:
    """uid, fam: every set with its centre, itself if it has none. Leads of lists become centres of the sets that share a fifth of their lists with them.

    At the end, families whose centre shares half of its lists with a larger family's become part of that.
    """
    entries = entries.select("uid", "key")
    every = tmp.write(entries.groupBy("uid").agg(F.count("*").alias("many")), "join-sizes")
    found = Steps(entries.sparkSession, "join-families")
    open_, centres = every.select("uid"), every.select("uid").limit(0)
    for _ in range(ROUNDS):
        ranked = open_.select("uid", F.lit(1).alias("rank")).unionByName(centres.select("uid", F.lit(0).alias("rank")))
        now = entries.join(ranked, "uid")
        lead = now.groupBy("key").agg(F.min(F.struct("rank", F.xxhash64("uid").alias("h"), F.col("uid").alias("lead"))).alias("m")).select("key", "m.lead")
        close = now.filter("rank = 1").join(lead, "key").filter("lead <> uid").groupBy("uid", "lead").agg(F.count("*").alias("w"))
        best = close.groupBy("uid").agg(F.max(F.struct("w", "lead")).alias("m")).join(every, "uid").filter("5 * m.w >= many").select("uid", "m.lead")
        best = tmp.write(best, "join-best")
        taken = best.join(best.select(F.col("uid").alias("lead")), "lead", "left_anti").select("uid", F.col("lead").alias("fam"))
        taken = found.add(taken)
        if taken.isEmpty():
            break
        fresh = tmp.write(taken.select(F.col("fam").alias("uid")).distinct(), "join-fresh")
        centres = centres.unionByName(fresh).distinct()
        open_ = open_.join(taken, "uid", "left_anti").join(fresh, "uid", "left_anti")
        open_ = tmp.write(open_, "join-open")
    members = found.all().select("uid", "fam")
    sizes = tmp.write(members.groupBy(F.col("fam").alias("uid")).agg(F.count("*").alias("members")), "join-centres")
    now = entries.join(_sent(sizes), "uid")
    lead = now.groupBy("key").agg(F.min(F.struct(-F.col("members"), F.xxhash64("uid").alias("h"), F.col("uid").alias("lead"))).alias("m")).select("key", "m.lead")
    close = now.join(lead, "key").filter("lead <> uid").groupBy("uid", "lead").agg(F.count("*").alias("w"))
    best = close.groupBy("uid").agg(F.max(F.struct("w", "lead")).alias("m")).join(every, "uid").filter("2 * m.w >= many").select("uid", "m.lead")
    best = tmp.write(best, "join-merged")
    merged = best.join(best.select(F.col("uid").alias("lead")), "lead", "left_anti").select(F.col("uid").alias("fam"), "lead")
    fams = every.select("uid").join(members, "uid", "left").select("uid", F.coalesce("fam", "uid").alias("fam"))
    return tmp.write(fams.join(merged, "fam", "left").select("uid", F.coalesce("lead", "fam").alias("fam")), "join-members")


def _differ(a: str, b: str) -> Column:
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _apart(pairs: DataFrame, arrays: Callable[[DataFrame], DataFrame], tmp: Scratch) -> DataFrame:
    """Adds ``apart``, in how many elements the arrays of a and b differ. ``pairs`` is a written table; only the arrays it names are shuffled."""
    ids = tmp.write(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "join-named-sets")
    arrays = arrays(ids)
    left = arrays.select(F.col("uid").alias("a"), F.col("v").alias("av"))
    right = arrays.select(F.col("uid").alias("b"), F.col("v").alias("bv"))
    met = pairs.join(left, "a").join(right, "b")
    return met.withColumn("apart", F.size("av") + F.size("bv") - 2 * F.size(F.array_intersect("av", "bv"))).drop("av", "bv")


def _rarer(first: str, n: str, m: str, mine: str, theirs: str, percent: int) -> Column:
    """Within families, elements of a difference that are rarer than the rarest common one are no part of the other."""
    less, more = 100 - percent, 100 + percent
    return F.col(first) * 2 * more <= (F.col(n) + F.col(m)) * less + (F.col(mine) - F.col(theirs)) * more


def _least_apart() -> Column:
    """In how many elements the sets of two blocks a and b of one key differ at least."""
    # Elements on each side of the key that only one set has. What no other region has is in no other set if it lies below the key, or in the region that ends first.
    below = F.greatest(
        F.col("a.from") - F.col("b.to") + 2 * F.col("b.alone_below"), F.col("b.from") - F.col("a.to") + 2 * F.col("a.alone_below"), F.col("a.alone_below") + F.col("b.alone_below")
    )
    a_alone = F.when(F.col("a.last_hi") <= F.col("b.last_lo"), F.col("a.alone_above")).otherwise(0)
    b_alone = F.when(F.col("b.last_hi") <= F.col("a.last_lo"), F.col("b.alone_above")).otherwise(0)
    a_more = (F.col("a.lo") - F.col("a.to")) - (F.col("b.hi") - F.col("b.from")) + 2 * b_alone
    b_more = (F.col("b.lo") - F.col("b.to")) - (F.col("a.hi") - F.col("a.from")) + 2 * a_alone
    return below + F.greatest(a_more, b_more, a_alone, b_alone)


def _candidates(blocks: DataFrame, percent: int, within: bool) -> DataFrame:
    """Rows a, b: blocks of one key in two clusters that may hold a link."""
    less, more = 100 - percent, 100 + percent
    a, b = blocks.alias("a"), blocks.alias("b")
    room = (F.col("a.hi") + F.col("b.hi")) * less + (F.col("a.reach") + F.col("b.reach")) * more
    sizes = (F.col("a.hi") * 100 >= F.col("b.lo") * percent) & (F.col("b.hi") * 100 >= F.col("a.lo") * percent) & (F.abs(F.col("a.csize") - F.col("b.csize")) * more <= room)
    if within:
        either = _rarer("a.from", "a.hi", "b.hi", "a.shi", "b.slo", percent) & _rarer("b.from", "a.hi", "b.hi", "b.shi", "a.slo", percent)
        same = (F.col("a.fam") == F.col("b.fam")) & either
    else:
        # Linked sets have ``need`` kept lists in common, so need - 1 more come after the rarest of those on both sides: a pair is taken up only in lists
        # with as many after them, and lists that unrelated sets have in common, the longest of both, give no rows.
        need = _need(*[F.col(f"{s}.{c}") for s in "ab" for c in ("lo", "hi")], percent)
        same = (F.col("a.fam") != F.col("b.fam")) & (_least_apart() * more <= (F.col("a.hi") + F.col("b.hi")) * less) & (F.least("a.later", "b.later") >= need)
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.cluster") < F.col("b.cluster")) & same & sizes)


def _meet(entries: DataFrame, info: DataFrame, arrays: Callable[[DataFrame], DataFrame], percent: int, within: bool, tmp: Scratch) -> DataFrame:
    """(a, b) of linked sets of different clusters, within families or across them, that share a key; some links of clusters that others connect are left out.

    ``entries``: uid, key, from, to (across families all columns of ``_kept``); ``info``: uid, fam, cluster (its centre), r (how far it is from that), n, size (of its array); ``arrays``: uid, v of the sets that a written table of uid names.
    """
    less, more = 100 - percent, 100 + percent
    seen = info.select("uid", "n", "r", "size")
    spread = info.groupBy("cluster").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("r").alias("reach"), F.count("*").alias("many"), F.min("size").alias("slo"), F.max("size").alias("shi"))
    clusters = tmp.write(spread.join(info.select(F.col("uid").alias("cluster"), "fam", F.col("size").alias("csize")), "cluster"), "join-clusters")
    more_of = [] if within else ["later", "alone_below", "alone_above", "last"]
    bounds = [F.max("later").alias("later"), F.min("alone_below").alias("alone_below"), F.min("alone_above").alias("alone_above"), F.min("last").alias("last_lo"), F.max("last").alias("last_hi")]
    held = tmp.write(entries.join(info.select("uid", "cluster"), "uid").select("uid", "key", "cluster", "from", "to", *more_of), "join-held")
    blocks = held.groupBy("key", "cluster").agg(F.min("from").alias("from"), F.max("to").alias("to"), *([] if within else bounds)).join(_sent(clusters), "cluster")
    pairs = _candidates(blocks, percent, within).groupBy(F.col("a.cluster").alias("a"), F.col("b.cluster").alias("b")).agg(
        *[F.first(f"{s}.{c}").alias(s + c) for s in "ab" for c in ("lo", "hi", "reach", "many", "slo")]
    )
    pairs = _apart(tmp.write(pairs, "join-pairs"), arrays, tmp)
    near = tmp.write(pairs.filter(F.col("apart") * more <= (F.col("ahi") + F.col("bhi")) * less + (F.col("areach") + F.col("breach")) * more), "join-near")
    k = (F.col("n") + F.col("m")) * less  # more times the most elements in which linked sets of these sizes differ
    centre = info.select("uid", "n")
    both = near.join(centre.select(F.col("uid").alias("a"), "n"), "a").join(centre.select(F.col("uid").alias("b"), F.col("n").alias("m")), "b")
    direct = both.filter(F.col("apart") * more <= k).select("a", "b")
    # members against the other cluster's centre
    open_ = both.filter((F.col("apart") * more > k) & ((F.col("amany") > 1) | (F.col("bmany") > 1)))
    open_ = tmp.write(open_.select("a", "b", "apart", *[s + c for s in "ab" for c in ("many", "hi", "slo")]), "join-far")
    if open_.isEmpty():
        return direct
    sides = [
        open_.filter(f"{mine}many > 1").select(F.col(mine).alias("cluster"), F.col(theirs).alias("other"), F.col("apart").alias("far"))
        for mine, theirs in (("a", "b"), ("b", "a"))
    ]
    asked = sides[0].unionByName(sides[1]).join(seen.select(F.col("uid").alias("other"), F.col("n").alias("m"), F.col("size").alias("osize")), "other")
    radius = (F.col("far") - F.col("r")) * more <= k
    if within:
        # only members that share an element with that centre which can be their rarest common one; elements that most members
        # have come late in a difference, and what comes too late for every centre that is asked for leaves before the join
        bounds = asked.groupBy("cluster").agg(F.max("m").alias("most"), F.min("osize").alias("least"))
        mine = held.filter("uid <> cluster").join(_sent(tmp.write(bounds, "join-bounds")), "cluster").join(seen, "uid")
        mine = mine.filter(_rarer("from", "n", "most", "size", "least", percent)).select("cluster", "key", "uid", "n", "r", "size", "from")
        centre = held.filter("uid = cluster").select(F.col("uid").alias("other"), "key", F.col("from").alias("ofrom"))
        met = mine.join(asked.join(centre, "other"), ["cluster", "key"])
        met = met.filter(_rarer("from", "n", "m", "size", "osize", percent) & _rarer("ofrom", "n", "m", "osize", "size", percent) & radius)
    else:
        met = asked.join(info.filter("uid <> cluster").select("uid", "cluster", "n", "r"), "cluster").filter(radius)
    met = tmp.write(met.select(F.col("uid").alias("a"), F.col("other").alias("b"), "n", "m", "cluster").distinct(), "join-members-asked")
    tried = _apart(met, arrays, tmp).filter(F.col("apart") * more <= k)
    tried = tmp.write(tried.select("a", "b", F.least("cluster", "b").alias("first"), F.greatest("cluster", "b").alias("second")), "join-tried")
    settled = tried.select(F.col("first").alias("a"), F.col("second").alias("b")).distinct()
    left = tmp.write(open_.filter("amany > 1 AND bmany > 1").join(settled, ["a", "b"], "left_anti"), "join-left")
    direct = direct.unionByName(tried.select("a", "b"))
    if left.isEmpty():
        return direct
    rows = held.join(seen, "uid")
    x = left.join(rows.select(F.col("cluster").alias("a"), "key", F.col("uid").alias("x"), "n", F.col("r").alias("xr"), F.col("size").alias("xsize"), F.col("from").alias("xfrom")), "a")
    y = rows.select(F.col("cluster").alias("b"), "key", F.col("uid").alias("y"), F.col("n").alias("m"), F.col("r").alias("yr"), F.col("size").alias("ysize"), F.col("from").alias("yfrom"))
    could = (F.col("apart") - F.col("xr") - F.col("yr")) * more <= k
    if within:
        x = x.filter(_rarer("xfrom", "n", "bhi", "xsize", "bslo", percent))
        could = could & _rarer("xfrom", "n", "m", "xsize", "ysize", percent) & _rarer("yfrom", "n", "m", "ysize", "xsize", percent)
    could = tmp.write(x.join(y, ["b", "key"]).filter(could).select(F.col("x").alias("a"), F.col("y").alias("b"), "n", "m").distinct(), "join-members-met")
    return direct.unionByName(_apart(could, arrays, tmp).filter(F.col("apart") * more <= k).select("a", "b"))


def _central(few: DataFrame) -> DataFrame:
    """fam, centre: of BIG to twice as many members of each family, drawn by hash, the one with the least sum of distances to all of them.

    Only which links are looked for first depends on it. The sum is that of (members - 2 * members with it) over the elements of a difference, and a constant.
    """
    drawn = few.withColumn("each", F.floor(F.col("many") / BIG)).filter(F.pmod(F.xxhash64("uid"), F.col("each")) == 0)
    item = drawn.select("fam", "uid", (F.col("many") / F.col("each")).alias("of"), F.explode_outer("v").alias("e"))
    with_it = item.groupBy("fam", "e").agg(F.count("*").alias("with_it"))
    cost = F.coalesce(F.sum(F.when(F.col("e").isNotNull(), F.col("of") - 2 * F.col("with_it"))), F.lit(0.0))
    far = item.join(with_it, ["fam", "e"], "left").groupBy("fam", "uid").agg(cost.alias("far"))  # a difference without elements counts nothing
    return far.groupBy("fam").agg(F.min(F.struct("far", "uid")).alias("m")).select("fam", F.col("m.uid").alias("centre"))


def _clusters(d: DataFrame, percent: int, tmp: Scratch) -> DataFrame:
    """uid, cluster, r: who links with the family's centre, or, in large families, with a central one of those that are left."""
    less, more = 100 - percent, 100 + percent
    settled = Steps(d.sparkSession, "join-settled")
    large = tmp.write(d.groupBy("fam").agg(F.count("*").alias("many")).filter(F.col("many") > BIG).select("fam"), "join-large")
    settled.add(d.filter("linked").join(_sent(large), "fam", "left_anti").select("uid", F.col("fam").alias("cluster"), F.col("size").alias("r")))
    left = _rows_of(d, large, "fam").select("uid", "fam", "n", "size", "v")
    while True:
        many = tmp.write(left.groupBy("fam").agg(F.count("*").alias("many")).filter(F.col("many") > BIG), "join-big")
        if many.isEmpty():
            break
        chosen = tmp.write(_central(left.join(_sent(many), "fam")).join(many, "fam").select("fam", "many", "centre"), "join-chosen")
        few = left.join(_sent(chosen), "fam")
        centre = few.filter("uid = centre").select("centre", F.col("n").alias("cn"), F.col("v").alias("cv"))
        x = few.join(centre, "centre").withColumn("apart", F.size("v") + F.size("cv") - 2 * F.size(F.array_intersect("v", "cv")))
        x = tmp.write(x.filter(F.col("apart") * more <= less * (F.col("n") + F.col("cn"))).select("uid", "fam", "many", F.col("centre").alias("cluster"), F.col("apart").alias("r")), "join-round")
        settled.add(x.select("uid", "cluster", "r"))
        # families in which the new centre gathered too little are left to the index of differences
        go_on = tmp.write(x.groupBy("fam").agg(F.count("*").alias("got"), F.first("many").alias("many")).filter("10 * got >= many").select("fam"), "join-go-on")
        left = tmp.write(_rows_of(left, go_on, "fam").join(x.select("uid"), "uid", "left_anti"), "join-rest")
    return settled.all().select("uid", "cluster", "r")


def _sets(docs: DataFrame, some: DataFrame, words: int, percent: int, tmp: Scratch) -> DataFrame:
    """uid, fam, n, items: the whole sets of ``some`` (a written table of doc_id, n, c1, c2, uid, fam and many), read from the texts."""
    ids = tmp.write(some.select(F.col("doc_id").alias("id_")).distinct(), "join-ids")
    again = digests(_rows_of(docs.select("doc_id", "text"), ids, F.col("doc_id").eqNullSafe(F.col("id_"))), words, percent, True)
    same = F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("s.n") == F.col("w.n")) & (F.col("s.c1") == F.col("w.c1")) & (F.col("s.c2") == F.col("w.c2"))
    found = tmp.write(again.alias("s").join(_sent(some).alias("w"), same).select("w.uid", "w.many", "w.fam", "s.n", "s.items"), "join-sets")
    # only rows that repeat a doc_id with its text come more than once
    return found.filter("many = 1").drop("many").unionByName(found.filter("many > 1").drop("many").dropDuplicates(["uid"]))


def _differences(docs: DataFrame, wanted: DataFrame, shingles: int, words: int, percent: int, tmp: Scratch) -> DataFrame:
    """uid, fam, n, cn (the centre's size), v (what it and the centre differ in): all of ``wanted``, their sets read in parts.

    ``shingles``: those of all documents. A family is in one part; members of one that is large for a part are dealt over all, and each part has its centre.
    """
    out = Steps(docs.sparkSession, "join-differences")
    out.add(wanted.filter("uid = fam").select("uid", "fam", "n", F.col("n").alias("cn"), F.array().cast("array<long>").alias("v")))
    led = wanted.filter("uid <> fam").groupBy("fam").agg(F.sum("n").alias("all"), F.count("*").alias("rows"))
    led = led.join(wanted.select(F.col("uid").alias("fam"), F.col("n").alias("cn")), "fam")
    led = tmp.write(led, "join-led")
    held, ids = (x or 0 for x in led.agg(F.sum(F.col("all") + F.col("cn")), F.sum(F.col("rows") + 1)).first())
    parts = max(-(-held // max(shingles // PARTS, PART)), -(-ids * 5 // (4 * SENT_IDS)))
    dealt = F.col("all") * 4 * parts > held
    each = wanted.join(_sent(led.select("fam", dealt.alias("dealt"))), "fam")
    each = tmp.write(each.withColumn("part", F.pmod(F.xxhash64(F.when(F.col("dealt"), F.col("uid")).otherwise(F.col("fam"))), F.lit(max(parts, 1)))), "join-parts")
    for i in range(parts):
        part = Scratch()
        some = each.filter((F.col("part") == i) | (F.col("dealt") & (F.col("uid") == F.col("fam")))).drop("part", "dealt")
        sets = _sets(docs, part.write(some, "join-part"), words, percent, part)
        centre = sets.filter("uid = fam").select("fam", F.col("n").alias("cn"), F.col("items").alias("c_items"))
        out.add(sets.filter("uid <> fam").join(centre, "fam").select("uid", "fam", "n", "cn", _differ("items", "c_items").alias("v")))
        part.release()
    d = out.all().drop("_step")
    d._written_at = out.path
    tmp.written.append(d)
    return d


def _links(docs: DataFrame, wanted: DataFrame, shingles: int, entries: DataFrame, words: int, percent: int, tmp: Scratch) -> DataFrame:
    """(a, b) of linked sets; links between clusters and within them that other links connect are left out."""
    less, more = 100 - percent, 100 + percent
    written = _differences(docs, wanted, shingles, words, percent, tmp)
    d = written.withColumn("size", F.size("v")).withColumn("linked", F.col("size") * more <= less * (F.col("n") + F.col("cn")))
    grouped = _clusters(d, percent, tmp)
    info = d.select("uid", "fam", "n", "size", "linked").join(grouped, "uid", "left")
    info = tmp.write(info.select("uid", "fam", "n", "size", "linked", F.coalesce("cluster", "uid").alias("cluster"), F.coalesce("r", F.lit(0)).alias("r")), "join-info")
    star = info.filter("uid <> cluster").select(F.col("cluster").alias("a"), F.col("uid").alias("b"))
    # who links with the family's centre keeps that link wherever it is clustered: two of those may share no element of their differences
    star = star.unionByName(info.filter("linked AND uid <> fam AND cluster <> fam").select(F.col("fam").alias("a"), F.col("uid").alias("b")))
    # families with one cluster are answered; in others the rarest elements of each difference come first: k + 1 of them, k for the largest set that could link
    mixed = tmp.write(info.groupBy("fam").agg(F.min("cluster").alias("one"), F.max("cluster").alias("two")).filter("one <> two").select("fam"), "join-mixed")
    item = d.filter("uid <> fam").join(mixed, "fam", "left_semi").select("fam", "uid", F.explode("v").alias("e")).select("uid", F.xxhash64("fam", "e").alias("key"))
    count = item.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1").hint("merge")
    shared = item.join(count, "key").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("many", "key"))).alias("shared"))  # at most a difference
    shared = shared.join(_sent(info.select("uid", "n", "size", "linked")), "uid")
    # elements that nobody shares come first and only take up places
    alone = F.col("size") - F.size("shared")
    reach = F.expr(f"({less} * (n + (100 * n) div {percent})) div {more}") + 1
    places = F.greatest(F.when(F.col("linked"), F.col("size")).otherwise(F.least(reach, F.col("size"))) - alone, F.lit(0)).cast("int")
    rare = shared.select("uid", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), places)).alias("place", "s"))
    rank = F.col("alone") + F.col("place")
    rare = rare.select("uid", F.col("s.key"), rank.alias("from"), rank.alias("to"))
    part = Scratch()  # the larger half of the work; its tables and shuffles go before the other half
    inside = tmp.write(_meet(part.write(rare, "join-rare"), info, lambda ids: _rows_of(d.select("uid", "v"), ids, "uid"), percent, True, part), "join-inside")
    part.release()
    tmp.release(written)

    def whole(ids: DataFrame) -> DataFrame:
        return _sets(docs, tmp.write(_rows_of(wanted, ids, "uid"), "join-named-rows"), words, percent, tmp).select("uid", F.col("items").alias("v"))

    outside = _meet(entries, info.withColumn("size", F.col("n").cast("int")), whole, percent, False, tmp)
    return star.unionByName(inside).unionByName(outside)


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (and uid, root: the row and its component's node), one row per row of ``docs``.

    Texts are read again for the sets of documents that may link only, and for those that pairs across families name. Runs a job per step.
    """
    tmp = Scratch()
    regions = tmp.write(digests(docs, words, percent, False).withColumn("uid", F.monotonically_increasing_id()), "join-regions")
    rows = materialize(regions.drop("items"), "join-rows")
    classes = tmp.write(rows.filter("n > 0").groupBy("n", "c1", "c2").agg(F.min("uid").alias("root"), F.min("doc_id").alias("low")), "join-classes")
    nodes = tmp.write(_rows_of(regions.select("uid", "n", "items"), classes.select(F.col("root").alias("uid")), "uid"), "join-nodes")
    tmp.release(regions)
    entries = _kept(nodes, percent, tmp)
    tmp.release(nodes)
    members = _families(entries, tmp)
    alike = rows.groupBy("doc_id", "n", "c1", "c2").agg(F.count("*").alias("many"), F.min("uid").alias("uid"))  # rows of one class have its least uid
    wanted = tmp.write(alike.join(members, "uid"), "join-wanted")
    shingles = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = components(_links(docs, wanted, shingles, entries, words, percent, tmp))
    named = classes.join(roots.withColumnRenamed("root", "top"), classes["root"] == roots["node"], "left").select("n", "c1", "c2", "low", F.coalesce("top", "root").alias("root"))
    named = tmp.write(named, "join-named")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(named.join(least, "root").select("n", "c1", "c2", "root", "component_id"), "join-components")
    tmp.release()
    out = rows.select("doc_id", "n", "c1", "c2", "uid").join(named, ["n", "c1", "c2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "uid", F.coalesce("root", "uid").alias("root"))


def report(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "n_shingles", "component_id")


def one_per_component(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: a row with its least doc_id. Rows with an empty set all stay.

    A digest of the whole row stands for it, so repeated doc_ids stay apart and no text is written; ``docs`` is read again for the result and must give the
    same rows then. Texts are shuffled only if the rows to drop are too many to send, or where a row that stays is repeated.
    """
    digest = F.unhex(row_key(docs))
    named = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", digest.alias("digest"))
    found = join(docs.select(named.alias("doc_id"), "text"), words, percent).filter("n_shingles > 0")
    found = found.select("doc_id.digest", (F.col("doc_id.digest") == F.col("component_id.digest")).alias("stays"))
    found = materialize(found.groupBy("digest", "stays").agg(F.count("*").alias("many")).filter("NOT stays OR many > 1"), "join-gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest.alias("digest"))
    out = rows.join(_sent(found), "digest", "left_anti")
    twice = found.filter("stays").select("digest")
    if not twice.isEmpty():
        out = out.unionByName(_rows_of(rows, twice, "digest").dropDuplicates(["digest"]))
    return out.select("row.*")
