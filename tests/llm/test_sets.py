"""The set join, nearest neighbours and token files against brute force."""

import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import CLASHING, SF, WORD, odd_rows, plain, table, words

from tidemark.llm import ann, packing, setjoin, tokens
from tidemark.session import Scratch, scratch_path

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, n=3):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, percent=90, n=3):
    """(doc_id, set size, least linked id) by comparing all pairs."""
    sets = [shingles(r[1], n) for r in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            o = len(a & b)
            if a and b and 100 * o >= percent * (len(a) + len(b) - o):
                top[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), low.get(find(i), r[0]) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=lambda r: tuple((x is not None, x) for x in r))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        k = rng.randrange(3)
        at = rng.randrange(len(w))
        if k == 0:
            w[at] = f"e{rng.randrange(10**6)}"
        elif k == 1:
            del w[at]
        else:
            w.insert(at, f"e{rng.randrange(10**6)}")
    return " ".join(w)


def families(rng, count, most):
    """Families of edited copies around one text or around each other, sharing passages."""
    rows, passages = [], [words(rng, 55, 10**6) for _ in range(3)]
    for f in range(count):
        centre = words(rng, rng.choice([9, 12, 20, 45, 110, 300]), rng.choice([50, 10**6]))
        if f % 3 == 0:
            centre += " " + rng.choice(passages)
        last = centre
        for _ in range(rng.randrange(1, most)):
            size = len(last.split())
            base = last if f % 2 else centre
            last = edited(rng, base, rng.randrange(0, 2 + size // 25)) or "x"
            rows.append((len(rows), last.upper() if rng.random() < 0.1 else last))
    rng.shuffle(rows)
    return rows


def test_word_digests_follow_words():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a", "B", "ab", " ", "\t", "\n", "é", "É", "数", "z" * 30, "\x0b", "\x1c", " "]) for _ in range(rng.randrange(0, 40)))
        got = list(setjoin.sets_of(pa.array([t, None, t.translate(LOWER)]), 1))
        assert len(got[0]) == len(shingles(t, 1)) and len(got[1]) == 0 and (got[0] == got[2]).all()
    long_text = " ".join(f"w{i % 5000}" for i in range(400_000)) + " " + "y" * 3_000_000 + " end"
    one, two = setjoin.sets_of(pa.array([long_text, "x " + long_text]), 3)
    assert len(one) == len(shingles(long_text)) and len(two) == len(one) + 1


@pytest.mark.parametrize("percent", [90, 80])
def test_linked_sets_share_lists_they_both_keep(percent):
    """No link is lost by the index: the largest differences that still link are tried for many sizes, whatever the lists' lengths."""
    rng = np.random.default_rng(2)
    gone, spare = (lambda n: setjoin.gone(n, percent)), (lambda n: setjoin.spare(n, percent))
    out = lambda n: gone(-(-n * percent // 100)) // 2
    least = 10**9
    for n in [*range(1, 60), 99, 150, 151, 399, 400, 1200, 5000]:
        for _ in range(6):
            a = np.unique(setjoin.mix(rng.integers(0, 2**63, n).astype("uint64")))
            b = a.copy()
            while True:  # one more difference, while they still link
                c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, rng.integers(0, 2**63, dtype="uint64")))
                o = len(np.intersect1d(a, c))
                if 100 * o < percent * (len(a) + len(c) - o):
                    break
                b = c
            kept = []
            for s in (a, b):
                region = s[: gone(len(s)) + spare(len(s))]
                shared = sorted(region, key=lambda e: (int(setjoin.mix(np.array([e]))[0]) % 3, int(e)))  # few lengths, so ties too
                kept.append(set(shared[: len(shared) - out(len(s))]))
            t = -(-percent * (len(a) + len(b)) // (100 + percent))
            need = min(t - len(s) + gone(len(s)) + spare(len(s)) for s in (a, b)) - max(out(len(a)), out(len(b)))
            assert len(kept[0] & kept[1]) >= max(need, 1), (n, len(b))
            least = min(least, need)
    assert least >= 1


def test_versions_with_copies_and_shared_passages(spark, monkeypatch):
    """Two versions of a page, each with many near copies that link with their own version only; pages that share half; a chain between two clusters."""
    monkeypatch.setattr(setjoin, "BIG", 10)
    rng = random.Random(11)
    one = words(rng, 200, 10**6)
    w = one.split()
    two = " ".join(w[:150] + [f"n{i}" for i in range(50)])  # too far from the first
    near = " ".join(w[:176] + [f"m{i}" for i in range(24)])  # its copies may reach both
    rows = [(i, edited(rng, rng.choice([one, two, near]), rng.randrange(0, 5))) for i in range(260)]
    passage = words(rng, 100, 10**6)
    rows += [(1000 + i, passage + " " + words(rng, rng.choice([60, 100, 200]), 10**6)) for i in range(60)]
    for words_, percent in ((3, 90), (5, 80)):
        got = plain(setjoin.join(table(spark, rows), words_, percent), "doc_id", "n_shingles", "component_id")
        assert got == components(rows, percent, words_)


def test_families_hold_similar_sets_only(spark):
    """On the given table no family is much larger than the components and what resembles them: unrelated sets are not chained."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    regions = setjoin.materialize(setjoin.digests(docs, 5, 80, False).selectExpr("*", "monotonically_increasing_id() AS uid"), "test-regions")
    nodes = regions.filter("n > 0").dropDuplicates(["n", "c1", "c2"])
    tmp = Scratch()
    fam = setjoin._families(setjoin._kept(nodes.select("uid", "n", "items"), 80, tmp), tmp)
    found = setjoin.join(docs, 5, 80)
    component = found.filter("n_shingles > 0").groupBy("component_id").count().agg({"count": "max"}).first()[0]
    assert fam.groupBy("fam").count().agg({"count": "max"}).first()[0] <= 3 * component


@pytest.mark.parametrize("seed", [3, 4])
def test_components(spark, seed):
    rows = families(random.Random(seed), 40, 14) + [(10_000 + i, *r[1:2]) for i, r in enumerate(odd_rows())] + [(None, "a b c d e f")] + [(3, "one two three four")] * 3
    got = plain(setjoin.report(table(spark, rows, CLASHING)), "doc_id", "n_shingles", "component_id")
    assert got == components(rows)


def test_components_of_one_large_family(spark):
    rng = random.Random(5)
    centre = words(rng, 120, 10**6)
    rows = [(i, edited(rng, centre, rng.randrange(0, 12))) for i in range(500)]
    assert plain(setjoin.report(table(spark, rows)), "doc_id", "n_shingles", "component_id") == components(rows)


def test_open_members_are_looked_up_not_all_compared(spark, monkeypatch):
    """Copies that do not link with their family's centre meet the members that share a rare difference with them, not every member."""
    asked, arrays = [], []

    class Counted(Scratch):
        def write(self, df, purpose):
            out = super().write(df, purpose)
            if purpose == "join-members-asked":
                asked.append(out.count())
            return out

    apart = setjoin._apart

    def counted(pairs, sets, *more):
        arrays.append(pairs)
        return apart(pairs, sets, *more)

    monkeypatch.setattr(setjoin, "Scratch", Counted)
    monkeypatch.setattr(setjoin, "_apart", counted)
    rng = random.Random(7)
    base = words(rng, 120, 10**6)
    rows = [(i, edited(rng, base, 1)) for i in range(150)] + [(1000 + i, edited(rng, base, 2)) for i in range(100)]
    assert plain(setjoin.report(table(spark, rows)), "doc_id", "n_shingles", "component_id") == components(rows)
    assert 0 < sum(asked) < 3000, asked
    assert all("_written_at" in vars(p) for p in arrays)  # pairs are written first, so that only the sets they name are shuffled


def counted_writes(monkeypatch, *purposes):
    """Rows of the tables of these purposes that joins write, filled in while they run."""
    rows = Counter()

    class Counted(Scratch):
        def write(self, df, purpose):
            out = super().write(df, purpose)
            if purpose in purposes:
                rows[purpose] += out.count()
            return out

    monkeypatch.setattr(setjoin, "Scratch", Counted)
    return rows


def test_large_groups_of_copies_are_clustered_around_central_members(spark, monkeypatch):
    """Copies with few edits link with each other, those with many with few; whichever copy leads the family, pairs to compare stay in proportion to the copies."""
    monkeypatch.setattr(setjoin, "BIG", 20)
    pairs = counted_writes(monkeypatch, "join-pairs")
    rng = random.Random(21)
    base = words(rng, 150, 10**6)
    rows = [(i, edited(rng, base, i % 12)) for i in range(360)]
    rows += [(1000 + i, edited(rng, " ".join(base.split()[:-3] + ["a", "b", "c"]), 1 + i % 3)) for i in range(40)]
    rng.shuffle(rows)
    assert plain(setjoin.report(table(spark, rows)), "doc_id", "n_shingles", "component_id") == components(rows)
    assert pairs["join-pairs"] < 3 * len(rows), pairs


def test_who_links_with_the_family_centre_keeps_that_link(spark, monkeypatch):
    """Members that link with the centre and share no element of their differences with others are still one component, however they are clustered."""
    monkeypatch.setattr(setjoin, "BIG", 6)
    rng = random.Random(22)
    base = words(rng, 100, 10**6).split()
    rows = []
    for i in range(40):  # one changed word each, at places of their own; some with two, far apart
        w = list(base)
        w[(7 * i) % 97] = f"x{i}"
        if i % 5 == 0:
            w[(7 * i + 48) % 97] = f"y{i}"
        rows.append((i, " ".join(w)))
    assert plain(setjoin.join(table(spark, rows), 3, 94), "doc_id", "n_shingles", "component_id") == components(rows, 94, 3)


def test_common_passages_make_no_pairs_across_families(spark, monkeypatch):
    """Unrelated pages with one passage share long lists only, which come too late in both to be their rarest common ones."""
    pairs = counted_writes(monkeypatch, "join-pairs")
    rng = random.Random(23)
    passage = words(rng, 60, 10**6)
    rows = [(i, words(rng, 130, 10**6) + " " + passage) for i in range(200)]
    rows += [(1000 + i, edited(rng, rows[i][1], 2)) for i in range(100)]
    assert plain(setjoin.report(table(spark, rows)), "doc_id", "n_shingles", "component_id") == components(rows)
    assert pairs["join-pairs"] < 300, pairs


def test_lists_of_one_passage_make_no_rows_across_families(spark, monkeypatch):
    """Pages that are alike by a third, in families of their own, meet only in lists that are followed by as many as links share: the passage's are not."""
    rows_made, candidates = [], setjoin._candidates

    def counted(blocks, percent, within):
        out = candidates(blocks, percent, within)
        if not within:
            rows_made.append(out.count())
        return out

    monkeypatch.setattr(setjoin, "_candidates", counted)
    rng = random.Random(24)
    passage = words(rng, 50, 10**6)
    rows = []
    for _ in range(60):  # unrelated texts of a family each, all with the passage
        own = words(rng, 80, 10**6)
        rows += [(len(rows) + k, edited(rng, own + " " + passage, 2)) for k in range(4)]
    got = plain(setjoin.join(table(spark, rows), 5, 80), "doc_id", "n_shingles", "component_id")
    assert got == components(rows, 80, 5)
    assert sum(rows_made) < len(rows), rows_made


def test_sets_that_meet_by_chance_are_not_read_and_others_in_parts(spark, monkeypatch):
    """Texts of few words have many shingles in common with unrelated ones; only those that may link are read whole, a part at a time, and no shuffle files stay."""
    monkeypatch.setattr(setjoin, "PART", 500)
    wanted, sets, write = [], [], setjoin.Scratch.write

    def seen(self, df, purpose):
        out = write(self, df, purpose)
        if purpose in ("join-wanted", "join-sets"):
            (wanted if purpose == "join-wanted" else sets).append(out.count())
        return out

    monkeypatch.setattr(setjoin.Scratch, "write", seen)
    rng = random.Random(26)
    rows = [(i, words(rng, 60, 20)) for i in range(150)]
    for f in range(20):
        base = words(rng, 100, 10**6)
        rows += [(1000 + 10 * f + k, edited(rng, base, k % 4)) for k in range(40 if f == 0 else 4)]
    assert plain(setjoin.report(table(spark, rows)), "doc_id", "n_shingles", "component_id") == components(rows)
    assert wanted[0] < 150 and len(sets) > 4 and max(sets) < 0.6 * wanted[0], (wanted, sets)


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    before = files()
    out = setjoin.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test-shuffled")
    end = time.time() + 20  # executors delete them in the background
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_shingles_of_one_region_part_sets(spark):
    """Two sets of 100 shingles link at 90 % up to 10 that one of them lacks; what no other region has counts below the key, and above it in the region that ends first."""
    for below, above, ends, kept in (([5, 5], [0, 0], [1, 2], 1), ([6, 0], [0, 0], [1, 2], 0), ([0, 0], [6, 0], [1, 2], 0), ([0, 0], [6, 0], [2, 1], 1), ([4, 4], [2, 9], [1, 2], 0)):
        rows = [(1, c + 1, c + 1, 100, 100, 0, 100, 100, 100, 7, 7, 20, below[c], above[c], ends[c], ends[c]) for c in range(2)]
        names = "key cluster fam lo hi reach csize slo shi from to later alone_below alone_above last_lo last_hi".split()
        blocks = spark.createDataFrame(rows, ", ".join(f"`{n}` long" for n in names))
        assert setjoin._candidates(blocks, 90, False).count() == kept, (below, above, ends)


def test_one_per_component_writes_no_texts(spark, monkeypatch):
    """Only digests and numbers are written; repeated rows, ids and nulls stay apart all the same."""
    written, write = [], setjoin.materialize

    def seen(df, purpose):
        written.append(df.schema.simpleString())
        return write(df, purpose)

    monkeypatch.setattr(setjoin, "materialize", seen)
    one = words(random.Random(25), 40)
    rows = [(5, one), (5, one), (5, one.upper()), (7, one), (None, one), (8, "x y"), (8, "x y"), (8, "z z z z z z"), (None, "q r"), (None, "q r"), (9, None), (9, None)]
    docs = table(spark, rows, CLASHING)
    out = setjoin.one_per_component(docs, 5, 80)
    assert out.dtypes == docs.dtypes
    got = plain(out, "doc_id", "text")
    assert [r[0] for r in got] == [None, 5, 8, 8, 9, 9] and {r[1] for r in got if r[0] == 5} <= {one, one.upper()}
    assert written and not [x for x in written if "string" in x], written


def test_one_per_component(spark):
    rows = families(random.Random(6), 12, 8) + [(2000, ""), (2001, ""), (2002, None), (2003, "p q r s"), (2003, "p q r s"), (None, "p q r s")]
    docs = table(spark, rows, CLASHING)
    out = setjoin.one_per_component(docs)
    assert out.dtypes == docs.dtypes
    want = sorted({low for i, n, low in components(rows) if n} | {2000, 2001, 2002})
    assert sorted(r.doc_id for r in out.collect()) == want
    assert setjoin.one_per_component(docs.limit(0)).count() == 0 and setjoin.report(docs.limit(0)).count() == 0


def test_labels_reach_the_end_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in setjoin.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_encoder_equals_the_library(library):
    rng = random.Random(7)
    enc = tokens.Encoder(tokens.public_tokenizer())
    parts = ["a", "B's", "'re", " ", "  ", "\n", "\n\n", "é", "数", "123", "12 ", ".", "!!", "\t", "<|endoftext|>", "’", " ", "_", "²", "Ⅷ", " word", "it's", "́", "😀", " x.y,", " ", "\x1c", "end."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(20_000)]
    for t, got in zip(texts, enc.ids(texts)):
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_tables_start_anew(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    enc, t = tokens.Encoder(tokens.public_tokenizer()), "one two, three. four five; six two one\nseven one two three"
    assert enc.ids([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_files(spark, library):
    rows = odd_rows() + [(3000 - i, words(random.Random(i), 1 + i % 50)) for i in range(300)]
    docs = table(spark, rows, CLASHING).repartition(4)
    manifest, dictionary = tokens.write_ids(docs, scratch_path(spark, "ids"), shards=5)
    got = tokens.read_ids(manifest, dictionary).collect()
    got.sort(key=lambda r: r.start)
    ids = [(r[0], ids_of(library, r[1])) for r in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), crc(x)) for i, x in ids)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    shards = [tokens.ShardReader(m.uri, dictionary) for m in manifest.orderBy("shard").collect()]
    assert sum(map(len, shards)) == len(rows)
    found = next(s.find(2800) for s in shards if s.doc_id(len(s) - 1) is not None and s.doc_id(len(s) - 1) >= 2800)
    assert found.tolist() == dict((i, x) for i, x in ids if i == 2800)[2800]
    with pytest.raises(KeyError):
        shards[0].find(123456)
    with pytest.raises(ValueError):
        tokens.ShardReader(manifest.first().uri, dictionary + b"x")
    assert tokens.report(docs.limit(0)).count() == 0


def check_packing(rows, got, library):
    want, pieces, sequences = Counter(), {}, {}
    for r in got:
        assert 0 < r.length <= 1024
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.piece), Counter())[r.start, r.length, r.ids_crc32] += 1
    for i, t in rows:
        ids = ids_of(library, t)
        first = len(ids) % 1024 or 1024
        borders = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(borders, borders[1:])):
            want[i, k, a, b - a, crc(ids[a:b])] += 1
    assert want == Counter({(i, k, *x): n for (i, k), c in pieces.items() for x, n in c.items()})
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences), -(-sum(r.length for r in got) // 1024)


@pytest.mark.parametrize("group", [8192, 40])
def test_packing(spark, library, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)  # small groups make several levels
    rng = random.Random(8)
    rows = [(r[0], r[1]) for r in odd_rows()] + [(500 + i, words(rng, int(rng.lognormvariate(4, 1)))) for i in range(400)]
    got = packing.report(table(spark, rows, CLASHING)).collect()
    n, least = check_packing(rows, got, library)
    assert n <= 1.01 * least + 2
    assert packing.report(table(spark, rows).limit(0)).count() == 0


def placed(spark, monkeypatch, lengths, group):
    """item -> (sequence, offset), and the largest group of any level."""
    largest, plan = [0], packing._pack_groups

    def watched(items):
        largest[0] = max(largest[0], items.groupBy("grp").count().agg({"count": "max"}).first()[0] or 0)
        return plan(items)

    monkeypatch.setattr(packing, "GROUP", group)
    monkeypatch.setattr(packing, "_pack_groups", watched)
    out = packing.place(spark.createDataFrame(list(enumerate(lengths)), "item long, length long")).collect()
    assert sorted(r.item for r in out) == list(range(len(lengths)))
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, lengths[r.item], r.item))
    for name, parts in sequences.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and min(parts)[2] == name  # named by the item that opened it, so names never clash
    return sequences, largest[0]


def test_packing_groups_stay_bounded_where_nothing_merges(spark, monkeypatch):
    rng = random.Random(12)
    lengths = [rng.randrange(513, 1024) for _ in range(2000)]
    sequences, largest = placed(spark, monkeypatch, lengths, 16)
    assert len(sequences) == len(lengths) and largest <= 4 * 16


def test_packing_merges_the_half_empty_sequences_of_all_groups(spark, monkeypatch):
    rng = random.Random(13)
    lengths = [rng.choice([700, 724, 900, 1000]) for _ in range(1500)] + [300] * 500 + [60] * 30
    sequences, largest = placed(spark, monkeypatch, lengths, 64)
    number, _ = packing.pack(np.array(sorted(lengths, reverse=True)))
    assert len(sequences) <= 1.01 * (number.max() + 1) and largest <= 4 * 64
    half_empty = [p for p in sequences.values() if sum(x[1] for x in p) <= 512]
    assert len(half_empty) <= 1


def test_sum_of_squares_choice():
    """Every placement is the one after which the sum of squares is smallest."""
    rng = np.random.default_rng(9)
    lengths = rng.integers(1, 64, 300)
    number, offset = packing.pack(lengths, 64)
    fill: dict[int, int] = {}
    for s, k, o in zip(lengths.tolist(), number.tolist(), offset.tolist()):
        def total(f):
            c = Counter(64 - x for x in f.values() if x < 64)
            return sum(v * v for v in c.values())

        fits = [j for j, x in fill.items() if x + s <= 64]
        assert o == fill.get(k, 0) and (k in fits if fits else k not in fill)
        if fits:
            assert total({**fill, k: fill[k] + s}) == min(total({**fill, j: fill[j] + s}) for j in fits)
        fill[k] = fill.get(k, 0) + s


def nearest(rows, k=20, every=20):
    keep = [(i, np.asarray(v, "float64")) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 8]
    keep = [(i, v) for i, v in keep if np.isfinite(v).all() and v.any()]
    out = []
    for q in sorted({i for i, _ in keep if i % every == 0}):
        score: dict[int, float] = {}
        for i, v in keep:
            if i != q:
                score[i] = max([score.get(i, -np.inf), *(float((v * w).sum()) for j, w in keep if j == q)])
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(best)]
    return out


def test_nearest_neighbours_edge_cases(spark):
    rng = np.random.default_rng(10)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(300 + i, [0.5] * 8) for i in range(60)]
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [None] * 8), (480, [1.0, 2.0]), (None, [1.0] * 8), (500, [float("inf")] * 8), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, part string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, recall=1.0).collect())
    want = nearest(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)
    few = spark.createDataFrame([(i, [1.0 * i + 1, 2.0]) for i in (0, 1, 2, 20)], "vec_id long, embedding array<double>")
    assert Counter(r.query_id for r in ann.report(few).collect()) == {0: 3, 20: 3}
    assert ann.report(few.limit(0)).count() == 0


def test_nearest_neighbours_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], "float64"), np.array([r.vec_id for r in rows])
    got: dict[int, set[int]] = {}
    for r in ann.report(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hit >= 0.9 * 20 * len(got) and len(got) == (ids % 20 == 0).sum()


def test_partitions_are_balanced_and_learned():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(8, 16)) * 4
    x = centres[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 16)) * 0.3
    label = ann.balanced_parts(x, 8)
    assert np.bincount(label, minlength=8).max() <= 1.15 * 2000 / 8
    router = ann.Router(x[:1500], label[:1500], 8)
    assert (router.probabilities(x[1500:]).argmax(1) == label[1500:]).mean() > 0.7  # held-out rows
