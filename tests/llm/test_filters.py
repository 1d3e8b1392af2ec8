"""Quality rules, line dedup and mixing against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from samples import CLASHING, SF, WORD, odd_rows, plain, table, words

from pyspark.sql import functions as F
from tidemark.llm import lines, mixing, quality
from tidemark.llm.common import documents


def quality_counts(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    kept = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(kept) - len(set(kept)), len(covered)


@pytest.mark.parametrize("extra", [(), CLASHING])
def test_quality_counts(spark, extra):
    rng = random.Random(1)
    rows = odd_rows() + [(100 + i, words(rng, rng.randrange(0, 60), 6) + "\n" + "a b\n" * (i % 4) + "#|" * (i % 3)) for i in range(60)]
    got = plain(quality.report(table(spark, rows, extra)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for r in rows:
        c = quality_counts(r[1])
        want.append((r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_quality_thresholds_follow_their_source(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 100), "plain") for i in range(150)] + [(1000 + i, " | ".join(words(rng, 100).split()), "tables") for i in range(150)]
    rows += [(5000, " | ".join(words(rng, 100).split()), "plain")]
    kept = {r[0] for r in quality.keep_good(table(spark, rows)).select("doc_id").collect()}
    assert kept == {r[0] for r in rows} - {5000}  # pipes are usual in one source and not in the other


def test_quality_small_groups_use_larger_sketches(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 100), "big") for i in range(200)] + [(900, "$$ " * 100 + words(rng, 60), "tiny")]
    got = {r.doc_id: r.kept for r in quality.report(table(spark, rows)).collect()}
    assert not got[900] and all(v for k, v in got.items() if k != 900)


def test_quality_limits_come_from_the_sketches(spark):
    """On the given table the tails, not the least distances, set most limits of every rule but symbols, and good documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = quality.report(docs).cache()
    measured = quality.counts(docs, [F.col("doc_id"), F.col("lang"), F.col("source")])
    good = measured.join(found.filter("NOT base_failed").select("doc_id"), "doc_id", "left_semi")
    own = quality.quantiles(quality.sketches(good), ["lang", "source"]).filter(F.col("docs") >= quality.LEAST_DOCS)
    for rule, (_, times, least) in quality.RULES.items():
        rows = own.filter(F.col("rule") == rule).collect()
        by_tail = sum(times * (r.over - r.middle) > least for r in rows)
        assert rows and (rule == "symbols" or 2 * by_tail > len(rows)), (rule, by_tail, len(rows))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = {(r.quality, r.kept): r["count"] for r in found.filter("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert kept[1, True] > 100 * kept.get((1, False), 0) and kept.get((0, True), 0) == 0
    assert found.filter("kept AND rejected_by <> ''").isEmpty()


def test_quality_stage_keeps_columns_and_rows(spark):
    rows = odd_rows() + odd_rows()
    docs = table(spark, rows, CLASHING)
    out = quality.keep_good(docs)
    assert out.dtypes == docs.dtypes
    assert Counter(r.doc_id for r in out.collect())[5] == 2
    assert quality.keep_good(docs.limit(0)).count() == 0 and quality.report(docs.limit(0)).count() == 0


def line_brute(rows, ratio, least):
    pages, seen = Counter(), defaultdict(int)
    strip = " \t\n\v\f\r"
    for r in rows:
        pages[r[2]] += 1
        for x in {x.strip(strip) for x in (r[1] or "").split("\n") if WORD.search(x)}:
            seen[r[2], x] += 1
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], 0, 0, None))
            continue
        every = r[1].split("\n")
        keep = [x for x in every if not (WORD.search(x) and seen[r[2], x.strip(strip)] >= least and seen[r[2], x.strip(strip)] > ratio * pages[r[2]])]
        out.append((r[0], len(every), len(every) - len(keep), "\n".join(keep)))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def test_line_dedup(spark):
    rng = random.Random(4)
    pool = [words(rng, 5) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(pool[: 3 + i % 28]) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(1, 9))) + ("\nmenu" if i % 3 else ""), rng.choice(["a", "b", None])) for i in range(200)]
    rows += [(r[0], r[1], r[2] if len(r) > 2 else "a") for r in odd_rows()]
    got = plain(lines.report(table(spark, rows, CLASHING)), "doc_id", "n_lines", "n_dropped", "text")
    assert got == line_brute(rows, lines.RATIO, lines.LEAST_PAGES)
    assert any(r[2] for r in got)


def test_line_dedup_stage(spark):
    rows = [(i, f"menu\nown {i}", "a") for i in range(10)] + [(20, None, "a"), (21, "menu", None)]
    docs = table(spark, rows, CLASHING)
    out = lines.without_boilerplate(docs)
    assert out.dtypes == docs.dtypes
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[3] == ("own 3", 5) and got[20] == (None, None) and got[21] == ("menu", 4)
    assert lines.without_boilerplate(docs.limit(0)).count() == 0


def targets_brute(totals, weights=(5, 2, 1), limit=3):
    """The excess of sources at their limit is shared anew until none is above it."""
    names = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in totals else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    whole, fixed = sum(totals.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, share = whole - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / share > limit * totals[s] + 1e-9]
        if not over:
            return fixed | {s: left * w[s] / share for s in free}
        fixed |= {s: limit * totals[s] for s in over}


def test_targets(spark):
    rng = random.Random(6)
    for n in (1, 2, 7, 40):
        totals = {f"s{i}" if i else None: int(10 ** rng.uniform(0, 5)) for i in range(n)}
        df = spark.createDataFrame(list(totals.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        for s, t in targets_brute(totals).items():
            assert math.isclose(got[s], t, rel_tol=1e-9, abs_tol=1e-6)


def test_pivot_keeps_words_and_expectation():
    rng = np.random.default_rng(7)
    size = rng.integers(1, 2000, 300).astype(float)
    part = rng.uniform(0.01, 0.99, 300)
    total = np.zeros(300)
    for _ in range(600):
        out = mixing.pivot(part, size, rng.random(300))
        assert ((out > 0) & (out < 1)).sum() <= 1
        assert math.isclose((out * size).sum(), (part * size).sum(), rel_tol=1e-9)
        total += out
    assert abs(total / 600 - part).max() < 0.1


@pytest.mark.parametrize("bucket", [4096, 8])
def test_mixing(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)  # small buckets make a tree of several levels
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(0, 200)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(400)]
    rows += [(r[0], r[1], r[2] if len(r) > 2 else "a") for r in odd_rows()] + [(5, rows[5][1], "b")] * 30
    docs = table(spark, rows, CLASHING)
    got = mixing.report(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    totals = Counter()
    for r in rows:
        totals[r[2]] += len(WORD.findall(r[1] or ""))
    goal = targets_brute(dict(totals))
    taken = Counter()
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[r.source_size] += r.taken
    most = max(r.size for r in got)
    for s, t in goal.items():
        assert abs(taken[totals[s]] - t) <= most
    assert plain(mixing.report(docs), "doc_id", "size", "taken") == plain(mixing.report(docs.repartition(5)), "doc_id", "size", "taken")


def test_mixing_stage_repeats_rows(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, 50), "a" if i % 4 else "b") for i in range(80)] + [(3, "same words here", "a")] * 4
    docs = table(spark, rows, CLASHING)
    out = mixing.resample(docs)
    assert out.columns == docs.columns
    plan = mixing.report(docs).groupBy("doc_id").sum("taken").collect()
    want = {r[0]: r[1] for r in plan if r[1]}
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.05)
    assert mixing.resample(docs.limit(0)).count() == 0 and mixing.report(docs.limit(0)).count() == 0


def test_mixing_reaches_targets_on_the_test_table(spark):
    rows = mixing.report(documents(spark, SF)).collect()
    by = defaultdict(lambda: [0, 0])
    for r in rows:
        by[r.source_size, r.target][0] += r.taken
        by[r.source_size, r.target][1] = max(by[r.source_size, r.target][1], r.size)
    assert all(abs(t - goal) <= m for (_, goal), (t, m) in by.items())
