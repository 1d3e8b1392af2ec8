"""The pipeline: each stage on its own input, and the queries of this folder against their SQL."""

import random

import pytest
from compare import difference, duck
from samples import CLASHING, SF, odd_rows, table, words
from test_sets import components, families

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import mixing, packing, quality, setjoin
from tidemark.llm.common import documents
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


def test_all_are_registered():
    names = entry.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def test_stages(spark, tmp_path):
    docs = documents(spark, SF)
    columns = docs.dtypes
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if k < 4:
            assert docs.dtypes == columns
        if k == 0:
            assert sorted(ids) == sorted(r.doc_id for r in quality.report(before).filter("kept").collect())
        if k == 1:
            assert sorted(ids) == sorted(r.doc_id for r in before.collect())
        if k == 2:
            assert sorted(ids) == sorted({r.component_id for r in setjoin.join(before, words=5, percent=80).collect()})
        if k == 3:
            taken = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.report(before).collect()}
            assert sum(taken.values()) == pytest.approx(len(ids), abs=len(taken) // 3)
        if k == 4:
            assert docs.columns == packing.report(before).columns
            assert sum(r.length for r in docs.collect()) == sum(r.length for r in packing.report(before).collect())


def test_near_duplicate_stage_is_five_words_and_80_percent(spark):
    """A text of 100 words with two scattered words changed is a near copy at 5 words / 0.8, but not at 3 words / 0.9."""
    rng = random.Random(3)
    rows = families(rng, 30, 10)
    for i in range(4):
        w = [f"q{i}x{k}" for k in range(100)]
        rows += [(1000 + 2 * i, " ".join(w)), (1001 + 2 * i, " ".join("changed" if k in {30, 70} else x for k, x in enumerate(w)))]
    want = {low for _, n, low in components(rows, percent=80, n=5) if n} | {r[0] for r in rows if not (r[1] or "").split()}
    assert all(1000 + 2 * i in want and 1001 + 2 * i not in want for i in range(4))
    docs = table(spark, rows, CLASHING)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == sorted(want)


def test_stages_take_odd_tables(spark):
    rng = random.Random(1)
    docs = table(spark, odd_rows() + [(100 + i, words(rng, 120), "a") for i in range(30)] + odd_rows(), CLASHING)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() >= 0 and stage(spark, docs.limit(0), SF).count() == 0


def test_run_ends_with_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
