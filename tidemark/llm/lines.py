"""Line dedup by site-relative frequency.

For every host, the share of its pages that contain a line; lines in more than ``ratio`` of a host's pages, and in at least
``least_pages`` of them, are boilerplate there and are dropped from its pages. A line counts once per page,
without white space at its ends; lines without a word are neither counted nor dropped.

Lines travel as 64-bit digests: two lines of one host are taken for one with a chance of 2^-64. A host has at most
(lines of an average page) / ratio boilerplate lines, whatever its size, so they join the pages as one
array per host.

Edge cases: null text stays null; a null host is a host of its own; repeated rows are pages each; a page that loses every
line keeps an empty text; an empty table gives no rows; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

RATIO = 0.1
LEAST_PAGES = 3
ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _digest(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(line, ENDS, ""))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host_, bad: the digests of each host's boilerplate lines. Lines are counted map-side before the shuffle."""
    p = pages.select(F.col(host).cast("string").alias("host_"), F.col(text).cast("string").alias("t_"))
    totals = p.groupBy("host_").agg(F.count("*").alias("pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split("t_", "\n", -1), _has_word), _digest))
    seen = p.select("host_", F.explode(lines).alias("line")).groupBy("host_", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    same = F.col("s.host_").eqNullSafe(F.col("p.host_"))
    over = seen.alias("s").join(totals.alias("p"), same).filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return over.groupBy(F.col("s.host_").alias("host_")).agg(F.sort_array(F.collect_list("line")).alias("bad"))


def clean(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """row (struct of all columns), kept (the text without boilerplate), n_lines and n_dropped. Runs a job for the counts."""
    bad = materialize(boilerplate(pages, host, text, ratio, least_pages), "lines-boilerplate")  # its file size decides the join
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))
    same = F.col(f"r.row.`{host}`").cast("string").eqNullSafe(F.col("b.host_"))
    both = rows.alias("r").join(bad.alias("b"), same, "left")
    lines = F.split(F.col(f"row.`{text}`").cast("string"), "\n", -1)
    both = both.select("row", "bad", lines.alias("lines"))
    stays = F.filter("lines", lambda x: ~(_has_word(x) & F.array_contains("bad", _digest(x))))
    both = both.select("row", "lines", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(stays).alias("stays"))
    return both.select(
        "row", F.array_join("stays", "\n").alias("kept"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("stays"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the remaining text, with a document's source as its host."""
    n = F.when(F.col("row.text").isNull(), F.lit(0).cast("long"))
    return clean(docs).select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(n, F.col("n_lines")).alias("n_lines"), F.coalesce(n, F.col("n_dropped")).alias("n_dropped"), F.col("kept").alias("text"),
    )


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_chars``, if present, counted anew."""
    new = {"text": F.col("kept").alias("text"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long").alias("n_chars")}
    cols = [new[c] if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return clean(docs).select(*cols)


ORACLE = rf"""
WITH pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM lines),
bad AS (SELECT source, k FROM (SELECT source, k, count(DISTINCT doc_id) AS n FROM keyed WHERE k <> '' GROUP BY source, k) JOIN pages USING (source)
  WHERE n >= {LEAST_PAGES} AND n > {RATIO}::DOUBLE * pages),
marked AS (SELECT keyed.*, bad.k IS NOT NULL AS gone FROM keyed LEFT JOIN bad ON keyed.source = bad.source AND keyed.k = bad.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
