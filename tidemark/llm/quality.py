"""Quality rules with adaptive thresholds.

Per document the text gives counts; a mergeable quantile sketch of each rule's measure is kept per language and
source, over the documents that pass the base rules; thresholds are read from the sketches' tails and joined back to the documents.

A threshold lies a multiple of the distance between median and tail quantile away from the median, so it follows how far a group's own texts spread.
Tail, multiple and a small least distance are parameters of each rule. The least distance decides where a tail is one value with the median:
always so for symbols, since clean texts hold none in any group, and rarely for the others. ``rejected_by`` names the rules that a document fails.

The sketch is a grid: measures are whole numbers (thousandths of a share, hundredths of a character), the
sketch holds how many documents fall on each number. Sketches merge by adding counts, so a small
source takes the sketch of its language, and a small language that of all documents. Adding is exact and has
no order: reruns agree.

Edge cases: null text has no words and fails the base rules; null language or source is a group of its own; repeated
rows count each; documents without words enter no sketch; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, text_of
from tidemark.session import materialize

SYMBOLS = r"[#*$%&|<>]"
#: A group below this many documents is too small for a threshold of its own.
LEAST_DOCS = 100
#: Rule -> (tail quantile in thousandths, multiple of its distance from the median, least distance in the measure's unit).
RULES = {"symbols": (900, 10, 20), "dup_lines": (990, 2.5, 100), "repeats": (950, 8, 60), "word_len": (900, 4, 60)}


def counts(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` with the counts of each whole text: no shuffle, no Python."""
    d = docs.select(*keep, text_of().alias("t_"))
    d = d.withColumn("w_", F.regexp_extract_all("t_", F.lit(WORD), F.lit(0)))
    d = d.withColumn("lines_", F.filter(F.split("t_", "\n", -1), lambda x: x.rlike(WORD)))
    n = F.size("w_")
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get("w_", i - 1), F.get("w_", i), F.get("w_", i + 1)))
    d = d.withColumn("h_", F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    # only texts in which a window comes twice pay for the sort
    twice = F.size(F.array_distinct("h_")) < F.size("h_")
    ordered = F.sort_array(F.transform("h_", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    d = d.withColumn("s_", F.when(twice, ordered))
    same = F.filter("s_", lambda x, j: (x["h"] == F.get("s_", j - 1)["h"]) | (x["h"] == F.get("s_", j + 1)["h"]))
    d = d.withColumn("at_", F.sort_array(F.transform(same, lambda x: x["at"])))
    # windows cover words at .. at+2; overlapping windows count a word once
    covered = F.aggregate(
        "at_", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, at: F.struct((a["n"] + at + 3 - F.greatest(at, a["end"])).alias("n"), (at + 3).alias("end")), lambda a: a["n"],
    )
    return d.select(
        *[F.col(f"`{c}`") for c in d.columns if c not in {"t_", "w_", "lines_", "h_", "s_", "at_"}],
        n.cast("long").alias("n_words"),
        F.aggregate("w_", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("t_") - F.length(F.regexp_replace("t_", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.size("lines_").cast("long").alias("n_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def measures() -> dict[str, Column]:
    """Whole-number measures per rule, from the counts; null without words."""
    def share(part: str, of: str, unit: int) -> Column:
        return F.when(F.col(of) > 0, F.expr(f"({unit} * {part}) div {of}"))

    return {
        "symbols": share("n_symbols", "word_chars", 1000),
        "dup_lines": share("n_dup_lines", "n_lines", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000),
        "word_len": share("word_chars", "n_words", 100),
    }


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, rule, value, n: one grid sketch per group and rule."""
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), m.alias("value")) for r, m in measures().items()]))
    return measured.select("lang", "source", cells.alias("c")).select("lang", "source", "c.rule", "c.value").filter("value IS NOT NULL").groupBy(
        "lang", "source", "rule", "value"
    ).agg(F.count("*").alias("n"))


def _of_rule(part: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for r, v in RULES.items() for x in (r, float(v[part]))]), F.col("rule"))


def quantiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Merges sketches to ``group`` and reads median and both tails: least value with at least that share at or below it."""
    merged = sketch.groupBy(*group, "rule", "value").agg(F.sum("n").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*group, "rule").orderBy("value"))
    total = F.sum("n").over(Window.partitionBy(*group, "rule"))
    ranked = merged.withColumn("up_to", up_to).withColumn("docs", total).withColumn("tail", _of_rule(0))
    reaches = lambda share: F.min(F.when(F.col("up_to") * 1000 >= F.col("docs") * share, F.col("value")))
    return ranked.groupBy(*group, "rule").agg(
        F.max("docs").alias("docs"), reaches(1000 - F.col("tail")).alias("under"), reaches(F.lit(500)).alias("middle"), reaches(F.col("tail")).alias("over")
    )


def thresholds(sketch: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per (lang, source): low and high per rule, from the group's own sketch or the next larger one."""
    by_lang = F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.rule") == F.col("b.rule"))
    t = quantiles(sketch, ["lang", "source"]).alias("a").join(quantiles(sketch, ["lang"]).alias("b"), by_lang).join(
        F.broadcast(quantiles(sketch, []).alias("c")), F.col("a.rule") == F.col("c.rule")  # one row per rule
    )
    large = lambda q: F.when(F.col("a.docs") >= least_docs, F.col(f"a.{q}")).when(F.col("b.docs") >= least_docs, F.col(f"b.{q}")).otherwise(F.col(f"c.{q}"))
    t = t.select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("a.rule").alias("rule"), *[large(q).alias(q) for q in ("under", "middle", "over")])
    far = lambda distance: F.greatest(_of_rule(1) * distance, _of_rule(2))
    t = t.withColumn("low", F.col("middle") - far(F.col("middle") - F.col("under"))).withColumn("high", F.col("middle") + far(F.col("over") - F.col("middle")))
    return t.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rule") == r, F.col(e))).alias(f"{r}_{e}") for r in RULES for e in ("low", "high")]
    )


def judge(measured: DataFrame, keep: list[str]) -> DataFrame:
    """Counts -> base verdict and kept; ``measured`` is read twice and so should be a written table."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    limits = materialize(thresholds(sketches(measured.filter(~base))), "quality-thresholds")  # its file size decides how Spark joins it
    outside = [F.when(~m.between(F.col(f"{rule}_low"), F.col(f"{rule}_high")), rule) for rule, m in measures().items()]
    rejected = F.when(base, F.lit("")).otherwise(F.concat_ws(",", *outside))
    same = F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source"))
    both = measured.alias("m").join(limits.alias("t"), same, "left")
    return both.select(*[F.col(f"m.{c}") for c in keep], base.alias("base_failed"), (~base & (rejected == "")).alias("kept"), rejected.alias("rejected_by"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and rejected_by, one row per document."""
    group = [F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    measured = materialize(counts(docs, [F.col("doc_id"), *group]), "quality-counts")
    return judge(measured, ["doc_id", *COUNTS])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Texts are written once, not shuffled."""
    group = [F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    measured = materialize(counts(docs, [whole, *group]), "quality-rows")
    return judge(measured, ["row"]).filter("kept").select("row.*")


_SHARES = {"symbols": ("1000", "n_symbols", "word_chars"), "dup_lines": ("1000", "n_dup_lines", "n_lines"), "repeats": ("1000", "n_repeat_words", "n_words"), "word_len": ("100", "word_chars", "n_words")}


def _case(part: int) -> str:
    return "CASE rule " + " ".join(f"WHEN '{r}' THEN {v[part]}" for r, v in RULES.items()) + " END"


def _quantile_sql(name: str, keys: str) -> str:
    part = f"PARTITION BY {keys}rule"
    return f"""{name} AS (SELECT {keys}rule, max(docs) AS docs, min(value) FILTER (up_to * 1000 >= docs * (1000 - tail)) AS under,
  min(value) FILTER (up_to * 2 >= docs) AS middle, min(value) FILTER (up_to * 1000 >= docs * tail) AS over_
  FROM (SELECT *, {_case(0)} AS tail, sum(n) OVER ({part} ORDER BY value) AS up_to, sum(n) OVER ({part}) AS docs
        FROM (SELECT {keys}rule, value, sum(n) AS n FROM cells GROUP BY ALL)) GROUP BY ALL)"""


def oracle() -> str:
    """The DuckDB statement of ``report`` over documents."""
    good = "NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    cells = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{r}' AS rule, ({u} * {p}) // {o} AS value FROM counts WHERE {o} > 0 AND {good}" for r, (u, p, o) in _SHARES.items())
    order = "CASE m.rule " + " ".join(f"WHEN '{r}' THEN {k}" for k, r in enumerate(RULES)) + " END"
    def large(q: str) -> str:
        return f"CASE WHEN a.docs >= {LEAST_DOCS} THEN a.{q} WHEN b.docs >= {LEAST_DOCS} THEN b.{q} ELSE c.{q} END AS {q}"

    return rf"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM docs),
grams AS (SELECT doc_id, i, w || ' ' || lead(w) OVER d || ' ' || lead(w, 2) OVER d AS g FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams WHERE g IS NOT NULL) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (SELECT doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
measured AS ({cells}),
cells AS (SELECT lang, source, rule, value, count(*) AS n FROM measured GROUP BY ALL),
{_quantile_sql("by_source", "lang, source, ")},
{_quantile_sql("by_lang", "lang, ")},
{_quantile_sql("by_all", "")},
chosen AS (SELECT a.lang, a.source, a.rule, {large("under")}, {large("middle")}, {large("over_")} FROM by_source a JOIN by_lang b ON a.rule = b.rule AND a.lang IS NOT DISTINCT FROM b.lang
  JOIN by_all c ON a.rule = c.rule),
fences AS (SELECT *, middle - greatest({_case(1)} * (middle - under), {_case(2)}) AS low, middle + greatest({_case(1)} * (over_ - middle), {_case(2)}) AS high FROM chosen),
outside AS (SELECT m.doc_id, string_agg(m.rule, ',' ORDER BY {order}) AS rules FROM measured m JOIN fences f ON m.rule = f.rule AND m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
  WHERE m.value < f.low OR m.value > f.high GROUP BY m.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT {good} AS base_failed, {good} AND rules IS NULL AS kept, coalesce(rules, '') AS rejected_by
FROM counts LEFT JOIN outside USING (doc_id)
"""
