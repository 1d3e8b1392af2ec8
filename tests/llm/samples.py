"""Small tables for the tests of this folder."""

import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that operators use inside.
CLASHING = ["n", "key", "row", "uid", "t_", "w_", "size", "bad", "lines", "kept", "n_words", "target", "base", "part", "host_", "rank", "id_", "spans", "lang_", "items"]


def table(spark, rows, extra=()):
    """(doc_id, text[, source[, lang]]) rows as documents, with extra columns of clashing names."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in extra])


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls, empty and white space texts, a very long one, ties, repeated rows and a null id."""
    rng = random.Random(5)
    long_text = "\n".join(words(rng, 40, 5000) for _ in range(700)) + " " + "z" * 20_000 + "0" * 10_000
    same = words(rng, 80)
    return [
        (1, None, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, long_text, "b"), (5, same, "a"), (6, same, "b"), (7, same, None), (7, same, None),
        (8, "one", "é"), (None, words(rng, 60), "a"), (None, None, "a"), (9, "é" * 300 + " naïve 数字 😀 text\n\nend\n", "b"), (10, words(rng, 70), "b", None),
    ]


def plain(df, *columns):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
