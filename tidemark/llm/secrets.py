"""Secret scan: fixed patterns plus a randomness test battery, in DataFrame functions only.

**Patterns** (base kinds): assignments of passwords, tokens and the like, access keys, long hexadecimal strings.

**Battery** (kind ``random``): for unbroken strings of 20 and more letters and digits, the encoding is inferred from the
characters in use (digits, hexadecimal, one case, base 32, ... base 64). Against the hypothesis that characters are drawn
evenly and independently from that alphabet stand three tests:

* chi-squared: the counts of characters against even counts (Wilson-Hilferty);
* runs: the number of stretches above and below the middle of the alphabet (Wald-Wolfowitz);
* serial correlation of neighbouring places in the alphabet, lag 1.

The least of the three p-values is corrected for being the least of three, so random strings have an even distribution of
p and other strings pile up near 0. **Length-aware false-discovery control**: per encoding and length class (and for all together where a
class has few strings), the even part is estimated from p >= 1/2; the cut is the least p above which the share of
other strings is estimated below ``FALSE_SHARE``. Short classes, in which tests tell little, so get high cuts by themselves.

Edge cases: null text is empty; without strings to test no cuts exist and only patterns count; repeated rows are scanned
each; an empty table gives no rows. Positions are code points; a text's spans grow in blocks, so that very long texts with many
matches stay near linear.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.session import materialize

#: Fixed patterns; matches are leftmost, not overlapping per kind, and dropped afterwards where too short.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
FALSE_SHARE = 0.05
#: Encodings in the order in which they are tried: name, characters in use, alphabet in its order.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = [
    ("decimal", "^[0-9]+$", _DIGITS),
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", _LOWER),
    ("upper", "^[A-Z]+$", _UPPER),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("lower36", "^[a-z0-9]+$", _LOWER + _DIGITS),
    ("upper36", "^[A-Z0-9]+$", _UPPER + _DIGITS),
    ("letters", "^[A-Za-z]+$", _UPPER + _LOWER),
    ("base62", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^", _UPPER + _LOWER + _DIGITS + "-_+/"),
]
GRID, BLOCK = 50, 256
LEAST = 50


def found(text: Column, pattern: str, value: int = 0) -> Column:
    """array<struct<start, end, value>> of all matches: lengths of gaps and matches, added up."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    steps = F.zip_with(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len"))),
        values, lambda s, v: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), v.alias("value")),
    )
    spot = "struct<start:int,end:int,value:string>"
    none = F.lit(None).cast(f"array<{spot}>")

    def run(block: Column, at: Column) -> Column:  # places of one block's matches, starting at ``at``
        start = F.struct(at.alias("at"), F.array().cast(f"array<{spot}>").alias("out"))
        add = lambda a, s: F.struct(
            (a["at"] + s["gap"] + s["len"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["len"]).alias("end"), s["value"].alias("value")))).alias("out"),
        )
        return F.aggregate(block, start, add)

    def blocks(steps: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda k: F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{spot}>>").alias("out"))
        return F.aggregate(many, start, lambda a, b: F.transform(F.array(run(b, a["at"])), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))[0], lambda a: F.flatten(a["out"]))

    # each expression below is bound once by a lambda; texts without a match skip all of it
    bound = F.transform(F.array(steps), lambda s: F.when(F.size(s) > 0, blocks(s)).otherwise(none))[0]
    return F.coalesce(F.when(text.rlike(pattern), bound), F.array().cast(f"array<{spot}>"))


def scan(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` with an array of spans for every base kind, and the strings to be tested."""
    d = docs.select(*keep, text_of().alias("t_"))
    assign = F.filter(found(F.col("t_"), ASSIGN, 2), lambda m: F.length(m["value"]) >= 6)
    access = F.filter(found(F.col("t_"), ACCESS), lambda m: F.length(m["value"]) >= 20)
    kept = [f"`{c}`" for c in d.columns if c != "t_"]
    return d.select(*kept, assign.alias("assign"), access.alias("access"), found(F.col("t_"), HEX).alias("hex"), found(F.col("t_"), CANDIDATE).alias("tested"))


def _normal_tail(z: Column) -> Column:
    """P(N > z), by the rational approximation of the error function (absolute error below 1e-6)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding_of(s: Column) -> Column:
    which = F.lit(None).cast("int")
    for i in range(len(ENCODINGS) - 1, -1, -1):
        which = F.when(s.rlike(ENCODINGS[i][1]), i).otherwise(which)
    return which


def battery(strings: DataFrame, s: str = "value") -> DataFrame:
    """Adds encoding (int), length class and p to rows with a string: the three tests and their corrected least p-value."""
    d = strings.withColumn("code", encoding_of(F.col(s)))
    alphabet = F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), F.col("code") + 1)
    d = d.withColumn("alphabet", alphabet).withColumn("k", F.length("alphabet").cast("double")).withColumn("n", F.length(s).cast("double"))
    chars = F.filter(F.split(F.col(s), ""), lambda c: c != "")
    # a lambda binds what each character needs, so that it is worked out once per string
    once = lambda c, then: F.transform(F.array(c), then)[0]
    d = d.withColumn("x", once(F.col("alphabet"), lambda a: F.transform(chars, lambda c: F.instr(a, c))))
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(F.col("n") - F.length(F.replace(F.col(s), c, F.lit(""))), 2))
    d = d.withColumn("chi", F.col("k") / F.col("n") * squares - F.col("n"))
    free = F.col("k") - 1
    chi_z = (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    # runs above and below the middle, given how many lie on each side
    bits = F.array_join(once(F.col("k"), lambda k: F.transform("x", lambda x: F.when(x * 2 > k, "1").otherwise("0"))), "")
    d = d.withColumn("bits", bits)
    runs = F.length(F.regexp_replace(F.regexp_replace("bits", "0+", "0"), "1+", "1")).cast("double")
    ones = F.length(F.replace(F.col("bits"), F.lit("0"), F.lit(""))).cast("double")
    d = d.withColumn("n1", ones).withColumn("n0", F.col("n") - ones)
    mean = 2 * F.col("n0") * F.col("n1") / F.col("n") + 1
    var = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    runs_p = F.when(var > 0, 2 * _normal_tail(F.abs(runs - mean) / F.sqrt(var))).otherwise(F.lit(0.0))
    # lag-1 correlation of the places in the alphabet
    both = F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1), lambda a, b: F.struct(a.cast("double").alias("a"), b.alias("b")))
    sums = F.aggregate("x", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x.cast("double") * x).alias("q")))
    d = d.withColumn("sums", sums).withColumn("next", F.aggregate(both, F.lit(0.0), lambda a, y: a + y["a"] * y["b"]))
    mean = F.col("sums.s") / F.col("n")
    var_y = F.col("sums.q") - mean * F.col("sums.s")
    ends = F.element_at("x", 1) + F.element_at("x", -1)
    r = F.when(var_y > 0, (F.col("next") - mean * (2 * F.col("sums.s") - ends) + (F.col("n") - 1) * mean * mean) / var_y)
    serial_p = F.coalesce(2 * _normal_tail(F.abs((r + 1 / F.col("n")) * F.sqrt(F.col("n")))), F.lit(0.0))
    d = d.withColumn("least", F.least(_normal_tail(chi_z), runs_p, serial_p, F.lit(1.0)))
    d = d.withColumn("p", 1 - F.pow(1 - F.greatest(F.col("least"), F.lit(0.0)), 3)).withColumn("size_class", F.floor(F.log2("n")).cast("int"))
    return d.drop("alphabet", "k", "n", "x", "chi", "bits", "n1", "n0", "sums", "next", "least")


def cuts(tested: DataFrame) -> DataFrame:
    """code, size_class, cut: least p that counts as random. A histogram of p per class is all that is gathered."""
    cell = F.least(F.floor(F.col("p") * GRID), F.lit(GRID - 1)).cast("int")
    hist = tested.groupBy("code", "size_class", cell.alias("cell")).agg(F.count("*").alias("n"))
    up = F.struct(*[F.sum(F.when(F.col("cell") >= i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(GRID)])

    def cut(c: Column) -> Column:
        # expected random strings above the cell's border, from those above 1/2
        best = F.lit(None).cast("double")
        for i in range(GRID - 1, 0, -1):
            even = 2.0 * c[f"c{GRID // 2}"] * (1 - i / GRID)
            fits = (c[f"c{GRID // 2}"] > 0) & (c[f"c{i}"] - even <= FALSE_SHARE * c[f"c{i}"])
            best = F.when(fits, F.lit(i / GRID)).otherwise(best)
        return best

    own = hist.groupBy("code", "size_class").agg(F.sum("n").alias("n"), up.alias("c"))
    pooled = hist.groupBy(F.lit(0).alias("one")).agg(up.alias("all"))
    both = own.withColumn("one", F.lit(0)).join(pooled, "one")
    return both.select("code", "size_class", F.when(F.col("n") >= LEAST, cut(F.col("c"))).otherwise(cut(F.col("all"))).alias("cut")).filter("cut IS NOT NULL")


def find(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and spans: array<struct<kind, start, end>> by start, then kind. Texts are read once; spans are written in between."""
    d = materialize(scan(docs, keep).withColumn("id_", F.monotonically_increasing_id()), "secrets-spans")
    tested = d.filter(F.size("tested") > 0).select("id_", F.explode("tested").alias("m")).select("id_", "m.start", "m.end", "m.value")
    tested = materialize(battery(tested), "secrets-tested")
    border = materialize(cuts(tested), "secrets-cuts")
    random = tested.join(border, ["code", "size_class"]).filter("p >= cut").groupBy("id_").agg(F.collect_list(F.struct("start", "end")).alias("random"))
    d = d.join(random, "id_", "left")
    plain = lambda c, k: F.transform(F.col(c), lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("rank"), m["end"].alias("end")))
    base = F.concat(*[plain(c, k) for k, c in enumerate(KINDS[:3])])
    d = d.withColumn("base", F.sort_array(base))
    # a random string inside a base span is that span's secret already
    new = F.filter(F.coalesce(F.col("random"), F.array().cast("array<struct<start:int,end:int>>")), lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    every = F.sort_array(F.concat("base", F.transform(new, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("rank"), m["end"].alias("end")))))
    kept = [f"`{c}`" for c in d.columns if c not in {"id_", "random", "tested", "base", *KINDS}]
    return d.select(*kept, "base", every.alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["rank"]), m["start"].cast("string"), m["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of base spans, and all spans as text."""
    n = lambda k: F.size(F.filter("base", lambda m: m["rank"] == k)).cast("long")
    return find(docs, [F.col("doc_id")]).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )
