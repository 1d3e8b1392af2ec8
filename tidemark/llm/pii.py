"""Personal data by patterns and a skip-chain conditional random field.

**Patterns** find emails, IP addresses, card numbers and phone numbers (base spans).

**Field.** The tokens that could be personal data (with a digit, an at sign, or equal to one of those) are nodes with the labels
none, email, ip, card, phone. Factors: features of the token and of the word before it; neighbours in the text (chain); and, however far
apart, tokens that are equal or similar (same digits, same address) share a skip factor that favours one label. Loopy
sum-product messages run until they settle; tokens inside base spans are observed. A token that only gets its label
through the document (the same number without its prefix, the same address cut short) becomes an added span. Base spans stay.

**Training.** Weights are log-probability ratios with smoothing: how often features and neighbouring labels occur, over the tokens of a bounded
sample of documents whose labels come from the patterns; features count without what the pattern itself tests, so the
field can label what patterns miss. The skip factor is the log odds of agreement among similar tokens of the sample.

Edge cases: null text is empty; without digits or at signs a text has no nodes; repeated rows are scanned each; an empty table gives no
rows and no weights. Places are code points. Long texts cost linear time: repeated tokens are linked to one of them, never
all to all, and the patterns start only where a match can start.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

KINDS = ["email", "ip", "card", "phone"]
#: Documents the weights are counted on, at most.
SAMPLE_DOCS = 5000
CERTAIN = 0.9
#: Messages settle long before; a bound for graphs on which they do not.
ROUNDS = 200

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match of the next two can only start where a run of digits starts
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: at each at sign the run of local characters before it, not before the end of the last match, and a domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


_EDGE = "\"'()[]{}<>,;:!?*#$%&|."


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[str], str]]:
    """(start, end, number of the word, observed label or 0, features, similarity key) of the tokens that could be personal data."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    words = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    own: dict[int, int] = {}
    starts = np.array([a for a, _ in words])
    for kind, a, b in base:
        for i in range(max(0, int(np.searchsorted(starts, a, side="right")) - 1), int(np.searchsorted(starts, b))):
            own.setdefault(i, kind + 1)
    raw = []
    locals_: set[str] = set()
    for i, (a, b) in enumerate(words):
        w = text[a:b]
        if i in own or "@" in w or _DIGIT.search(w):
            raw.append((i, a, b, w))
            if own.get(i) == 1:
                locals_.add(w.strip(_EDGE).lower().split("@")[0])
    chosen = {i for i, *_ in raw}
    for i, (a, b) in enumerate(words if locals_ else []):
        if i not in chosen and text[a:b].strip(_EDGE).lower() in locals_:
            raw.append((i, a, b, text[a:b]))
    raw.sort()
    out = []
    for i, a, b, w in raw:
        core = w.strip(_EDGE)
        digits = "".join(c for c in core if c in "0123456789")
        before = text[words[i - 1][0] : words[i - 1][1]].strip(_EDGE).lower() if i else ""
        features = [
            f"digits{min(len(digits), 20)}", f"at{min(core.count('@'), 2)}", f"dots{min(core.count('.'), 5)}", f"letters{min(sum(c.isalpha() for c in core), 4)}",
            f"paren{'(' in w}{')' in w}", f"dash{min(core.count('-'), 4)}", f"plus{w.startswith('+')}", f"before:{'number' if _DIGIT.search(before) else before[:12] if len(before) > 1 else ''}",
        ]
        if "@" in core:
            key = "e" + core.lower().split("@")[0]
        elif len(digits) >= 7 and len(digits) * 2 > len(core):
            key = "d" + digits[-7:]
        elif core.lower() in locals_:
            key = "e" + core.lower()
        else:
            key = "w" + core.lower()
        while b > a + 1 and text[b - 1] in _EDGE.replace(")", ""):
            b -= 1
        while a < b - 1 and text[a] in _EDGE.replace("(", ""):
            a += 1
        out.append((a, b, i, own.get(i, 0), features, key))
    return out


def _similar(key: str) -> bool:
    """Whether equal keys say anything: short numbers and words are equal by chance, names of mail addresses are not."""
    return key[0] == "e" or len(key) > 4


def edges_of(nodes: list, hubs: bool = True) -> np.ndarray:
    """(from, to, skip?) : neighbouring words, and each token with the hub of its key: the first observed similar one, else the first.

    So evidence reaches every repeat in one step. Without ``hubs`` each token goes with the last similar one.
    """
    out, last, hub = [], {}, {}
    for j, (_, _, _, label, _, key) in enumerate(nodes):
        if key not in hub or (label and not nodes[hub[key]][3]):
            hub[key] = j
    for j, (_, _, i, _, _, key) in enumerate(nodes):
        if j and nodes[j - 1][2] == i - 1:
            out.append((j - 1, j, 0))
        if _similar(key):
            if hubs and hub[key] != j:
                out.append((hub[key], j, 1))
            elif not hubs and key in last:
                out.append((last[key], j, 1))
        last[key] = j
    return np.array(out, "int64").reshape(-1, 3)


class Weights:
    """Log factors: ``unary[feature][label]``, ``pair[0]`` for neighbours and ``pair[1]`` for similar tokens."""

    def __init__(self, counts: dict):
        labels = np.array([counts["label"].get(str(k), 0) for k in range(5)], float) + 1.0
        self.prior = np.log(labels / labels.sum())
        self.unary: dict[str, np.ndarray] = {}
        for f, by in counts["feature"].items():
            c = np.array([by.get(str(k), 0) for k in range(5)], float)
            # a factor says how much likelier the feature is under a label; ratios of rare features stay near 1
            self.unary[f] = np.log((c + 0.5) / (labels + 1.0)) - np.log((c.sum() + 2.5) / (labels.sum() + 5.0))
        self.pair = np.zeros((2, 5, 5))
        for t in (0, 1):
            c = np.array([[counts["pair"].get(f"{t}{a}{b}", 0) for b in range(5)] for a in range(5)], float) + 0.5
            c = c + c.T
            self.pair[t] = np.log(c / c.sum()) - np.log(np.outer(c.sum(0), c.sum(0)) / c.sum() ** 2)
        same = sum(counts["pair"].get(f"1{a}{a}", 0) for a in range(1, 5)) + 1.0
        other = sum(counts["pair"].get(f"1{a}{b}", 0) for a in range(5) for b in range(5) if a != b) + 1.0
        self.pair[1] = np.where(np.eye(5, dtype=bool), max(np.log(same / other), 1.0), 0.0)


def marginals(nodes: list, edges: np.ndarray, weights: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of every node by loopy sum-product in logs, all messages of a round at once."""
    local = np.array([weights.prior + sum((weights.unary[f] for f in n[4] if f in weights.unary), np.zeros(5)) for n in nodes])
    for j, n in enumerate(nodes):
        if n[3]:
            local[j] = np.where(np.arange(5) == n[3], 0.0, -50.0)
    if len(edges):
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        half, kind = len(edges), np.concatenate([edges[:, 2], edges[:, 2]])
        factor = weights.pair[kind]
        factor[half:] = factor[half:].transpose(0, 2, 1)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        message = np.zeros((2 * half, 5))
        for _ in range(rounds):
            belief = local.copy()
            np.add.at(belief, dst, message)
            out = (belief[src] - message[back])[:, :, None] + factor
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            new = 0.5 * (new + message)
            still = np.abs(new - message).max() < 1e-3
            message = new
            if still:
                break
        np.add.at(local, dst, message)
    p = np.exp(local - local.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], weights: Weights) -> list[tuple[int, int, int]]:
    nodes = nodes_of(text, base)
    if not nodes or all(n[3] for n in nodes):
        return []
    p = marginals(nodes, edges_of(nodes), weights)
    out: list[list[int]] = []
    for n, q in zip(nodes, p):
        k = int(q.argmax())
        if n[3] or not k or q[k] < CERTAIN:
            continue
        if out and out[-1][0] == k - 1 and out[-1][3] == n[2] - 1:  # one span over neighbouring words
            out[-1][2:] = [n[1], n[2]]
        else:
            out.append([k - 1, n[0], n[1], n[2]])
    return [(k, a, b) for k, a, b, _ in out]


def count_features(text: str) -> dict[str, int]:
    """What training counts in one text: labels, features by label, and label pairs by kind of edge."""
    nodes = nodes_of(text, base_spans(text))
    out: dict[str, int] = {}

    def add(key: str) -> None:
        out[key] = out.get(key, 0) + 1

    for n in nodes:
        add(f"l|{n[3]}")
        for f in n[4]:
            add(f"f|{f}|{n[3]}")
    for a, b, t in edges_of(nodes, hubs=False).tolist():  # a repeated number counts by its changes of label
        add(f"p|{t}{nodes[a][3]}{nodes[b][3]}")
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Weights:
    """Weights from at most ``sample_docs`` documents, those with the least digests of their ids."""
    n = docs.count()
    limit = int(min(1.0, sample_docs / max(1, n)) * (1 << 30))
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit).select(text_of().alias("text"))

    def run(batches):
        for batch in batches:
            total: dict[str, int] = {}
            for t in batch.column(0).to_pylist():
                for k, c in count_features(t).items():
                    total[k] = total.get(k, 0) + c
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["key", "n"])

    rows = picked.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # rare features tell nothing; what is left is bounded by the sample
    counts: dict = {"label": {}, "feature": {}, "pair": {}}
    for key, c in rows.filter((F.col("n") >= 3) | ~F.col("key").startswith("f|")).collect():
        parts = key.split("|")
        if parts[0] == "f":
            counts["feature"].setdefault("|".join(parts[1:-1]), {})[parts[-1]] = c
        else:
            counts["label" if parts[0] == "l" else "pair"][parts[1]] = c
    return Weights(counts)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def report(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, counts of base spans per kind, their digest, and all spans as text."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample_docs))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = []
                for t in part.column(1).to_pylist():
                    base = base_spans(t)
                    every = sorted({*base, *added_spans(t, base, shared.value)})
                    rows.append((*(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
