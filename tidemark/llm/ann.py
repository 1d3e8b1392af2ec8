"""Approximate nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is cut into balanced parts with few edges between them; a
softmax classifier learns which part a vector belongs to. It then places every row of the table, and routes a query to its most probable
parts, whose rows are compared exactly. How many parts a query visits is measured, not guessed: a bounded set of queries is answered
by brute force over the whole table, and the least number of parts is taken that finds ``RECALL`` of these answers.

Parts of any size are split into blocks of rows, queries into blocks of queries, and a (part, block) pair is the unit of work:
no part, however popular, is held by one task.

Edge cases: null, zero and non-finite vectors, vectors with null components, of another length than most, or without an id take no part;
rows that repeat a vec_id are one candidate with its best score, and a query never returns its own id; ties go to the smaller id; fewer than ``k``
candidates give all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Bounds: vectors the partitions are learned from, and queries the number of visits is measured with.
SAMPLE, PROBES = 8192, 256
RECALL = 0.95
NEIGHBOURS = 10
ROWS, QUERIES = 4096, 1024


def usable(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, v (array<double>): the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    v = v.filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    return v.filter(F.size("v") == (sizes[0]["dim"] if sizes else 0))


def balanced_parts(x: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Cuts the neighbour graph of ``x`` into parts of nearly equal size: halved along main directions, then improved by moves that keep sizes in bounds."""
    n = len(x)
    near = np.empty((n, min(NEIGHBOURS, n - 1)), "int64")
    for i in range(0, n, 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        near[i : i + 1024] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if near.shape[1] else near[i : i + 1024]
    label = np.zeros(n, "int64")
    todo = [(np.arange(n), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1 or len(rows) < 2:
            label[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        along = y @ np.linalg.eigh(y.T @ y)[1][:, -1]
        left = count // 2
        order = rows[np.argsort(along, kind="stable")]
        at = len(rows) * left // count
        todo += [(order[:at], first, left), (order[at:], first + left, count - left)]
    edges = np.concatenate([np.stack([np.repeat(np.arange(n), near.shape[1]), near.ravel()], 1), np.stack([near.ravel(), np.repeat(np.arange(n), near.shape[1])], 1)])
    low, high = int(0.9 * n / parts), math.ceil(1.1 * n / parts)
    for _ in range(rounds):
        pull = np.zeros((n, parts), "int32")
        np.add.at(pull, (edges[:, 0], label[edges[:, 1]]), 1)
        best = pull.argmax(1)
        gain = pull[np.arange(n), best] - pull[np.arange(n), label]
        sizes, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            a, b = label[i], best[i]
            if sizes[b] < high and sizes[a] > low:
                label[i], moved = b, moved + 1
                sizes[a] -= 1
                sizes[b] += 1
        if moved < n // 500:
            break
    return label


class Router:
    """Softmax classifier from vectors to parts."""

    def __init__(self, x: np.ndarray, label: np.ndarray, parts: int, steps: int = 200):
        self.scale = float(np.sqrt((x**2).sum(1).mean())) or 1.0
        y = x / self.scale
        self.w, self.b = np.zeros((x.shape[1], parts)), np.zeros(parts)
        m, v = [np.zeros_like(self.w), np.zeros_like(self.b)], [np.zeros_like(self.w), np.zeros_like(self.b)]
        truth = np.eye(parts)[label]
        for t in range(1, steps + 1):  # Adam on the whole sample
            p = self.probabilities(x)
            for i, g in enumerate((y.T @ (p - truth) / len(x) + 1e-5 * self.w, (p - truth).mean(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                step = 0.3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-9)
                if i == 0:
                    self.w -= step
                else:
                    self.b -= step

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x / self.scale) @ self.w + self.b
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def ranking(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.probabilities(x), axis=1, kind="stable")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _sample(v: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` vectors, those with the least digests of their ids: the same in every run."""
    rows = v.orderBy(F.xxhash64("id"), "id").limit(n).collect()
    return np.array([r["v"] for r in rows], "float64")


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of each query's ``k`` best distinct ids; ties to smaller ids. Scores are summed one by one, so equal
    vectors score equally. What scores below a query's ``least`` may be left out."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    rough = q @ x.T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    # the k-th best within rounding; equal rows and repeated ids may add more
    if len(ids) > 4 * k:
        border = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
        if len(np.unique(ids)) < len(ids):
            border = np.full(len(q), -np.inf)
    else:
        border = np.full(len(q), -np.inf)
    if least is not None:
        border = np.maximum(border, least)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(border), border, 0)))
    a, b = np.nonzero((rough >= (border - slack)[:, None]) & np.isfinite(rough))
    score = np.empty(len(a))
    for i in range(0, len(a), 65536):
        score[i : i + 65536] = np.einsum("ij,ij->i", q[a[i : i + 65536]], x[b[i : i + 65536]])
    place = np.lexsort((ids[b], -score, a))
    a, b, score = a[place], b[place], score[place]
    if len(np.unique(ids)) < len(ids):  # keep a repeated id once
        _, first = np.unique(np.stack([a, ids[b]], 1), axis=0, return_index=True)
        first.sort()
        a, b, score = a[first], b[first], score[first]
    start = np.searchsorted(a, np.arange(len(q)))
    rank = np.arange(len(a)) - start[a]
    top = rank < k
    return a[top], order[b[top]], score[top]


def learn(v: DataFrame, rows: int) -> Router | None:
    x = _sample(v, SAMPLE)
    if len(x) == 0:
        return None
    parts = int(min(64, max(1, rows // 1000, 1), max(1, len(x) // 64)))
    return Router(x, balanced_parts(x, parts), parts) if parts > 1 else Router(x, np.zeros(len(x), "int64"), 1, 1)


def place(v: DataFrame, router: Router) -> DataFrame:
    """id, v, part for every row."""
    shared = v.sparkSession.sparkContext.broadcast(router)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                part = shared.value.probabilities(_matrix(batch.column(1))).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part.astype("int32"))], names=["id", "v", "part"])

    return v.mapInArrow(run, "id long, v array<double>, part int")


def visits(placed: DataFrame, queries: DataFrame, router: Router, k: int, recall: float = RECALL) -> tuple[int, float]:
    """The least number of parts that finds ``recall`` of the brute-force answers of at most PROBES queries, and the recall found."""
    picked = queries.orderBy(F.xxhash64("id"), "id").limit(PROBES).collect()
    if not picked:
        return 1, 1.0
    q_ids, q = np.array([r["id"] for r in picked]), np.array([r["v"] for r in picked], "float64")
    shared = placed.sparkSession.sparkContext.broadcast((q_ids, q))

    def run(batches):
        ids, mine = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                a, b, s = best(ids, mine, part.column(0).to_numpy(), _matrix(part.column(1)), k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(part.column(0).to_numpy()[b]), pa.array(part.column(2).to_numpy()[b]), pa.array(s)], names=["q", "id", "part", "s"])

    found = placed.mapInArrow(run, "q long, id long, part int, s double").groupBy("q", "id").agg(F.max(F.struct("s", "part")).alias("m"))
    w = Window.partitionBy("q").orderBy(F.desc("m.s"), "id")
    true = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "m.part").collect()  # at most PROBES * k rows
    if not true:
        return 1, 1.0
    where = np.argsort(router.ranking(q), axis=1)  # part -> place in the query's ranking
    place_of = np.array([where[r["q"], r["part"]] for r in true])
    share = np.array([(place_of < m).mean() for m in range(1, where.shape[1] + 1)])
    m = int(np.argmax(share >= recall)) + 1 if (share >= recall).any() else where.shape[1]
    return m, float(share[m - 1])


def _blocks(rows: DataFrame, counts: DataFrame, size: int, more: str = "") -> DataFrame:
    """part, block, ids, data (and the column ``more``): rows of a part packed in blocks of about ``size``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        packed = {"ids": table["id"].to_numpy().astype("<i8"), "data": np.ascontiguousarray(_matrix(table["v"].chunk(0)), "<f8")}
        if more:
            packed[more] = table[more].to_numpy().astype("<f8")
        return pa.table({"part": table["part"][:1], "block": table["block"][:1]} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in packed.items()})

    numbered = rows.join(F.broadcast(counts), "part")  # one row per part, at most 64
    numbered = numbered.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("n") / size)).cast("int"))
    names = ["part", "block", "id", "v", *([more] if more else [])]
    return numbered.select(*names).groupBy("part", "block").applyInArrow(run, "part int, block int, ids binary, data binary" + (f", {more} binary" if more else ""))


def compare(rows: DataFrame, counts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the ``k`` best of every (block of rows, block of queries) of a part. ``rows`` are blocks, ``asked``
    has id, v, part and ``least``, a score that k rows are known to reach."""
    q_counts = materialize(asked.groupBy("part").agg(F.count("*").alias("n")), "ann-counts")
    asked = _blocks(asked, q_counts, QUERIES, "least").join(F.broadcast(counts), "part")
    asked = asked.select("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / ROWS).cast("int") - 1)).alias("block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "least")

    def run(batches):
        for batch in batches:
            for blocks in zip(*(batch.column(i) for i in range(5))):
                ids, data, q_ids, q_data, least = (np.frombuffer(c.as_buffer(), t) for c, t in zip(blocks, ("<i8", "<f8", "<i8", "<f8", "<f8")))
                a, b, s = best(q_ids, q_data.reshape(len(q_ids), -1), ids, data.reshape(len(ids), -1), k, least)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(ids[b]), pa.array(s)], names=["query_id", "vec_id", "score"])

    met = rows.join(asked, ["part", "block"]).select("ids", "data", "q_ids", "q_data", "least")
    return met.mapInArrow(run, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best per query over all blocks; an id that comes more than once counts with its best score."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", column: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``every``, its ``k`` nearest by inner product.

    A query first visits its most probable part. The score of its k-th best there is a floor for all further visits, which so
    return little more than what enters the result.
    """
    spark = vectors.sparkSession
    v = materialize(usable(vectors, id_col, column), "ann-vectors")
    router = learn(v, v.count())
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed = materialize(place(v, router), "ann-placed")
    queries = placed.filter(F.col("id") % every == 0).select("id", "v")
    m, _ = visits(placed, queries, router, k, recall)
    shared = spark.sparkContext.broadcast(router)

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                parts = shared.value.ranking(_matrix(batch.column(1)))[:, :m]
                take = pa.array(np.repeat(np.arange(batch.num_rows), parts.shape[1]))
                visit = np.tile(np.arange(parts.shape[1], dtype="int32"), batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(parts.ravel().astype("int32")), pa.array(visit)], names=["id", "v", "part", "visit"])

    routed = materialize(queries.mapInArrow(route, "id long, v array<double>, part int, visit int"), "ann-routed")
    counts = materialize(placed.groupBy("part").agg(F.count("*").alias("n")), "ann-counts")
    rows = materialize(_blocks(placed, counts, ROWS), "ann-blocks")
    home = routed.filter("visit = 0").withColumn("least", F.lit(float("-inf"))).drop("visit")
    first = materialize(_top(compare(rows, counts, home, k), k).drop("rank"), "ann-first")
    floor = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("least"))
    away = routed.filter("visit > 0").drop("visit").join(floor, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return _top(first.unionByName(compare(rows, counts, away, k)), k)


def report(vectors: DataFrame) -> DataFrame:
    return search(vectors)
