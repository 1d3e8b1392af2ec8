"""Centroid clustering: exact k-means on integer vectors by Shallot search.

Vectors become whole numbers once, so centroids, distances and ties are exact and reruns agree. Every vector remembers its nearest and
second-nearest centroid, an upper bound on its distance to the first and a lower bound on its distance to any other. Centroids that moved
loosen the bounds; while upper < lower nothing is compared. Otherwise the distances to both remembered centroids are taken, the scan
starts from the closer one and goes through that centroid's neighbours from near to far: none beyond the sum of the distances to the nearest and second-nearest found
so far can matter, and this ball shrinks whenever a closer one is found. Survivors are compared as integers, ties to the smaller number.

**Scale.** The integer vectors are written once as a table bucketed by row number below the shared folder. A round reads them next to the
bounds (a few numbers per vector): only the bounds are shuffled to the buckets, never the vectors. Tasks add their vectors up per
centroid before anything leaves them, so a round sends k sums per task, and k centroids (a parameter) reach the driver. Every round's bounds
are a written table, the one before is no longer needed. No step depends on how vectors spread over clusters: a cluster that holds all of them costs the same.

Edge cases: vectors that are null, have another number of components or hold nulls, NaN or infinities take no part and are not returned; a null
vec_id hashes as ``3:``; repeated rows are vectors of their own; of equal hashes the smaller vector starts first; fewer vectors than centroids start fewer; an
empty table gives no rows; other columns are ignored. A component of 2^27 or more after scaling is an error, since
squared distances would leave the long range.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize, scratch_path

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Bytes of vectors in one bucket, about.
BUCKET_BYTES = 1 << 27
#: Bounds are floating-point: they give way by this share, far above rounding and far below what pruning loses.
SLACK = 1e-9

STATE = "uid long, a int, b int, upper double, lower double"


def whole_numbers(column: str, dimensions: int, scale: int) -> Column:
    """floor(scale * x) of every component, null for vectors that take no part."""
    v = F.col(f"`{column}`").cast("array<double>")
    good = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cells = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))))
    large = F.exists(v, lambda x: F.abs(x * F.lit(float(scale))) >= F.lit(float(1 << 27)))
    return F.when(good, F.when(large, F.raise_error(F.lit("a component is too large for whole squared distances"))).otherwise(cells.cast("array<int>")))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to one centroid, exact."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Shallot:
    """The search among one round's centroids, the same in every task."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids.astype("int64")
        apart = np.stack([distances(self.c, c) for c in self.c])
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.sqrt(np.take_along_axis(apart, self.near, axis=1).astype("float64")) * (1 - SLACK)
        self.compared = 0  # distances taken, for tests

    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """a, b, squared distances to both, without anything remembered."""
        d = np.stack([distances(x, c) for c in self.c], axis=1)
        self.compared += d.size
        a = d.argmin(axis=1)  # the first of equals
        rows = np.arange(len(x))
        da = d[rows, a]
        if len(self.c) == 1:
            return a, np.zeros_like(a), da, np.full(len(x), -1)
        d[rows, a] = np.iinfo("int64").max
        b = d.argmin(axis=1)
        return a, b, da, d[rows, b]

    def _closer(self, j: np.ndarray, dj: np.ndarray, a: np.ndarray, da: np.ndarray) -> np.ndarray:
        return (dj < da) | (dj == da) & (j < a)

    def search(self, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``all``, from the remembered nearest and second-nearest centroids."""
        if len(self.c) == 1:
            return self.all(x)
        a, b = a.copy(), b.copy()
        da, db = self._to(x, a), self._to(x, b)
        swap = self._closer(b, db, a, da)  # start from the closer one
        a[swap], b[swap], da[swap], db[swap] = b[swap], a[swap], db[swap], da[swap]
        start, from_start, second = a.copy(), np.sqrt(da.astype("float64")), b.copy()
        for s in np.unique(start):
            rows = np.flatnonzero(start == s)
            for rank in range(1, len(self.c)):
                # whoever matters is at most as far as the second-nearest so far, so no further from the start than this
                ball = (from_start[rows] + np.sqrt(db[rows].astype("float64"))) * (1 + SLACK)
                rows = rows[self.apart[s, rank] <= ball]
                if not len(rows):
                    break
                j = int(self.near[s, rank])
                if j == s:
                    j = int(self.near[s, 0])  # equal centroids: the order may put another first
                fresh = rows[second[rows] != j]
                if not len(fresh):
                    continue
                dj = distances(x[fresh], self.c[j])
                self.compared += len(fresh)
                first = self._closer(j, dj, a[fresh], da[fresh])
                up = fresh[first]
                b[up], db[up] = a[up], da[up]
                a[up], da[up] = j, dj[first]
                other = ~first & self._closer(j, dj, b[fresh], db[fresh])
                b[fresh[other]], db[fresh[other]] = j, dj[other]
        return a, b, da, db

    def _to(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        d = x - self.c[which]
        self.compared += len(x)
        return np.einsum("ij,ij->i", d, d)

    def step(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray):
        """Bounds after the centroids ``moved`` (distances), and new neighbours where the bounds do not settle it."""
        most = np.sort(moved)[::-1]
        rest = np.where(moved == most[0], most[1] if len(most) > 1 else 0.0, most[0])  # the largest move of any other centroid
        a, b, upper, lower = a.copy(), b.copy(), (upper + moved[a]) * (1 + SLACK), (lower - rest[a]) * (1 - SLACK)
        open_ = np.flatnonzero(upper >= lower)
        if len(open_):
            exact = np.sqrt(self._to(x[open_], a[open_]).astype("float64")) * (1 + SLACK)
            upper[open_] = exact
            open_ = open_[exact >= lower[open_]]
        if len(open_):
            a[open_], b[open_], da, db = self.search(x[open_], a[open_], b[open_])
            upper[open_], lower[open_] = self.bounds(da, db)
        return a, b, upper, lower

    @staticmethod
    def bounds(da: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alone = db < 0  # no second centroid
        return np.sqrt(da.astype("float64")) * (1 + SLACK), np.where(alone, np.inf, np.sqrt(np.maximum(db, 0).astype("float64")) * (1 - SLACK))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("int64").reshape(-1, dimensions)


def _seeds(rows: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ids hash least."""
    digest = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in rows.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()], "int64")


def _bucketed(rows: DataFrame, buckets: int) -> str:
    """The name of a table of the rows, one sorted file per bucket of uid, that lies in the shared folder."""
    name, place = f"centroids_{uuid.uuid4().hex}", scratch_path(rows.sparkSession, "centroid-buckets")
    rows.repartition(buckets, "uid").write.bucketBy(buckets, "uid").sortBy("uid").option("path", place).format("parquet").saveAsTable(name)
    return name


def _round(table: DataFrame, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The state of every vector among ``centroids``, and rows without uid with sums per centroid (``sums``: one per component, ``n``: vectors)."""
    dimensions = centroids.shape[1]

    def run(batches):
        search = Shallot(centroids)
        sums, counts = np.zeros(centroids.shape, "int64"), np.zeros(len(centroids), "int64")
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dimensions)
            if moved is None:
                a, b, da, db = search.all(x)
                upper, lower = search.bounds(da, db)
            else:
                a, b, upper, lower = search.step(x, *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)), moved)
            for c in np.unique(a):
                sums[c] += x[a == c].sum(axis=0)
            counts += np.bincount(a, minlength=len(centroids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(a.astype("int32")), pa.array(b.astype("int32")), pa.array(upper), pa.array(lower), pa.nulls(len(x), pa.list_(pa.int64())), pa.nulls(len(x), pa.int64())],
                names=["uid", "a", "b", "upper", "lower", "sums", "n"],
            )
        own = np.flatnonzero(counts)
        if len(own):
            none = pa.nulls(len(own), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(own), pa.int64()), pa.array(own.astype("int32")), pa.nulls(len(own), pa.int32()), none, none, pa.array(sums[own].tolist(), pa.list_(pa.int64())), pa.array(counts[own])],
                names=["uid", "a", "b", "upper", "lower", "sums", "n"],
            )

    return table.mapInArrow(run, f"{STATE}, sums array<long>, n long")


def _averages(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) per component, exact; empty centroids stay."""
    part = state.filter("uid IS NULL")
    cells = part.select("a", F.posexplode("sums").alias("j", "s"), "n").groupBy("a", "j").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s"), F.sum(F.col("n").cast("decimal(28,0)")).alias("n"))
    out = centroids.copy()
    for r in cells.collect():  # k times dimensions rows
        out[r.a, r.j] = int(r.s) // int(r.n)
    return out


def fit(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of all vectors that take part, and the final centroids. Runs a job per round."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), whole_numbers(vector_column, dimensions, scale).alias("v")).filter("v IS NOT NULL")
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v"), "centroid-rows")
    many = rows.count()
    centroids = _seeds(rows, k)
    if not len(centroids):
        kind = T.StructType([T.StructField("vec_id", vectors.schema[id_column].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
        return spark.createDataFrame([], kind), np.zeros((0, dimensions), "int64")
    name = _bucketed(rows, max(spark.sparkContext.defaultParallelism, many * dimensions * 4 // BUCKET_BYTES))
    try:
        table, state, moved = spark.table(name), None, None
        for _ in range(rounds):
            state, before = _assigned(table, state, centroids, moved), centroids
            centroids = _averages(state, centroids)
            moved = np.array([np.sqrt(float(d)) * (1 + SLACK) for d in distances(centroids - before, np.zeros(dimensions, "int64"))])
        state = _assigned(table, state, centroids, moved)
        out = materialize(_measured(table, state, centroids), "centroid-clusters")
    finally:
        spark.sql(f"DROP TABLE {name}")
    return out, centroids


def _known(table: DataFrame, state: DataFrame) -> DataFrame:
    """Vectors next to their bounds; the bucketed side stays where it is."""
    known = state.filter("uid IS NOT NULL").select("uid", "a", "b", "upper", "lower")
    return table.select("uid", "v").join(known, "uid").select("uid", "v", "a", "b", "upper", "lower")


def _assigned(table: DataFrame, state: DataFrame | None, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    if state is None:
        return materialize(_round(table.select("uid", "v"), centroids, None), "centroid-state")
    return materialize(_round(_known(table, state), centroids, moved), "centroid-state")


def _measured(table: DataFrame, state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and the exact squared distance to it."""
    dimensions = centroids.shape[1]

    def run(batches):
        search = Shallot(centroids)
        for batch in batches:
            a = batch.column(2).to_numpy(zero_copy_only=False)
            d = search._to(_matrix(batch.column(1), dimensions), a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a.astype("int32")), pa.array(d)], names=["vec_id", "cluster", "distance"])

    joined = table.join(state.filter("uid IS NOT NULL").select("uid", "a"), "uid").select("vec_id", "v", "a")
    return joined.mapInArrow(run, f"vec_id {joined.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    found, centroids = fit(vectors)
    totals = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    rows = [(c, total, sum(totals.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, total in totals.items()]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The query in SQL: every vector against every centroid in every round."""
    distance = "list_sum(list_transform(list_zip(r.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"""r AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM r) ORDER BY h, v LIMIT {k})",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"a{n} AS MATERIALIZED (SELECT uid, min(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT r.uid, r.vec_id, r.v, c.c, CAST({distance} AS HUGEINT) AS d FROM r, c{n} c) GROUP BY uid)"
        )
        if n < rounds:
            parts.append(f"s{n} AS (SELECT c, j, sum(v[j]) AS s, count(*) AS m FROM a{n}, range(1, {dimensions + 1}) t(j) GROUP BY c, j)")
            parts.append(f"l{n} AS (SELECT c, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY j) AS v FROM s{n} GROUP BY c)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(l.v, o.v) AS v FROM c{n} o LEFT JOIN l{n} l USING (c))")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} f USING (c)"""
