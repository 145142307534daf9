"""Centroid clustering of vectors by exact integer rounds with partial-distance search.

Vectors of exactly `dims` components, none null or not finite, take part; a component x is floor(SCALE * x). Components
whose integer is LIMIT or more from zero would not fit the 64-bit sums and are left out with their vectors. Repeated rows
are vectors of their own; without vectors the result is empty; with fewer than k there are as many centroids as vectors.

A round is one pass over the written table of integer vectors: tasks hold the k centroids, assign their rows, and give sums
for each record batch, which an aggregation adds up; only k rows reach the driver. Within a task, squared differences are
added up over the dimensions of the largest variance first; a centroid is given up for a row as soon as its sum is
strictly above the row's best distance so far, and the others go on through all dimensions, so that ties are seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

DIMS, SCALE, LIMIT = 64, 1024, 1 << 27
#: Dimensions that are added up between two looks at what to give up, and rows that one step takes.
PART, STEP = 8, 8192


def integer_vectors(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id and v (array of int) of the rows that take part."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * SCALE))
    fine = (F.size("embedding") == dims) & F.forall("embedding", lambda e: F.coalesce(F.abs(e.cast("double")) * SCALE < LIMIT, F.lit(False)))  # false for NaN
    return vectors.where(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long"), x.cast("array<int>").alias("v"))


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row (the smaller number on ties) and the squared distance, by partial sums over the
    dimensions in the given order."""
    x, c = x[:, order], centroids[:, order]
    every = np.arange(len(x))
    first = ((x[:, None, :part] - c[None, :, :part]) ** 2).sum(2)  # the start of every distance
    best = first.argmin(1)
    least = ((x - c[best]) ** 2).sum(1)
    for k in range(len(c)):
        rows = every[(first[:, k] <= least) & (best != k)]
        total = first[rows, k]
        for a in range(part, x.shape[1], part):
            if not len(rows):
                break
            total = total + ((x[rows, a : a + part] - c[k, a : a + part]) ** 2).sum(1)
            stay = total <= least[rows]
            rows, total = rows[stay], total[stay]
        wins = (total < least[rows]) | (k < best[rows])
        best[rows[wins]], least[rows[wins]] = k, total[wins]
    return best, least


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), dims)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            yield batch.slice(a, STEP)


def _sums(table: DataFrame, centroids: np.ndarray, order: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Rows and componentwise sums of every cluster that has rows."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in _steps(batches):
            x = _matrix(batch.column("v"), dims)
            best, _ = nearest(x, centroids, order)
            n += np.bincount(best, minlength=k)
            np.add.at(total, best, x)
        yield pa.RecordBatch.from_pydict({"k": np.arange(k), "n": n, "total": list(total)}, pa.schema([("k", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

    each = [F.sum(F.get("total", F.lit(j))).alias(f"s{j}") for j in range(dims)]
    rows = table.select("v").mapInArrow(run, "k long, n long, total array<long>").groupBy("k").agg(F.sum("n").alias("n"), *each).where("n > 0").collect()  # k rows
    return {r["k"]: (r["n"], [r[f"s{j}"] for j in range(dims)]) for r in rows}


def _start(table: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of salt:vec_id, in that order (equal ids: the smaller vector first)."""
    rank = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in table.orderBy(rank, "v").limit(k).select("v").collect()], np.int64)  # k rows


def _variances(table: DataFrame, dims: int) -> np.ndarray:
    parts = [F.var_pop(F.get("v", F.lit(j))).alias(str(j)) for j in range(dims)]
    return np.array([x or 0.0 for x in table.agg(*parts).first()], float)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3", dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of the vectors that take part."""
    spark = vectors.sparkSession
    tables = Tables(spark, "centroids")
    table = tables.write(integer_vectors(vectors, dims), "vectors")
    centroids = _start(table, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    order = np.argsort(-_variances(table, dims), kind="stable")
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, total) in _sums(table, centroids, order).items():
            moved[c] = [s // n for s in total]
        if np.array_equal(moved, centroids):  # all later rounds would give the same
            break
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            best, least = nearest(_matrix(batch.column("v"), dims), centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(least, pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = tables.write(table.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = assigned.agg(F.sum("distance").alias("inertia"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    told = sums.join(F.broadcast(names), "cluster").join(F.broadcast(whole))  # k rows, and one
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10, salt: str = "3", dims: int = DIMS) -> str:
    """DuckDB SQL of the same rows over the table embeddings."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (SELECT v.id, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM v JOIN c{i} c ON c.j = v.j GROUP BY ALL),
a{i} AS MATERIALIZED (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT cluster, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{i} JOIN v USING (id) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, c.j, coalesce((s - ((s % n) + n) % n) // n, c.x)::BIGINT AS x FROM c{i} c LEFT JOIN s{i} s ON s.cluster = c.cluster AND s.j = c.j)""")
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {dims}),
v AS MATERIALIZED (SELECT id, unnest(range(1, {dims} + 1)) AS j, floor({SCALE} * unnest(embedding)::DOUBLE)::BIGINT AS x FROM e),
b AS (SELECT id, row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), embedding) - 1 AS cluster FROM e),
c0 AS MATERIALIZED (SELECT cluster, j, x FROM b JOIN v USING (id) WHERE cluster < {k}),{','.join(steps)}
SELECT e.vec_id, a.cluster::INT AS cluster, distance, cast(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, cast(sum(distance) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN e USING (id) JOIN (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY cluster) USING (cluster)"""
