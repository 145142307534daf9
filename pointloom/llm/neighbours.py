"""Nearest neighbours by inner product: multiprobe p-stable hashing and exact reranking.

Vectors that are null, zero, of another length than `dims`, or hold null or non-finite components take no part, nor do rows
without vec_id; of rows that share a vec_id the smallest vector counts. Equal vectors are searched, and found, as one and
told apart at the end by ids. With fewer than k other vectors a query finds all of them that it visits.

Inner products become distances: with M the largest length, x gets one more component, sqrt(M^2 - |x|^2), and a query is
scaled to length M. A table hashes a vector by `bits` projections on normal directions, each cut into slots of a width;
a bucket is one slot of each. A query visits buckets in the order of the probability that a neighbour, whose offset along
a direction is normal with the distance to a neighbour as its deviation, falls there, until the probabilities add up to
`success`. Width and probabilities follow that distance, which is measured by exact searches for SAMPLE vectors over all
rows; `bits` grows with the logarithm of the rows, so that buckets stay of one size.

Buckets of more than BLOCK vectors, or with more than VISITS visits, are dealt in blocks of either side, so that a task
holds BLOCK vectors and lets visits stream past; every block gives a query's k best only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, mix

#: Vectors whose neighbours are searched exactly for the distance, vectors of a block, visits of a block, rows of one step.
SAMPLE, BLOCK, VISITS, STEP = 64, 16_384, 65_536, 512
#: Vectors that a bucket should hold, slots that a projection is worth, slots looked at around a query's own. A visit moves a
#: query and k results, about a kilobyte, whatever the bucket holds; buckets are large enough that comparing outweighs that.
BUCKET, SLOTS, REACH = 8192, 3.0, 4


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = (F.size("v") == dims) & F.forall("v", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))) & F.exists("v", lambda e: e != 0.0)
    fine = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long"), x.alias("v")).where(whole)
    return fine.groupBy("vec_id").agg(F.min("v").alias("v"))


def inner(queries: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, added from the first component to the last, whatever stands beside them."""
    total = queries[:, 0] * others[:, 0]
    for j in range(1, queries.shape[1]):
        total = total + queries[:, j] * others[:, j]
    return total


def best_of(queries: np.ndarray, others: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, id and exact score of every query's k best among others (smaller ids on ties)."""
    rough = queries @ others.T
    if rough.shape[1] > k:
        edge = np.partition(rough, rough.shape[1] - k, axis=1)[:, -k]
        slack = 1e-9 * (np.linalg.norm(queries, axis=1) * np.linalg.norm(others, axis=1).max())
        q, o = np.nonzero(rough >= (edge - slack)[:, None])
    else:
        q, o = (a.ravel() for a in np.indices(rough.shape))
    score = inner(queries[q], others[o])
    by = np.lexsort((ids[o], -score, q))
    q, o, score = q[by], o[by], score[by]
    begins = np.searchsorted(q, np.arange(len(queries)))
    keep = np.arange(len(q)) - begins[q] < k
    return q[keep], ids[o[keep]], score[keep]


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _steps(batches: Iterator[pa.RecordBatch], size: int = STEP) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, size):
            yield batch.slice(a, size)


def _found(q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["query", "vec_id", "score"])


_FOUND = "query long, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    """query and near: its k best (vec_id, score), best first; pairs that several tables give count once."""
    once = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k)
    return ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("near"))


def neighbour_distance(points: DataFrame, k: int, longest: float) -> float | None:
    """The median, over SAMPLE vectors, of the distance to their k-th neighbour among all others, from exact searches: each
    task compares its rows with the sample, which is of fixed size."""
    rows = points.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(SAMPLE).select("vec_id", "v").collect()
    ids, sample = np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, BLOCK):
            q, other, score = best_of(sample, _rows(batch.column("v")), np.asarray(batch.column("vec_id")), k + 1)
            yield _found(ids[q], other, score)

    near = _best(points.mapInArrow(run, _FOUND).where("query != vec_id"), k).collect()  # SAMPLE rows
    size = dict(zip(ids.tolist(), np.linalg.norm(sample, axis=1)))
    gaps = [np.sqrt(max(0.0, 2 * longest**2 - 2 * r["near"][-1]["score"] * longest / size[r["query"]])) for r in near]
    return float(np.median(gaps)) if gaps else None


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, within 1.5e-7."""
    a = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * a)
    y = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-a * a)
    return 0.5 * (1 + np.sign(z) * y)


class Hashing:
    """The tables' directions and shifts, drawn from a seed, and the slots and probes of vectors."""

    def __init__(self, dims: int, tables: int, bits: int, width: float, distance: float, longest: float, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.directions = rng.normal(size=(tables, dims + 1, bits))
        self.shifts = rng.uniform(0, width, (tables, bits))
        self.width, self.distance, self.longest = width, distance, longest

    def _key(self, table: int, slots: np.ndarray) -> np.ndarray:
        h = np.full(slots.shape[:-1], table + 1, np.uint64)
        for j in range(slots.shape[-1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + slots[..., j].astype(np.int64).view(np.uint64))
        return h.view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of every row in each table."""
        more = np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(1)))
        x = np.c_[x, more]
        return np.stack([self._key(t, np.floor((x @ a + b) / self.width)) for t, (a, b) in enumerate(zip(self.directions, self.shifts))], 1)

    def probes(self, table: int, x: np.ndarray, success: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and bucket of all visits of queries: from the likeliest bucket down until `success` is reached."""
        x = np.c_[x * (self.longest / np.linalg.norm(x, axis=1))[:, None], np.zeros(len(x))]
        at = x @ self.directions[table] + self.shifts[table]
        own, steps = np.floor(at / self.width), np.arange(-REACH, REACH + 1)
        low = (own[:, :, None] + steps) * self.width - at[:, :, None]
        chance = normal_cdf((low + self.width) / self.distance) - normal_cdf(low / self.distance)
        most = 64
        while True:
            total, moves = np.ones((len(x), 1)), np.zeros((len(x), 1, 0), np.int64)
            for j in range(own.shape[1]):  # the likeliest `most` of all extend the likeliest `most` so far
                grown = (total[:, :, None] * chance[:, j][:, None, :]).reshape(len(x), -1)
                top = np.argsort(-grown, axis=1, kind="stable")[:, :most]
                total = np.take_along_axis(grown, top, 1)
                moves = np.concatenate([np.take_along_axis(moves, (top // len(steps))[:, :, None], 1), steps[top % len(steps)][:, :, None]], 2)
            summed = np.cumsum(total, 1)
            if total.shape[1] < most or (summed[:, -1] >= success).all():
                break
            most *= 4
        row, rank = np.nonzero(np.c_[np.zeros(len(x)), summed[:, :-1]] < success)
        return row, self._key(table, own[row] + moves[row, rank])


def _index(points: DataFrame, h: Hashing) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, BLOCK):
            keys = h.buckets(_rows(batch.column("v")))
            for t in range(keys.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, t], pa.int64()), batch.column("vec_id"), batch.column("v")], ["bucket", "id", "v"])

    return points.select("vec_id", "v").mapInArrow(run, "bucket long, id long, v array<double>")


def _visits(queries: DataFrame, h: Hashing, success: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, 64):
            x = _rows(batch.column("v"))
            for t in range(len(h.directions)):
                row, bucket = h.probes(t, x, success)
                for a in range(0, len(row), BLOCK):
                    piece = pa.array(row[a : a + BLOCK])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + BLOCK], pa.int64()), batch.column("vec_id").take(piece), batch.column("v").take(piece)], ["bucket", "id", "v"])

    return queries.select("vec_id", "v").mapInArrow(run, "bucket long, id long, v array<double>")


def _compared(members: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """query, vec_id and score of the k best of every visit in its block; rows meet by sorting, members first."""
    by = ["bucket", "part", "turn"]
    both = members.withColumn("kind", F.lit(0)).unionByName(visits.withColumn("kind", F.lit(1))).select(*by, "kind", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, x = None, [], None, None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in (*by, "kind")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
                piece, now = batch.slice(a, b - a), tuple(keys[a, :3])
                if now != key:
                    key, held, x = now, [], None
                if not keys[a, 3]:
                    held.append((np.asarray(piece.column("id")), _rows(piece.column("v"))))
                elif held:
                    if x is None:
                        ids, x = np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])
                    for part in _steps(iter([piece])):
                        q, other, score = best_of(_rows(part.column("v")), x, ids, k)
                        yield _found(np.asarray(part.column("id"))[q], other, score)

    return both.repartition(*by).sortWithinPartitions(*by, "kind").mapInArrow(run, _FOUND)


def _dealt(members: DataFrame, visits: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Both with part and turn, the blocks of a bucket's vectors and of its visits: either side's rows are dealt by hash, and
    go to every block of the other."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).join(visits.groupBy("bucket").agg(F.count("*").alias("m")), "bucket")
    hot = sizes.where((F.col("n") > BLOCK) | (F.col("m") > VISITS)).select("bucket", F.ceil(F.col("n") / BLOCK).alias("parts"), F.ceil(F.col("m") / VISITS).alias("turns"))
    hot = tables.write(hot, "hot")

    def deal(rows: DataFrame, own: str, blocks: str, other: str, others: str) -> DataFrame:
        known = rows.join(hot, "bucket", "left")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(others), F.lit(1).cast("long")) - 1))
        return known.withColumn(own, F.pmod(F.xxhash64("id"), F.coalesce(F.col(blocks), F.lit(1).cast("long")))).withColumn(other, each).drop("parts", "turns")

    return deal(members, "part", "parts", "turn", "turns"), deal(visits, "turn", "turns", "part", "parts")


def search(vectors: DataFrame, queries: Column, k: int = 20, dims: int = 64, tables: int = 2, success: float = 0.7, width: float = 1.3) -> DataFrame:
    """query_id, rank, vec_id and score: for each row for which `queries` holds, the k nearest that its visits find.

    success: the probability, for each table, that the visits take in a neighbour at the measured distance; width: that of a
    slot, in such distances."""
    spark = vectors.sparkSession
    held = Tables(spark, "neighbours")
    every = held.write(usable(vectors, dims), "vectors")
    # of equal vectors, k and the query itself are enough, as ties go to smaller ids
    ranked = every.withColumn("_r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    points = held.write(ranked.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    asked = held.write(every.where(queries).join(points.select("v", F.col("vec_id").alias("query")), "v").select(F.col("vec_id").alias("query_id"), "query"), "asked")

    told = points.agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).first()
    longest = (told["longest"] or 0.0) * (1 + 1e-12)
    distance = neighbour_distance(points, k, longest) if told["n"] > 1 else None
    if distance is None:
        distance = 1.0
    distance = max(distance, 1e-9 * longest, 1e-300)
    bits = max(2, round(np.log(max(1, told["n"]) / BUCKET) / np.log(SLOTS)))
    hashing = Hashing(dims, tables, bits, width * distance, distance, longest)

    members = held.write(_index(points, hashing), "index")
    sought = points.join(asked.select(F.col("query").alias("vec_id")).distinct(), "vec_id", "left_semi")
    visits = held.write(_visits(sought, hashing, success), "visits")
    found = _best(_compared(*_dealt(members, visits, held), k + 1), k + 1)

    # from equal vectors to their ids
    flat = found.select("query", F.inline("near")).join(points.select("vec_id", "ids"), "vec_id").select("query", "score", F.explode("ids").alias("vec_id"))
    near = flat.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k + 1).alias("near"))
    own = asked.join(near, "query").select("query_id", F.posexplode(F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "hit"))
    return own.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
