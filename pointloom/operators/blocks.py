"""Blocks of scenes as tasks: nearest points and counts within a radius for dense scenes, where pairs in the plan would be many.

A scene is cut into equal blocks, so many that the fullest holds MOST points; a task gets the points of a block and those
within a margin around it, and looks for neighbours by sorted cells. The plan holds points and results, no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pointloom.lineage import cut

#: Points of the fullest block, its margin not counted; only blocks that can't be made smaller hold more.
MOST = 16_384
#: Pairs that a task holds at once.
PAIRS = 1_000_000


def sound(points: DataFrame, axes: str = "xyz") -> DataFrame:
    """Points whose coordinates are numbers; others are near nothing."""
    for c in axes:
        points = points.where(F.abs(c) < float("inf"))
    return points


def layout(points: DataFrame, axes: str = "xyz", least: float | None = None, most: int = MOST) -> DataFrame:
    """scene_id, lo and hi of each axis, edge (the longest extent) and level: a block's side is edge / 2^level, no less than
    `least`."""
    ends = points.groupBy("scene_id").agg(F.count("*").alias("_n"), *[f(c).alias(f"{n}{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max))])
    ends = ends.withColumn("edge", F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in axes], F.lit(1e-9)) * F.lit(1 + 1e-9))
    deepest = F.lit(24) if least is None else F.greatest(F.lit(0), F.floor(F.log2(F.col("edge") / F.lit(least)))).cast("int")
    first = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / most) / len(axes))).cast("int")
    done, live = None, cut(ends.withColumn("deepest", F.least(F.lit(24), deepest)).withColumn("level", F.least("deepest", first)))
    shape = ["scene_id", *[f"{n}{c}" for c in axes for n in ("lo", "hi")], "edge", "level"]
    while True:
        full = placed(points.select("scene_id", *axes).join(F.broadcast(live.drop("_n")), "scene_id"), axes).groupBy("scene_id", *[f"i{c}" for c in axes]).agg(F.count("*").alias("n"))
        now = live.join(full.groupBy("scene_id").agg(F.max("n").alias("full")), "scene_id")
        now = cut(now.withColumn("more", F.when((F.col("full") > most) & (F.col("level") < F.col("deepest")), F.greatest(F.lit(1), F.ceil(F.log2(F.col("full") / most) / len(axes)))).otherwise(0).cast("int")))
        settled = now.where("more = 0").select(*shape)
        done = settled if done is None else done.unionByName(settled)
        live = now.where("more > 0").withColumn("level", F.least("deepest", F.col("level") + F.col("more"))).drop("full", "more")
        if live.isEmpty():
            return cut(done)


def _side() -> Column:
    return F.col("edge") / F.pow(F.lit(2.0), F.col("level"))


def placed(points: DataFrame, axes: str) -> DataFrame:
    """Points (with their scene's layout) with the numbers of the block that holds them."""
    return points.withColumns({f"i{c}": F.floor((F.col(c) - F.col(f"lo{c}")) / _side()) for c in axes})


def around(points: DataFrame, axes: str, margin: Column) -> DataFrame:
    """Points once for every block that holds them or is no further than the margin."""
    wide = margin * F.lit(1 + 1e-6)
    for c in axes:
        at, last = F.col(c) - F.col(f"lo{c}"), F.floor((F.col(f"hi{c}") - F.col(f"lo{c}")) / _side())
        first, end = (F.least(last, F.greatest(F.lit(0), F.floor((at + s * wide) / _side()))) for s in (-1, 1))
        points = points.withColumn(f"i{c}", F.explode(F.sequence(first, end)))
    return points


def tasks(df: DataFrame) -> int:
    """Partitions by number, as few bytes are much work here."""
    session = df.sparkSession
    return max(session.sparkContext.defaultParallelism * 4, int(session.conf.get("spark.sql.shuffle.partitions")))


# --- inside tasks ----------------------------------------------------------------------------------------------------


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (size[i] numbers) of all i, one after the other."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - size), size)


def pieces(work: np.ndarray, most: int = PAIRS) -> Iterator[slice]:
    """Slices of neighbouring items with about `most` work each, one item at least."""
    total, at = np.cumsum(work), 0
    while at < len(work):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """sqrt(x * x + y * y + z * z) of the differences, added in this order, as SQL does."""
    d = a - b
    d *= d
    total = d[:, 0]
    for k in range(1, d.shape[1]):
        total = total + d[:, k]
    return np.sqrt(total)


class Cells:
    """Points in cells of a size, sorted so that the cells along the last axis are one range."""

    def __init__(self, p: np.ndarray, size: float):
        self.low, self.size = p.min(0), size
        at = np.floor((p - self.low) / size).astype(np.int64)
        self.last = at.max(0)
        self.order = np.argsort(self._key(at), kind="stable")
        self.keys = self._key(at)[self.order]

    def _key(self, at: np.ndarray) -> np.ndarray:
        key = at[:, 0] + 2
        for k in range(1, at.shape[1]):
            key = key * (self.last[k] + 5) + at[:, k] + 2
        return key

    def home(self, q: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((q - self.low) / self.size), -1, self.last + 1).astype(np.int64)

    def ranges(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of points of the ranges around the cells."""
        steps = np.stack(np.meshgrid(*[(-1, 0, 1)] * (at.shape[1] - 1), [0], indexing="ij"), -1).reshape(-1, at.shape[1])
        middle = np.stack([self._key(at + s) for s in steps], 1)
        first = np.searchsorted(self.keys, middle - 1, "left")
        return first, np.searchsorted(self.keys, middle + 1, "right") - first


def nearest(q: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int, reach: float, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of q: the number found, and, one after the other, places in p and distances of the k nearest (by
    distance, then ids) of p that are nearer than reach. Without `every`, those with fewer than k so near get none."""
    m, n = len(q), len(p)
    size, none = np.zeros(m, np.int64), np.zeros(0, np.int64)
    if not m or not n:
        return size, none, np.zeros(0)
    found: list[tuple[np.ndarray, ...]] = []
    wide = np.ptp(p, axis=0)
    extents = wide[wide > 0]
    both = np.maximum(p.max(0), q.max(0)) - np.minimum(p.min(0), q.min(0))
    cell = reach = min(reach, 1.001 * math.sqrt((both * both).sum()) or 1.0)
    if len(extents):
        cell = min(cell, max(0.5 * (np.prod(extents) * 2 * k / n) ** (1 / len(extents)), extents.max() / 2**17))
    for _ in range(20):  # half as wide as long as places have many candidates
        grid = Cells(p, cell)
        if cell <= wide.max() / 2**17 or grid.ranges(grid.home(q))[1].sum() <= 16 * k * m:
            break
        cell /= 2
    todo = np.arange(m)
    while len(todo):
        grid, last = Cells(p, cell), cell >= reach
        home = grid.home(q[todo])
        by = np.argsort(grid._key(home), kind="stable")
        todo, home = todo[by], home[by]
        first, count = grid.ranges(home)
        sorted_p, open_ = p[grid.order], np.ones(len(todo), bool)
        for s in pieces(count.sum(1)):
            per = count[s]
            at = spans(first[s].ravel(), per.ravel())
            who = np.repeat(np.arange(s.start, s.start + len(per)), per.sum(1))
            d = distances(q[todo[who]], sorted_p[at])
            near = d < cell
            who, at, d = who[near], at[near], d[near]
            there = np.bincount(who - s.start, minlength=len(per))
            good = (there >= k) | (last & every)
            open_[s] = ~good
            keep = good[who - s.start]
            who, at, d = who[keep], grid.order[at[keep]], d[keep]
            by = np.lexsort((ids[at], d, who))
            who, at, d = who[by], at[by], d[by]
            starts = np.r_[0, np.cumsum(np.where(good, there, 0))]
            top = np.arange(len(who)) - starts[who - s.start] < k
            found.append((todo[who[top]], at[top], d[top]))
        if last:
            break
        todo, cell = todo[open_], min(cell * 2, reach)
    who, at, d = (np.concatenate([f[j] for f in found]) for j in range(3))
    by = np.argsort(who, kind="stable")
    return np.bincount(who, minlength=m), at[by], d[by]


def _bins(v: np.ndarray, width: float) -> tuple[np.ndarray, int]:
    """The number of each value's bin, from 0 up, and of bins: distinct values where they are few, else equal widths."""
    values, at = np.unique(v, return_inverse=True)
    if len(values) <= 2 * np.ptp(v) / width + 1:
        return at, len(values)
    at = np.floor((v - values[0]) / width).astype(np.int64)
    return at, int(at.max()) + 1


def counts(q: np.ndarray, p: np.ndarray, weights: np.ndarray, radius: float, closed: bool) -> np.ndarray:
    """The weight of p nearer than the radius (with closed, also at it) of each place of q.

    p is sorted along one axis within bins of the other two. A bin's box gives two spans along the axis: what lies in the
    inner one is near and is counted by a difference of running sums, what lies between the two is looked at."""
    axis = int(np.argmax([len(np.unique(p[:, c])) for c in range(p.shape[1])]))
    others = [c for c in range(p.shape[1]) if c != axis]
    wide = np.ptp(p, axis=0)
    expected = len(p) * np.prod([min(1.0, 2 * radius / w) if w > 0 else 1.0 for w in wide])
    width = min(radius, max(radius / 32, 2 * radius * math.sqrt(6.0 / max(expected, 1.0))))
    binned = [_bins(p[:, c], width) for c in others]
    key = np.zeros(len(p), np.int64)
    for at, n in binned:
        key = key * n + at
    by = np.lexsort((p[:, axis], key))
    p, weights, key = p[by], weights[by], key[by]
    names, first = np.unique(key, return_index=True)
    low = np.stack([np.minimum.reduceat(p[:, c], first) for c in others], 1)
    high = np.stack([np.maximum.reduceat(p[:, c], first) for c in others], 1)
    base, total = p[:, axis].min(), np.r_[0, np.cumsum(weights)]
    stride, most = 4 * (wide[axis] + 2 * radius) + 1.0, np.abs(p).max()
    slack, slack_square = 1e-12 * radius + 1e-15 * (len(names) * stride + most), 1e-12 * radius * radius + 1e-14 * radius * most
    along = np.repeat(np.arange(len(names)), np.diff(np.r_[first, len(p)])) * stride + (p[:, axis] - base)
    by = np.lexsort((q[:, axis], *[q[:, c] for c in others]))  # neighbouring places are searched one after the other
    out, here = np.zeros(len(q), weights.dtype), q[by]
    for b in range(len(names)):
        gap = np.maximum(np.maximum(low[b] - here[:, others], here[:, others] - high[b]), 0)
        far = np.maximum(np.abs(here[:, others] - low[b]), np.abs(here[:, others] - high[b]))
        inner, outer = (radius * radius - (x * x).sum(1) for x in (far, gap))
        can = np.flatnonzero(outer > -slack_square)
        if not len(can):
            continue
        x = here[can, axis] - base + b * stride
        reach, sure = np.sqrt(outer[can] + slack_square) + slack, np.sqrt(np.maximum(inner[can] - slack_square, 0)) - slack
        a, z = np.searchsorted(along, x - reach, "left"), np.searchsorted(along, x + reach, "right")
        some = sure > 0
        c = np.where(some, np.searchsorted(along, x - sure, "left"), a)
        e = np.where(some, np.searchsorted(along, x + sure, "right"), a)
        got = total[e] - total[c]
        for f, size in ((a, c - a), (e, z - e)):
            for s in pieces(size + 1):
                at, who = spans(f[s], size[s]), np.repeat(np.arange(s.start, s.start + len(size[s])), size[s])
                if len(at):
                    d = distances(here[can[who]], p[at])
                    near = d <= radius if closed else d < radius
                    got += np.bincount(who[near], weights[at[near]], len(can)).astype(got.dtype)
        out[by[can]] += got
    return out


# --- joins -----------------------------------------------------------------------------------------------------------


def _matrix(table: pa.Table, columns: str) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in columns], 1).reshape(-1, len(columns))


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of a column's values."""
    values = column.to_numpy()
    return values if values.dtype.kind in "iuf" else np.unique(values, return_inverse=True)[1]


def _shaped(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: columns[f.name].cast(f.type) for f in schema}, schema=schema)


def _arrow(df: DataFrame) -> pa.Schema:
    return to_arrow_schema(df.schema)


def neighbour_lists(left: DataFrame, right: DataFrame, k: int, axes: str = "xyz", extra: tuple[str, ...] = (), radius: float | None = None) -> DataFrame:
    """scene_id, left_id, the axes and `found`, an array of (right_id, distance and the extra columns) of the k nearest right
    points by distance, then right_id; with a radius, of those nearer than it. Scenes without right points have no rows.

    Of right points at one place only the first k ids can be found; a task looks up equal places once. A place is settled
    when k points are nearer than the margin of its block; the others go to blocks of four times the side."""
    a = sound(left.select("scene_id", F.col("point_id").alias("left_id"), *[F.col(c).cast("double").alias(c) for c in axes]), axes)
    b = sound(right.select("scene_id", F.col("point_id").alias("right_id"), *[F.col(c).cast("double").alias(c) for c in axes], *[F.col(c).alias(f"to_{c}") for c in extra]), axes)
    first = F.row_number().over(W.partitionBy("scene_id", *axes).orderBy("right_id"))
    b = cut(b.withColumn("_r", first).where(F.col("_r") <= k).drop("_r"))
    sizes = cut(b.groupBy("scene_id").agg(F.count("*").alias("_all")))
    both = b if left is right else a.join(sizes.select("scene_id"), "scene_id", "left_semi").select("scene_id", *axes).unionByName(b.select("scene_id", *axes))
    plan = cut(layout(both, axes, None if radius is None else 2 * radius).join(sizes, "scene_id"))
    row = F.struct("right_id", F.lit(0.0).alias("distance"), *[F.col(f"to_{c}").alias(c) for c in extra])
    empty = a.join(b.select("scene_id", F.array(row).alias("found")), "scene_id").withColumn("settled", F.lit(True)).select("scene_id", "left_id", *axes, "settled", "found")
    schema, kind = _arrow(empty), empty.schema
    inner = schema.field("found").type.value_type

    def run(places: pa.Table, there: pa.Table) -> pa.Table:
        if not places.num_rows:
            return schema.empty_table()
        q, own = np.unique(_matrix(places, axes), axis=0, return_inverse=True)
        own = own.reshape(-1)
        whole = radius is not None or there.num_rows >= places["_all"][0].as_py()
        reach = radius if radius is not None else math.inf if whole else places["_reach"][0].as_py()
        size, at, d = nearest(q, _matrix(there, axes), _ranks(there["right_id"]), k, reach, whole)
        flat = spans((np.cumsum(size) - size)[own], size[own])
        at, there = at[flat], there.combine_chunks()
        parts = {"right_id": there["right_id"].take(at), "distance": pa.array(d[flat])} | {c: there[f"to_{c}"].take(at) for c in extra}
        parts = [(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).cast(inner.field(n).type) for n, x in parts.items()]
        found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[own])].astype(np.int32)), pa.StructArray.from_arrays(parts, fields=list(inner)))
        columns = {c: places[c].combine_chunks() for c in ("scene_id", "left_id", *axes)}
        return _shaped(columns | {"settled": pa.array(np.full(len(own), True) if whole else size[own] == k), "found": found}, schema)

    block, done, rest, rounds = ["scene_id", *[f"i{c}" for c in axes]], None, a, 0
    n = tasks(left)
    while True:
        reach = _side() / 4 if radius is None else F.lit(float(radius))
        here = placed(rest.join(plan, "scene_id").withColumn("_reach", reach), axes).select(*block, "left_id", *axes, "_all", "_reach")
        there = around(b.join(plan, "scene_id"), axes, reach)
        if rounds:
            there = there.join(here.select(*block).distinct(), block, "left_semi")
        there = there.select(*block, "right_id", *axes, *[f"to_{c}" for c in extra])
        out = cut(here.repartition(n, *block).groupBy(*block).cogroup(there.repartition(n, *block).groupBy(*block)).applyInArrow(run, kind))
        good = out.where("settled").drop("settled")
        done = good if done is None else done.unionByName(good)
        rest, rounds = out.where("NOT settled").select("scene_id", "left_id", *axes), rounds + 1
        if radius is not None or rest.isEmpty():
            return done
        rest, plan = cut(rest), cut(plan.withColumn("level", F.col("level") - 2).join(rest.select("scene_id").distinct(), "scene_id", "left_semi"))


def mean_distance(found: str = "found") -> Column:
    """Of an array of neighbour_lists()."""
    return F.aggregate(F.col(f"{found}.distance"), F.lit(0.0), lambda total, d: total + d) / F.size(found)


def neighbour_counts(spots: DataFrame, radius: float, keys: tuple[str, ...] = ("scene_id",), closed: bool = False) -> DataFrame:
    """keys, x, y, z and `neighbours` of distinct places (keys, x, y, z and n, the points there): the points within the radius."""
    named = sound(spots).select(F.struct(*keys).alias("scene_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"], F.col("n").cast("long").alias("n"))
    plan = layout(named, "xyz", 2 * radius)
    block = ["scene_id", "ix", "iy", "iz"]
    there = around(named.join(plan, "scene_id").withColumns({f"h{c}": F.floor((F.col(c) - F.col(f"lo{c}")) / _side()) for c in "xyz"}), "xyz", F.lit(float(radius)))
    there = there.select(*block, *"xyz", "n", ((F.col("hx") == F.col("ix")) & (F.col("hy") == F.col("iy")) & (F.col("hz") == F.col("iz"))).alias("own"))
    kind = named.select("scene_id", *"xyz", F.col("n").alias("neighbours")).schema
    schema = _arrow(named.select("scene_id", *"xyz", F.col("n").alias("neighbours")))

    def run(there: pa.Table) -> pa.Table:
        p, own = _matrix(there, "xyz"), there["own"].to_numpy()
        found = counts(p[own], p, there["n"].to_numpy(), radius, closed) if own.any() else np.zeros(0, np.int64)
        here = there.filter(there["own"])
        return _shaped({c: here[c].combine_chunks() for c in ("scene_id", *"xyz")} | {"neighbours": pa.array(found)}, schema)

    out = there.repartition(tasks(spots), *block).groupBy(*block).applyInArrow(run, kind)
    return out.select(*[F.col(f"scene_id.{c}").alias(c) for c in keys], *"xyz", "neighbours")
