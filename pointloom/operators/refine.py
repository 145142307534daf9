"""Refinement of instance labels: density profiles, splits at valleys, merges of fragments, votes and clean-up.

Profiles are aggregations to a few bins for each cluster; peaks and valleys are array functions over those bins, so
that no task needs a whole cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.lineage import cut

from . import blocks, graph, spatial


def smoothed(counts: str | Column, sigma: float) -> Column:
    """Gaussian smoothing of an array, cut at four sigma, mirrored at both ends."""
    c = F.col(counts) if isinstance(counts, str) else counts
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = [w / sum(weights) for w in weights]

    def at(i: Column, k: int) -> Column:
        j, n = i + k, F.size(c)
        return F.get(c, F.when(j < 0, -j - 1).when(j >= n, 2 * n - 1 - j).otherwise(j)).cast("double")

    def value(_: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for w, k in zip(weights, range(-radius, radius + 1)):
            total = total + at(i, k) * w
        return total

    return F.transform(c, value)


def profiles(points: DataFrame, keys: list[str], along: str, bins: int, sigma: float) -> DataFrame:
    """keys, low, high, counts and smooth: the histogram of a coordinate over equal bins (the largest value is of the
    last), and the same smoothed."""
    ends = points.groupBy(*keys).agg(F.min(along).alias("low"), F.max(along).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    placed = points.join(ends, keys).withColumn("_bin", F.coalesce(F.least(F.floor(F.try_divide(F.col(along) - F.col("low"), width)), F.lit(bins - 1)), F.lit(0)).cast("int"))
    counted = placed.groupBy(*keys, "low", "high", "_bin").agg(F.count("*").alias("_n"))
    per = [F.coalesce(F.sum(F.when(F.col("_bin") == b, F.col("_n"))), F.lit(0)) for b in range(bins)]
    out = counted.groupBy(*keys, "low", "high").agg(F.array(*per).alias("counts"))
    return out.withColumn("smooth", smoothed("counts", sigma))


def with_peaks(table: DataFrame, distance: int, height: float) -> DataFrame:
    """Adds `peaks`: inner local maxima (the middle of a plateau) of at least `height` times the largest value, thinned so
    that any two are `distance` bins apart or more, higher ones first and later ones on ties."""

    @F.pandas_udf("array<int>")
    def found(values: pd.Series) -> pd.Series:
        return values.map(lambda v: peaks(np.asarray(v, float), distance, height))

    return table.withColumn("peaks", found("smooth"))


def peaks(v: np.ndarray, distance: int, height: float) -> list[int]:
    """Peaks of one short profile."""
    tops, i = [], 1
    while i < len(v) - 1:
        end = i
        while end < len(v) - 1 and v[end + 1] == v[i]:
            end += 1
        if v[i - 1] < v[i] and end < len(v) - 1 and v[end + 1] < v[i]:
            tops.append((i + end) // 2)
        i = end + 1
    tops = [t for t in tops if v[t] >= height * v.max()]
    kept: list[int] = []
    for t in sorted(tops, key=lambda t: (-v[t], -t)):
        if all(abs(t - k) >= distance for k in kept):
            kept.append(t)
    return sorted(kept)


def features(points: DataFrame, label: str, more: tuple[str, ...] = ()) -> DataFrame:
    """scene_id, label (and more keys), n, mean and box, lengths along the three principal axes (l1 >= l2 >= l3), the axes,
    and low, the least place along the first axis from the mean.

    Covariances are an aggregation; the eigenvectors of one small matrix for each cluster come from a vectorised
    function; lengths are a second aggregation of projections."""
    known, keys = points.where(F.col(label).isNotNull()), ["scene_id", label, *more]
    names = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    pairs = [(F.covar_samp(a, b) if a != b else F.var_samp(a)).alias(f"_{a}{b}") for a, b in names]
    ends = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    base = known.groupBy(*keys).agg(F.count("*").alias("n"), *ends, *pairs)

    @F.pandas_udf("array<double>")
    def axes(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        m = np.nan_to_num(np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2).astype(float))
        vectors = np.linalg.eigh(m)[1][..., ::-1]
        top = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None, :], axis=1)
        vectors = vectors * np.where(top < 0, -1.0, 1.0)  # the largest part of each axis is positive
        return pd.Series(list(vectors.transpose(0, 2, 1).reshape(len(m), 9)))

    base = base.withColumn("axes", axes(*[f"_{a}{b}" for a, b in names])).drop(*[f"_{a}{b}" for a, b in names])
    base = cut(base)
    along = lambda k: sum(((F.col(c) - F.col(f"mean_{c}")) * F.get("axes", F.lit(3 * k + j)) for j, c in enumerate("xyz")), F.lit(0.0))
    small = base.select(*keys, "axes", *[f"mean_{c}" for c in "xyz"])
    spans = known.join(small, keys).groupBy(*keys).agg(*[(F.max(along(k)) - F.min(along(k))).alias(f"l{k + 1}") for k in range(3)], F.min(along(0)).alias("low"))
    return base.join(spans, keys)


def relabelled(points: DataFrame, label: str, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Clusters linked by edges (scene_id, u, v) take the smallest label among them, or the one of them that is in names
    (scene_id, node)."""
    found = graph.components(edges)
    if names is not None:
        found = cut(found)
        chosen = found.join(names, ["scene_id", "node"]).select("scene_id", "component", F.col("node").alias("_name"))
        found = found.join(chosen, ["scene_id", "component"]).select("scene_id", "node", F.col("_name").alias("component"))
    found = found.where(F.col("node") != F.col("component")).withColumnRenamed("node", label)
    joined = points.join(found, ["scene_id", label], "left")
    return joined.withColumn(label, F.coalesce("component", label)).drop("component")


def merge_fragments(points: DataFrame, label: str, short: float = 0.15, distance: float = 0.20, angle: float = 25.0) -> DataFrame:
    """Each short cluster joins the nearest other one (the smaller label on ties) whose centre is within the distance and
    whose first axis differs by less than the angle; joins are transitive. Centres meet by cells.

    As in a pass from the smallest cluster to the largest (then by label), where each takes its neighbour's name, joined
    clusters are named by the one that joined none, or, where two joined each other, by the one whose turn came last. Longer
    rings do not arise: each would hold equal distances only, of which its smallest label draws both its neighbours."""
    f = cut(features(points, label).select("scene_id", F.col(label).alias("point_id"), "n", "l1", *[F.col(f"mean_{c}").alias(c) for c in "xyz"], F.slice("axes", 1, 3).alias("axis")))
    right = f.select("scene_id", "point_id", *"xyz", F.col("axis").alias("_axis"), F.col("n").alias("_n"))
    near = spatial.radius_join(f.where(F.col("l1") <= short), right, distance, extra=("_axis", "_n"), extra_left=("axis", "n"), closed=True)
    dot = F.abs(F.aggregate(F.zip_with("axis", "_axis", lambda p, q: p * q), F.lit(0.0), lambda a, x: a + x))
    close = near.where((F.col("left_id") != F.col("right_id")) & (F.degrees(F.acos(F.least(dot, F.lit(1.0)))) < angle))
    first = F.min(F.struct("distance", "right_id", "n", "_n"))
    best = cut(close.groupBy("scene_id", F.col("left_id").alias("u")).agg(first.alias("_b")).select("scene_id", "u", F.col("_b.right_id").alias("v"), "_b.n", "_b._n"))
    sinks = best.select("scene_id", F.col("v").alias("node")).distinct().join(best.select("scene_id", F.col("u").alias("node")), ["scene_id", "node"], "left_anti")
    mutual = best.join(best.select("scene_id", F.col("u").alias("v"), F.col("v").alias("u")), ["scene_id", "u", "v"])
    last = mutual.where(F.struct("n", "u") > F.struct(F.col("_n").alias("n"), F.col("v").alias("u"))).select("scene_id", F.col("u").alias("node"))
    return relabelled(points, label, best.select("scene_id", "u", "v"), sinks.unionByName(last))


def merge_stacked(points: DataFrame, label: str, flat: float = 0.20, rise: float = 0.20, diagonal: float = 0.65, share: float = 0.15, cell: float = 0.03, least: int = 10) -> DataFrame:
    """Joins clusters that lie above each other: near in XY, apart in z, with common XY cells, and together not too large."""
    box = points.where(F.col(label).isNotNull()).groupBy("scene_id", label).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{k}") for c in "xyz" for k, f in (("0", F.min), ("1", F.max), ("m", F.avg))]).where(F.col("n") >= least)
    cells = points.select("scene_id", label, F.floor(F.col("x") / cell).alias("ix"), F.floor(F.col("y") / cell).alias("iy")).distinct()
    counts = cells.groupBy("scene_id", label).agg(F.count("*").alias("cells"))
    a, b = cells.withColumnRenamed(label, "u"), cells.withColumnRenamed(label, "v")
    shared = a.join(b, ["scene_id", "ix", "iy"]).where("u < v").groupBy("scene_id", "u", "v").agg(F.count("*").alias("shared"))
    side = lambda k, s: box.join(counts, ["scene_id", label]).select("scene_id", F.col(label).alias(k), *[F.col(f"{c}{e}").alias(f"{s}{c}{e}") for c in "xyz" for e in "01m"], F.col("cells").alias(f"{s}cells"))
    pairs = shared.join(side("u", "a"), ["scene_id", "u"]).join(side("v", "b"), ["scene_id", "v"])
    near = spatial.length(F.col("axm") - F.col("bxm"), F.col("aym") - F.col("bym")) <= flat
    whole = spatial.length(*[F.greatest(f"a{c}1", f"b{c}1") - F.least(f"a{c}0", f"b{c}0") for c in "xyz"]) <= diagonal
    good = pairs.where(near & (F.abs(F.col("azm") - F.col("bzm")) >= rise) & (F.col("shared") >= share * F.least("acells", "bcells")) & whole)
    return relabelled(points, label, good.select("scene_id", "u", "v"))


def clean_up(points: DataFrame, label: str, discard: int, merge: int, cap: float) -> DataFrame:
    """Clusters under `discard` points become null; those under `merge` go to the nearest larger cluster's centre if it is
    within the cap (the smaller label on ties), else stay. Centres meet by cells."""
    f = points.where(F.col(label).isNotNull()).groupBy("scene_id", F.col(label).alias("point_id")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"])
    small, big = f.where((F.col("n") >= discard) & (F.col("n") < merge)), f.where(F.col("n") >= merge)
    near = spatial.radius_join(small, big, cap, closed=True)
    best = near.groupBy("scene_id", F.col("left_id").alias(label)).agg(F.min(F.struct("distance", "right_id"))["right_id"].alias("to"))
    plan = f.select("scene_id", F.col("point_id").alias(label), (F.col("n") < discard).alias("_gone")).join(best, ["scene_id", label], "left")
    out = points.join(plan, ["scene_id", label], "left")
    return out.withColumn(label, F.when(F.col("_gone"), None).otherwise(F.coalesce("to", label))).select(points.columns)


def reassign_by_votes(points: DataFrame, label: str, merge: int, k: int, cell: float, eps: float = 1e-6, short: float = 0.0) -> DataFrame:
    """Points of clusters under `merge` points, or shorter than `short` along their first axis, take the label with the
    largest sum of 1 / (distance + eps) over the k nearest points of the other clusters (the smaller label on ties)."""
    n = points.where(F.col(label).isNotNull()).groupBy("scene_id", label).agg(F.count("*").alias("_n"))
    if short > 0:
        n = n.join(features(points, label).select("scene_id", label, "l1"), ["scene_id", label]).withColumn("_n", F.when(F.col("l1") < short, 0).otherwise(F.col("_n"))).drop("l1")
    sized = points.join(n, ["scene_id", label])
    near = spatial.knn_join(sized.where(F.col("_n") < merge), sized.where(F.col("_n") >= merge).withColumn("to", F.col(label)), k, cell, extra=("to",))
    votes = near.groupBy("scene_id", "left_id", "to").agg(F.sum(1.0 / (F.col("distance") + eps)).alias("w"))
    best = votes.groupBy("scene_id", F.col("left_id").alias("point_id")).agg(F.min(F.struct((-F.round("w", 9)).alias("w"), "to"))["to"].alias("to"))
    return points.join(best, ["scene_id", "point_id"], "left").withColumn(label, F.coalesce("to", label)).drop("to")


def vote_noise(points: DataFrame, label: str, radius: float, k: int = 5, votes: int = 3) -> DataFrame:
    """Null labels take the commonest label of their k nearest labelled points within the radius, if it has enough votes."""
    known = points.where(F.col(label).isNotNull()).withColumn("to", F.col(label))
    near = blocks.neighbour_lists(points.where(F.col(label).isNull()), known, k, extra=("to",), radius=radius)
    count = lambda to: F.size(F.filter("found.to", lambda t: t == to))
    counted = F.transform(F.array_distinct("found.to"), lambda to: F.struct((-count(to)).alias("v"), to.alias("to")))
    best = near.select("scene_id", F.col("left_id").alias("point_id"), F.array_min(F.filter(counted, lambda c: c.v <= -votes))["to"].alias("to"))
    return points.join(best, ["scene_id", "point_id"], "left").withColumn(label, F.coalesce(label, "to")).drop("to")


def nearest_label(points: DataFrame, label: str, radius: float) -> DataFrame:
    """Null labels take that of the nearest labelled point within the radius."""
    near = spatial.nearest_within(points.where(F.col(label).isNull()), points.where(F.col(label).isNotNull()).withColumn("to", F.col(label)), radius, extra=("to",))
    found = near.select("scene_id", F.col("left_id").alias("point_id"), "to")
    return points.join(found, ["scene_id", "point_id"], "left").withColumn(label, F.coalesce(label, "to")).drop("to")


def filled(points: DataFrame, label: str, radius: float, passes: int = 50, cell: float = 0.4) -> DataFrame:
    """Votes within the radius again and again until nothing changes, then the nearest label for what is left."""
    now, left = points, None
    for _ in range(passes):
        now = cut(vote_noise(now, label, radius, 5, 1))
        rest = now.where(F.col(label).isNull()).count()
        if rest in (0, left):
            break
        left = rest
    near = spatial.nearest_join(now.where(F.col(label).isNull()), now.where(F.col(label).isNotNull()).withColumn("to", F.col(label)), cell, extra=("to",))
    found = near.select("scene_id", F.col("left_id").alias("point_id"), "to")
    return now.join(found, ["scene_id", "point_id"], "left").withColumn(label, F.coalesce(label, "to")).drop("to")
