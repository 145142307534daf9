"""Filling, the chain of preprocessing, resampled intervals and adaptive seeds against plain versions."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import clusters, filters, ground, refine, statistics

from .test_ground import plain_terrain


def cloud(spark, rows, schema="scene_id int, point_id long, x double, y double, z double"):
    return spark.createDataFrame(rows, schema).repartition(3)


def plain_filled(p, label, radius):
    """Rounds of votes of the five nearest labelled points, then the nearest labelled point."""
    label = list(label)
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    while True:
        known = [i for i, v in enumerate(label) if v is not None]
        new = list(label)
        for i, v in enumerate(label):
            near = sorted((d[i, j], j) for j in known if d[i, j] < radius)[:5]
            if v is None and near:
                new[i] = min(Counter(label[j] for _, j in near).items(), key=lambda t: (-t[1], t[0]))[0]
        if new == label:
            break
        label = new
    known = [i for i, v in enumerate(label) if v is not None]
    return [v if v is not None else label[min((d[i, j], j) for j in known)[1]] for i, v in enumerate(label)]


def test_filling_equals_rounds_of_votes(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.uniform(0, 1, (150, 3)), rng.uniform(3, 3.5, (6, 3))])
    label = [int(v) if v < 4 else None for v in rng.integers(0, 12, 150)] + [None] * 6
    rows = [(0, i, *map(float, v), c) for i, (v, c) in enumerate(zip(p, label))]
    found = refine.filled(cloud(spark, rows, "scene_id int, point_id long, x double, y double, z double, label long"), "label", 0.14).collect()
    got = {r["point_id"]: r["label"] for r in found}
    assert [got[i] for i in range(len(p))] == plain_filled(p, label, 0.14)


def test_outliers_go_before_the_ground(spark):
    rng = np.random.default_rng(7)
    p = np.c_[rng.uniform(0, 1, (500, 2)), rng.exponential(0.05, 500)]
    p = np.concatenate([p, rng.uniform(2, 4, (8, 3))])
    df = cloud(spark, [(0, i, *map(float, v)) for i, v in enumerate(p)])
    keep = filters.statistical_outliers(df, 8, 1.0, 0.4).where("keep").select("scene_id", "point_id")
    got = ground.without_ground(df.join(keep, ["scene_id", "point_id"], "left_semi"), "terrain", cell=0.2)
    mean = np.sort(np.linalg.norm(p[:, None] - p[None], axis=2), axis=1)[:, :8].mean(1)
    good = np.flatnonzero(mean < mean.mean() + mean.std(ddof=1))
    want = good[~plain_terrain(p[good], 0.2, 0.05, 5, 0.0)]
    assert sorted(r["point_id"] for r in got.collect()) == sorted(want.tolist())


def test_resampled_intervals_are_those_of_the_mean(spark):
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(1.0, 2.0, 400), "b": rng.exponential(1.0, 300), "one": np.array([5.0])}
    rows = [(k, i, float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "model string, row long, delta double")
    found = {r["model"]: (r["low"], r["high"]) for r in statistics.bootstrap(df, ["model"], rounds=1000).collect()}
    for k in ("a", "b"):
        draws = rng.choice(values[k], (4000, len(values[k]))).mean(1)
        spread = values[k].std() / np.sqrt(len(values[k]))
        assert found[k] == (pytest.approx(np.percentile(draws, 2.5), abs=0.35 * spread), pytest.approx(np.percentile(draws, 97.5), abs=0.35 * spread))
    assert found["one"] == (5.0, 5.0)
    again = {r["model"]: (r["low"], r["high"]) for r in statistics.bootstrap(df.repartition(7), ["model"], rounds=1000).collect()}
    assert again == {k: (pytest.approx(v[0]), pytest.approx(v[1])) for k, v in found.items()}


def test_seeds_widen_until_few_points_are_left(spark):
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.normal(c, 0.12, (90, 3)) for c in ((0, 0, 0), (1.5, 0, 0), (0, 1.5, 0))])
    df = cloud(spark, [(0, i, *map(float, v)) for i, v in enumerate(p)])
    left = {}
    for distance in (0.2, 0.8):
        sizes = Counter(r["label"] for r in clusters.watershed(df, 0.1, distance).select("label").collect())
        left[distance] = 1 - sum(n for c, n in sizes.items() if c is not None and n >= 40) / len(p)
    for share in (0.0, 0.2, 1.0):
        chosen, out = clusters.with_adaptive_seed(df, (0.2, 0.8), 0.1, share, 40)
        assert chosen == next((d for d in (0.2, 0.8) if left[d] <= share), min(left, key=left.get))
        assert out.where(F.col("label").isNull()).count() == round(left[chosen] * len(p))
