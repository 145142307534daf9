"""Merges of fragments, leaves of feature trees and planes against plain versions."""

import itertools
import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import clusters, ground, refine
from pointloom.plans import catalog, cluster_queries

SCHEMA = "scene_id int, point_id long, x double, y double, z double, label long"


def frame(spark, rows):
    return spark.createDataFrame([(int(s), i, *map(float, p), int(c)) for i, (s, p, c) in enumerate(rows)], SCHEMA).repartition(3)


def plain_merge(clouds, short, distance, angle):
    """A pass from the smallest cluster on, with names that are followed to their end."""
    told = {}
    for c, p in clouds.items():
        values, vectors = np.linalg.eigh(np.cov(p.T))
        axis = vectors[:, -1]
        told[c] = (p.mean(0), np.ptp((p - p.mean(0)) @ axis), axis)
    parent = {c: c for c in clouds}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for c in sorted(clouds, key=lambda c: (len(clouds[c]), c)):
        centre, long, axis = told[c]
        if long > short:
            continue
        around = sorted((math.dist(centre, told[o][0]), o) for o in clouds if o != c)
        for far, o in around:
            if far <= distance and math.degrees(math.acos(min(1.0, abs(axis @ told[o][2])))) < angle:
                a, b = find(o), find(c)
                if a != b:
                    parent[b] = a
                break
    return {c: find(c) for c in clouds}


@pytest.mark.parametrize("seed", range(4))
def test_fragments_take_the_names_of_an_ordered_pass(spark, seed):
    rng = np.random.default_rng(seed)
    scenes = {}
    for s in range(2):
        clouds = {}
        for c in rng.permutation(40)[:28]:
            way = rng.normal(0, 1, 3) * (1, 0.3, 0.3)
            n = int(rng.integers(5, 12))  # equal sizes among them
            clouds[int(c)] = rng.uniform(0, 1, 3) + np.outer(rng.uniform(-0.5, 0.5, n), way / np.linalg.norm(way)) * rng.uniform(0.05, 0.4) + rng.normal(0, 0.003, (n, 3))
        scenes[s] = clouds
    rows = [(s, p, c) for s, clouds in scenes.items() for c, cloud in clouds.items() for p in cloud]
    df = frame(spark, rows)
    found = refine.merge_fragments(df.withColumn("was", F.col("label")), "label", 0.2, 0.35, 40.0)
    got = {(r["scene_id"], r["was"]): r["label"] for r in found.select("scene_id", "was", "label").distinct().collect()}
    want = {(s, c): name for s, clouds in scenes.items() for c, name in plain_merge(clouds, 0.2, 0.35, 40.0).items()}
    assert got == want and any(c != name for (_, c), name in want.items())


def plain_leaves(p, bound):
    """Members of each leaf, by recursion from the smallest cells up."""
    live = {}
    for i, v in enumerate(p):
        live.setdefault(tuple(math.floor(c / (bound / 8)) for c in v), []).append(i)
    done = []
    for _ in range(clusters.TREE_LEVELS):
        parents = {}
        for cell, members in live.items():
            parents.setdefault(tuple(c // 2 for c in cell), []).append(members)
        live = {}
        for cell, parts in parents.items():
            whole = p[sum(parts, [])]
            if math.sqrt(((whole - whole.mean(0)) ** 2).sum(1).mean()) <= bound:
                live[cell] = sum(parts, [])
            else:
                done += parts
    return sorted(sorted(m) for m in [*done, *live.values()])


def test_leaves_keep_the_bound_and_the_sums(spark):
    rng = np.random.default_rng(3)
    scenes = [np.concatenate([rng.normal(0, 0.05, (200, 3)), rng.uniform(-2, 2, (150, 3)), np.full((9, 3), 1.25)]), np.array([[0.5, 0.5, 0.5]])]
    rows = [(s, p, 0) for s, cloud in enumerate(scenes) for p in cloud]
    labelled, leaves = clusters.feature_leaves(frame(spark, rows).drop("label"), 0.1)
    places = np.array([p for _, p, _ in rows])
    members = {}
    for r in labelled.collect():
        members.setdefault((r["scene_id"], r["label"]), []).append(r["point_id"])
    told = {(r["scene_id"], r["label"]): r for r in leaves.collect()}
    assert sum(map(len, members.values())) == len(rows) and set(told) == set(members)
    for key, ids in members.items():
        r, p = told[key], places[ids]
        assert key[1] == min(ids) and r["n"] == len(ids) and r["radius"] <= 0.1
        assert np.allclose([r["sx"], r["sy"], r["sz"], r["ss"]], [*p.sum(0), (p**2).sum()])
        assert math.isclose(r["radius"], math.sqrt(((p - p.mean(0)) ** 2).sum(1).mean()), abs_tol=1e-6)
    at = 0
    for s, cloud in enumerate(scenes):
        assert sorted(sorted(i - at for i in ids) for (k, _), ids in members.items() if k == s) == plain_leaves(cloud, 0.1)
        at += len(cloud)


def test_no_points_have_no_leaves(spark):
    labelled, leaves = clusters.feature_leaves(frame(spark, []).drop("label"), 0.1)
    assert labelled.count() == leaves.count() == 0


def test_means_halfway_are_rounded_up_in_any_order_of_points(spark, tmp_path):
    rng = np.random.default_rng(4)
    values = rng.integers(1000, 1900, (300, 8))  # hundredths, eight of a leaf: an odd sum is halfway at the sixth decimal of the mean
    values[:, 0] += values.sum(1) % 2 == 0
    events = [(31 * (8 * s + i), str(s), 0, float(v) / 100) for s, leaf in enumerate(values) for i, v in enumerate(leaf)]
    want = {str(s): float((Decimal(int(leaf.sum())) / 80000).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for s, leaf in enumerate(values)}
    for run, order in enumerate([np.arange(len(events)), rng.permutation(len(events))]):
        folder = f"{tmp_path}/{run}"
        rows = spark.createDataFrame([events[i] for i in order], "event_id long, event_type string, user_id long, value double")
        rows.repartition(1 + 6 * run).write.parquet(f"{folder}/events.parquet")
        found = catalog.QUERIES["cl8_feature_leaves"](spark, folder).collect()
        assert len(found) == len(want) and {r["n"] for r in found} == {8}
        assert {r["scene_id"]: r["mean_x"] for r in found} == want


def test_means_of_values_that_decimals_cannot_hold(spark):
    rows = [(0, 0.1), (0, 0.2), (1, 1e17), (1, 3e17), (2, float("nan")), (2, 1.0), (3, None), (3, 0.5), (4, None), (5, -0.25), (5, -0.5), (6, float("inf"))]
    df = spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(cluster_queries._rounded_mean("x", 2).alias("m"))
    got = dict(map(tuple, df.collect()))
    assert math.isnan(got.pop(2)) and got == {0: 0.15, 1: 2e17, 3: 0.5, 4: None, 5: -0.38, 6: math.inf}


def test_planes_in_the_race_are_those_of_full_counts(spark):
    rng = np.random.default_rng(8)
    clouds, planes, want = [], [], set()
    for s in range(4):
        p = rng.uniform(-1, 1, (400, 3)) * (1, 1, 0.3 if s else 0.0)  # scene 0 is flat
        if s == 2:
            p = np.round(p, 1)  # points share places, planes share counts
        clouds += [(s, v, 0) for v in p]
        counts = []
        for t in range(60):
            a, b, c = p[rng.choice(len(p), 3, replace=False)]
            n = np.cross(b - a, c - a)
            if np.linalg.norm(n) < 1e-9:
                continue
            n = n / np.linalg.norm(n)
            planes.append((s, t, *map(float, n), float(-n @ a)))
            away = np.abs(p[:, 0] * n[0] + p[:, 1] * n[1] + p[:, 2] * n[2] - n @ a)
            counts.append((-int((away < 0.05).sum()), t))
        want.add((s, min(counts)[1]))
    df = frame(spark, clouds).drop("label")
    found = ground.best_tries(df, spark.createDataFrame(planes, "scene_id int, try int, pa double, pb double, pc double, pd double"), 0.05)
    assert {tuple(r) for r in found.collect()} == want


def test_all_scenes_are_cut_by_their_planes(spark):
    rng = np.random.default_rng(9)
    flat = np.c_[rng.uniform(-1, 1, (200, 2)), rng.normal(0, 0.002, 200)]
    high = np.c_[rng.uniform(-1, 1, (60, 2)), rng.uniform(0.2, 1, 60)]
    rows = [(s, p + (0, 0, s), 0) for s, p in itertools.product(range(2), np.concatenate([flat, high]))]
    kept = ground.without_ground(frame(spark, rows), "plane", share=1.0, tries=100).select("point_id", "scene_id", "z").collect()
    assert len(kept) == 120 and all(r["z"] - r["scene_id"] > 0.1 for r in kept)
