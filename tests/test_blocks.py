"""Neighbours found in blocks against all pairs, on clouds with many equal places, steep density and odd coordinates."""

import numpy as np
import pytest

from pointloom.operators import blocks, spatial

COLUMNS = "scene_id string, point_id long, x double, y double, z double"


def cloud(n, seed=5):
    rng = np.random.default_rng(seed)
    x, y, z = np.round(rng.exponential(0.5, n), 2), rng.integers(0, 6, n) * 0.1, rng.integers(0, 9, n) * 0.01
    return [("ab"[k % 2], k, float(x[k]), float(y[k]), float(z[k])) for k in range(n)]


def gaps(rows, axes=3):
    at = np.array([r[2 : 2 + axes] for r in rows])
    d = at[:, None] - at[None]
    total = d[..., 0] * d[..., 0]
    for k in range(1, axes):
        total = total + d[..., k] * d[..., k]
    far = np.sqrt(total)
    far[np.array([[a[0] != b[0] for b in rows] for a in rows])] = np.inf
    return far


def made(df):
    """Operators of the plan that make a row for each pair: joins on cells of the scene."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line and "ix" in line]


@pytest.mark.parametrize("closed", [False, True])
def test_counts_within_a_radius_make_no_pairs(spark, closed):
    rows = cloud(900)
    df = spark.createDataFrame(rows, COLUMNS)
    out = spatial.neighbour_counts(df, 0.1, closed=closed)
    far = gaps(rows)
    want = ((far <= 0.1) if closed else (far < 0.1)).sum(1)
    assert {r["point_id"]: r["neighbours"] for r in out.collect()} == dict(enumerate(want))
    assert not made(out)


def test_counts_of_uneven_places():
    rng = np.random.default_rng(2)
    p, q, w = rng.random((400, 3)) * (1, 0.4, 0.2), rng.random((50, 3)) * (1.2, 0.4, 0.2), rng.integers(1, 9, 400)
    for radius in (0.02, 0.15, 3.0):
        far = np.sqrt(((q[:, None] - p[None]) ** 2).sum(2))
        assert (blocks.counts(q, p, w, radius, False) == ((far < radius) * w).sum(1)).all()


@pytest.mark.parametrize("axes", ["xyz", "xy"])
def test_nearest_by_blocks(spark, axes):
    rows = [*cloud(700), ("a", 900, 400.0, 3.0, 0.0), ("c", 901, 0.0, 0.0, 0.0), ("a", 902, float("nan"), 0.0, 0.0), ("a", 903, None, 0.0, 0.0)]
    out = {r["left_id"]: [f["right_id"] for f in r["found"]] for r in blocks.neighbour_lists(*[spark.createDataFrame(rows, COLUMNS)] * 2, 6, axes).collect()}
    whole = rows[:-2]
    far = gaps(whole, len(axes))
    for i, a in enumerate(whole):
        order = sorted((far[i, j], b[1]) for j, b in enumerate(whole) if b[0] == a[0])[:6]
        assert out.pop(a[1]) == [k for _, k in order]
    assert not out  # points without a place are near nothing, and end the search all the same


def test_blocks_follow_the_fullest_place(spark):
    df = spark.createDataFrame(cloud(3000), COLUMNS).where("scene_id = 'a'").dropDuplicates(["x", "y", "z"])
    plan = blocks.layout(df, most=60)
    sizes = blocks.placed(df.join(plan, "scene_id"), "xyz").groupBy("ix", "iy", "iz").count().collect()
    assert max(r["count"] for r in sizes) <= 60


def test_nearest_within_makes_no_pairs(spark):
    rows = cloud(600)
    df = spark.createDataFrame(rows, COLUMNS)
    out = spatial.nearest_within(df, df.where("point_id % 3 = 0"), 0.04)
    far, want = gaps(rows), {}
    for i in range(len(rows)):
        near = [(far[i, j], j) for j in range(0, len(rows), 3) if far[i, j] < 0.04]
        if near:
            want[i] = min(near)[::-1]
    assert {r["left_id"]: (r["right_id"], r["distance"]) for r in out.collect()} == want
    assert not made(out)


def test_edges_are_joined_within_tasks(spark):
    from pointloom.operators import graph

    rng = np.random.default_rng(7)
    edges = [({"a": int(g), "b": "x"}, int(u), int(v)) for g, u, v in zip(rng.integers(0, 2, 300), rng.integers(0, 260, 300), rng.integers(0, 260, 300))]
    name = {}
    for g, u, v in edges:
        name.setdefault((g["a"], u), u), name.setdefault((g["a"], v), v)
    for _ in range(len(name)):
        before = dict(name)
        for g, u, v in edges:
            name[g["a"], u] = name[g["a"], v] = min(name[g["a"], u], name[g["a"], v])
        if name == before:
            break
    df = spark.createDataFrame(edges, "scene_id struct<a: int, b: string>, u long, v long").repartition(5)
    got = {(r["scene_id"]["a"], r["node"]): r["component"] for r in graph.components(df).collect()}
    assert got == name
    stars = graph._contracted(df.where("u != v"), "scene_id")
    assert stars.count() <= 5 * len(name)
    chain = spark.range(0, 5000, 1, 2).selectExpr("1 AS scene_id", "id + 1 AS u", "id AS v")
    assert graph._contracted(chain, "scene_id").select("root").distinct().count() == 2  # a root for each task


def test_local_ground_makes_no_pairs(spark):
    from pointloom.operators import filters

    rows = cloud(700)
    df = spark.createDataFrame(rows, COLUMNS)
    out = filters.above_local_ground(df, 12, 0.05, 0.05, 0.07, 0.03, 0.6)
    flat, far, height = gaps(rows, 2), gaps(rows), {}
    for i in range(len(rows)):
        near = sorted((flat[i, j], j) for j in range(len(rows)) if np.isfinite(flat[i, j]))[:12]
        height[i] = rows[i][4] - np.percentile([rows[j][4] for _, j in near], 5)
    tall = [j for j, h in height.items() if h > 0.07]
    want = {i for i, h in height.items() if h > 0.05 or any(far[i, j] < 0.03 for j in tall)}
    got = {r["point_id"]: r["height"] for r in out.collect()}
    assert set(got) == want and all(abs(got[i] - height[i]) < 1e-12 for i in got)
    assert not made(out)


def test_statistical_outliers_make_no_pairs(spark):
    from pointloom.operators import filters

    rows = cloud(500)
    df = spark.createDataFrame(rows, COLUMNS)
    out = filters.statistical_outliers(df, 8, 1.0, 0.4)
    means = np.sort(gaps(rows), axis=1)[:, :8].mean(1)
    for name in "ab":
        own = [i for i, r in enumerate(rows) if r[0] == name]
        limit = means[own].mean() + means[own].std(ddof=1)
        got = {r["point_id"]: r["keep"] for r in out.where(f"scene_id = '{name}'").collect()}
        assert got == {i: bool(means[i] < limit) for i in own}
    assert not made(out)


def test_post_semantic_counts_only_what_is_above(spark, tmp_path):
    from pointloom.plans import catalog

    rows = [(k, "a", k % 7 * 1.0, k % 50) for k in range(620)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    out = catalog.QUERIES["flt5_post_semantic"](spark, str(tmp_path))
    at = np.array([(v / 100, u % 50 * 0.1, e % 31 * 0.01) for e, _, v, u in rows])
    at = at[at[:, 2] > np.percentile(at[:, 2], 10)]
    far = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    assert [r["kept"] for r in out.collect()] == [((far < 0.15).sum(1) > 10).sum()]
    assert not made(out)


def test_votes_of_noise_make_no_pairs(spark):
    from collections import Counter

    from pointloom.operators import refine

    rows = cloud(600)
    labels = [None if k % 4 == 0 else k % 3 for k in range(len(rows))]
    df = spark.createDataFrame([(*r, x) for r, x in zip(rows, labels)], COLUMNS + ", label int")
    out = refine.vote_noise(df, "label", 0.06)
    far = gaps(rows)
    for r in out.collect():
        i = r["point_id"]
        near = sorted((far[i, j], j) for j in range(len(rows)) if labels[j] is not None and far[i, j] < 0.06)[:5]
        votes = Counter(labels[j] for _, j in near)
        best = min(((-n, x) for x, n in votes.items() if n >= 3), default=(0, None))[1]
        assert r["label"] == (labels[i] if labels[i] is not None else best)
    assert not made(out)


def test_centres_are_told_without_a_row_for_each(spark):
    from pointloom.operators import clusters

    rows = cloud(200)
    df = spark.createDataFrame(rows, COLUMNS)
    at = [("a", 7, 0.0, 0.0, 0.0), ("a", 9, 1.0, 0.2, 0.0), ("b", 8, 0.3, 0.1, 0.0)]
    out = clusters.to_nearest(df, spark.createDataFrame(at, "scene_id string, label long, _x double, _y double, _z double"))
    for r in out.collect():
        here = (r["x"], r["y"], r["z"])
        assert r["label"] == min((sum((p - q) ** 2 for p, q in zip(here, c[2:])) ** 0.5, c[1]) for c in at if c[0] == r["scene_id"])[1]
    groups = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in line]
    assert groups and not any("point_id" in line for line in groups)
