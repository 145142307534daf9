"""Operators that SQL does not express, against plain NumPy versions on small clouds."""

import itertools
import random
import struct

import numpy as np
import pytest

from pointloom.functions import rle
from pointloom.operators import clusters, graph, labels, match, refine, sampling, spatial, splits, statistics, traits
from pointloom.plans import catalog
from pointloom.sources import readers


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    xyz = np.round(np.concatenate([rng.normal(c, 0.12, (40, 3)) for c in ((0, 0, 0), (1, 0, 0), (0, 1.2, 0.3))] + [rng.uniform(-1, 2, (15, 3))]), 4)
    rows = [(k % 2, k, *map(float, p), k % 3) for k, p in enumerate(xyz)]
    return rows, spark.createDataFrame(rows, "scene_id int, point_id long, x double, y double, z double, inst int").repartition(3).cache()


def gap(a, b):
    return float(np.sqrt(sum((a[k] - b[k]) ** 2 for k in (2, 3, 4))))


def test_nearest_neighbours(cloud):
    rows, df = cloud
    got = {}
    for r in spatial.knn_join(df, df, 4, 0.05).collect():
        got.setdefault(r["left_id"], []).append((r["rank"], r["right_id"]))
    for a in rows:
        order = sorted((gap(a, b), b[1]) for b in rows if b[0] == a[0])[:4]
        assert [i for _, i in sorted(got[a[1]])] == [i for _, i in order]


def test_dbscan_partition(cloud):
    rows, df = cloud
    near = {a[1]: [b[1] for b in rows if b[0] == a[0] and gap(a, b) <= 0.2] for a in rows}
    core = {i for i, n in near.items() if len(n) >= 5}
    name = {i: i for i in core}
    for _ in rows:
        name = {i: min(name[j] for j in near[i] if j in core) for i in core}
    want = {i: name[i] if i in core else min((name[j] for j in near[i] if j in core), default=None) for i in near}
    assert {r["point_id"]: r["label"] for r in clusters.dbscan(df, 0.2, 5).collect()} == want


def test_density_peaks_beyond_a_dense_spot(spark):
    """The best 200 scores lie in one spot; further peaks are found all the same."""
    rng = np.random.default_rng(8)
    xyz = np.concatenate([rng.normal(0, 0.01, (1200, 3)), rng.normal((2, 0, 0), 0.2, (20, 3)), rng.normal((0, 2, 0), 0.2, (20, 3))])
    df = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(xyz)], "scene_id int, point_id long, x double, y double, z double")
    n = len(xyz)
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    near = np.argsort(d, axis=1, kind="stable")[:, :3]
    rho = 1 / (np.take_along_axis(d, near, 1).mean(1) + 1e-6)
    delta = np.array([min((d[i, j] for j in near[i] if rho[j] > rho[i]), default=np.nan) for i in range(n)])
    gamma, peaks = rho * np.where(np.isnan(delta), np.nanmax(delta), delta), []
    for i in sorted(range(n), key=lambda i: (-gamma[i], i)):
        if len(peaks) < 3 and all(d[i, p] >= 1.2 for p in peaks):
            peaks.append(i)
    want = {i: min(peaks, key=lambda p: (d[i, p], p)) for i in range(n)}
    assert len(peaks) == 3 and max(sorted(range(n), key=lambda i: (-gamma[i], i))[:200]) < 1200
    assert {r["point_id"]: r["label"] for r in clusters.density_peaks(df, 3, 3, 1.2, 0.4).collect()} == want


def test_components_of_a_chain(spark):
    edges = [(0, i, i + 1) for i in range(40)] + [(1, 5, 5), (1, 7, 9)]
    found = graph.components(spark.createDataFrame(edges, "scene_id int, u long, v long")).collect()
    assert {(r["scene_id"], r["node"]): r["component"] for r in found} == {**{(0, i): 0 for i in range(41)}, (1, 5): 5, (1, 7): 7, (1, 9): 7}


def test_suppression_and_cover_equal_the_sequence(spark):
    rng = random.Random(2)
    sets = {p: set(rng.sample(range(40), rng.randint(4, 14))) for p in range(14)}
    score = {p: round(rng.random(), 1) for p in sets}
    proposals = spark.createDataFrame([(0, p, i) for p, s in sets.items() for i in s], "scene_id int, proposal_id long, point_id long")
    scores = spark.createDataFrame([(0, p, s) for p, s in score.items()], "scene_id int, proposal_id long, score double")
    order, kept, owner = sorted(sets, key=lambda p: (-score[p], p)), [], {}
    for p in order:
        if all(len(sets[p] & sets[q]) / len(sets[p] | sets[q]) <= 0.2 for q in kept):
            kept.append(p)
        free = [i for i in sets[p] if i not in owner]
        if len(free) > 0.5 * len(sets[p]):
            owner |= dict.fromkeys(free, p)
    assert sorted(r["proposal_id"] for r in graph.suppressed(proposals, scores, 0.2).collect()) == sorted(kept)
    assert {r["point_id"]: r["proposal_id"] for r in graph.greedy_cover(proposals, scores).collect()} == owner


def test_cover_queries_take_all_scores(spark, tmp_path):
    """Scores near 0.5, as those of large tables are."""
    rng = random.Random(7)
    rows = [(i, p, 0, 0.048 + 0.001 * p) for p in range(5) for i in rng.sample(range(12), 5)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_discount double"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    sets = {p: {i for i, q, *_ in rows if q == p} for p in range(5)}
    owners = []
    for share in (0.5, 0.3):
        owner = {}
        for p in sorted(sets, reverse=True):
            free = [i for i in sets[p] if i not in owner]
            if len(free) > share * len(sets[p]):
                owner |= dict.fromkeys(free, p)
        owners.append(list(owner.values()))
    found = catalog.QUERIES["gp4_greedy_cover"](spark, str(tmp_path)).collect()
    assert {r["proposal_id"]: r["points"] for r in found} == {p: owners[0].count(p) for p in owners[0]}
    fused = catalog.QUERIES["gp11_panoptic_fusion"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in fused] == [(0, len(set(owners[1])), len(owners[1]))]


def test_mutual_matches_equal_the_sequence(spark):
    rng = random.Random(5)
    pairs = [(0, p, g, rng.randint(1, 9) / 10) for p, g in itertools.product(range(1, 7), range(1, 7)) if rng.random() < 0.6]
    want, ps, gs = [], set(), set()
    for _, p, g, iou in sorted(pairs, key=lambda r: (-r[3], -r[1], -r[2])):
        if iou >= 0.3 and p not in ps and g not in gs:
            want.append((p, g))
            ps.add(p), gs.add(g)
    got = match.mutual_matches(spark.createDataFrame(pairs, "scene_id int, pred int, gt int, iou double"), 0.3)
    assert sorted((r["pred"], r["gt"]) for r in got.collect()) == sorted(want)


def test_signed_rank_tail(spark):
    from math import erfc, sqrt

    z = [0.0, 0.3, 1.0, 1.96, 2.9, 3.5, 6.0, -2.2]
    for r in spark.createDataFrame([(v,) for v in z], "z double").select("z", statistics.normal_tail(__import__("pyspark").sql.functions.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(erfc(abs(r["z"]) / sqrt(2)), rel=1e-9)


def test_peaks_of_profiles():
    assert refine.peaks(np.array([5, 1, 3, 1, 2, 2, 1, 9.0]), 1, 0.1) == [2, 4]
    assert refine.peaks(np.array([0, 5, 4, 6, 0.0]), 3, 0.1) == [3] and refine.peaks(np.array([0, 0.5, 0, 9, 0.0]), 1, 0.1) == [3]


def test_split_cuts_a_dumbbell_once(spark):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal((0, 0, 0), 0.08, (150, 3)), rng.normal((1.0, 0, 0), 0.08, (150, 3))])
    df = spark.createDataFrame([(0, k, *map(float, p), 1) for k, p in enumerate(pts)], "scene_id int, point_id long, x double, y double, z double, label long")
    sides = {r["point_id"]: r["label"] for r in splits.split(df, "label").collect()}
    assert len(set(sides.values())) == 2 and len({sides[k] for k in range(150)}) == 1 and len({sides[k] for k in range(150, 300)}) == 1


def test_circle_and_hull():
    square = np.array([(x, y) for x in (0.0, 1.0) for y in (0.0, 1.0)] + [(0.5, 0.5)])
    assert len(traits.hull(square)) == 4 and traits.smallest_circle(traits.hull(square)) == pytest.approx(0.5**0.5)
    h = traits.hull(np.random.default_rng(0).normal(size=(60, 2)))
    best = min(r for n in (2, 3) for s in itertools.combinations(h, n) for r in [_circle(s, h)] if r)
    assert traits.smallest_circle(h) == pytest.approx(best)


def _circle(s, h):
    if len(s) == 2:
        c = (s[0] + s[1]) / 2
    else:
        m = 2 * np.stack([s[1] - s[0], s[2] - s[0]])
        c = np.linalg.solve(m, [s[1] @ s[1] - s[0] @ s[0], s[2] @ s[2] - s[0] @ s[0]])
    r = np.linalg.norm(s[0] - c)
    return r if (np.linalg.norm(h - c, axis=1) <= r + 1e-9).all() else None


def test_farthest_points(cloud):
    rows, df = cloud
    got = sorted((r["scene_id"], r["step"], r["point_id"]) for r in sampling.farthest(df, 4).collect())
    for scene in (0, 1):
        mine = [r for r in rows if r[0] == scene]
        chosen = [min(mine, key=lambda r: r[1])]
        while len(chosen) < 4:
            chosen.append(max(mine, key=lambda r: (min(gap(r, c) for c in chosen), -r[1])))
        assert [p for s, _, p in got if s == scene] == [c[1] for c in chosen]


def test_rotations_and_runs(spark):
    for a, b in (((0, 0, 1), (1, 0, 0)), ((0, 0, 1), (0, 0, -1)), ((1, 2, 3), (1, 2, 3)), ((1, 0, 0), (-1, 0, 0))):
        m = np.array(labels.rotation_between(a, b))
        assert np.allclose(m @ np.array(a) / np.linalg.norm(a), np.array(b) / np.linalg.norm(b)) and np.allclose(m @ m.T, np.eye(3))
    mask = [1, 1, 0, 0, 1, 0, 1]
    coded = rle.encoded(spark.createDataFrame([(1, k, bool(v)) for k, v in enumerate(mask)], "m int, place long, v boolean"), ["m"], "place", "v")
    assert coded.first()["counts"] == "1 2 5 1 7 1"
    assert sorted(r["place"] for r in rle.decoded(coded, ["m"]).collect()) == [0, 1, 4, 6]


def test_files(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nproperty float semantic\nproperty float instance\nend_header\n0 1 2 255 0 0 1 3\n3 4 5 0 255 0 nan nan\n")
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty double x\nproperty double y\nproperty double z\nproperty int plant_ids\nend_header\n"
    (tmp_path / "b.ply").write_bytes(head + struct.pack("<dddi", 1.5, 2.5, 3.5, 7))
    np.save(tmp_path / "c.npy", np.array([[1.0, 2, 3]]))
    (tmp_path / "a_gt.txt").write_text("0 1 2 9 9 9 1 4\n# x\n3 4 5 9 9 9 0 -1\n")
    got = sorted((r["scene_id"], r["point_id"], r["x"], r["r"], r["sem"], r["inst"]) for r in readers.clouds(spark, str(tmp_path)).collect())
    assert got == [("a", 0, 0.0, 1.0, 1, 3), ("a", 1, 3.0, 0.0, 0, -1), ("b", 0, 1.5, 0.0, 0, 7), ("c", 0, 1.0, 0.0, 0, -1)]
    truth = sorted((r["scene_id"], r["x"], r["sem"], r["inst"]) for r in readers.ground_truth(spark, f"{tmp_path}/a_gt.txt").collect())
    assert truth == [("a", 0.0, 1, 4), ("a", 3.0, 0, 0)]
    assert readers.discover(spark, str(tmp_path)).count() == 3


def test_pcd_files_and_empty_ones(spark, tmp_path):
    head = "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\n"
    (tmp_path / "a.pcd").write_bytes((head + "DATA binary\n").encode() + struct.pack("<fffIfffI", 1, 2, 3, 0xFF0000, 4, 5, 6, 0x0000FF))
    (tmp_path / "b.pcd").write_text(head.replace(" rgb", " label").replace("F F F U", "F F F I") + "DATA ascii\n1 2 3 1\n4 5 6 0\n")
    (tmp_path / "c.ply").write_bytes(b"")
    got = sorted((r["scene_id"], r["point_id"], r["x"], r["r"], r["b"], r["sem"]) for r in readers.clouds(spark, str(tmp_path)).collect())
    assert got == [("a", 0, 1.0, 1.0, 0.0, 0), ("a", 1, 4.0, 0.0, 1.0, 0), ("b", 0, 1.0, 0.0, 0.0, 1), ("b", 1, 4.0, 0.0, 0.0, 0)]
    with pytest.raises(Exception, match="(?i)path"):
        readers.clouds(spark, str(tmp_path / "none")).collect()


def test_line_numbers_do_not_depend_on_cuts(spark, tmp_path):
    (tmp_path / "s_gt.txt").write_text("".join(f"{i} 0 0 9 9 9 1 {i}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            rows = readers.ground_truth(spark, f"{tmp_path}/s_gt.txt").collect()
            assert len(rows) == 4000 and all(r["point_id"] == r["x"] == r["inst"] for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
