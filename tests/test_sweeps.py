"""Sweeps and optimal assignment against plain versions."""

import itertools

import numpy as np

from pointloom.operators import match, splits, sweeps


def test_assignment_is_the_best_of_all():
    rng = np.random.default_rng(7)
    for n, m in [(1, 1), (2, 4), (4, 2), (4, 4), (5, 5), (3, 6)] * 8:
        v = np.round(rng.uniform(0, 1, (n, m)) * (rng.uniform(0, 1, (n, m)) < 0.7), 2)
        small, large = (n, m) if n <= m else (m, n)
        w = v if n <= m else v.T
        best = max(sum(w[i, j] for i, j in zip(range(small), p)) for p in itertools.permutations(range(large), small))
        got = match.assignment(v)
        assert len(got) == small and len({i for i, _ in got}) == len({j for _, j in got}) == small
        assert abs(sum(v[i, j] for i, j in got) - best) < 1e-9


def test_optimal_matches_trade_pairs(spark):
    rows = [(0, 1, 1, 0.51), (0, 1, 2, 0.32), (0, 2, 1, 0.33), (1, 5, 5, 0.9), (1, 6, 5, 0.2)]
    df = spark.createDataFrame(rows, "scene_id int, pred long, gt long, iou double")
    assert sorted(map(tuple, match.optimal_matches(df, 0.0).collect())) == [(0, 1, 2, 0.32), (0, 2, 1, 0.33), (1, 5, 5, 0.9)]
    assert [tuple(r) for r in match.optimal_matches(df, 0.5).collect()] == [(1, 5, 5, 0.9)]
    assert match.optimal_matches(df.limit(0), 0.5).count() == 0


def test_sweeps_over_known_clusters(spark):
    rng, rows = np.random.default_rng(3), []
    for cluster, centres in enumerate([[(0, 0, 0), (1, 0, 0)], [(0, 0, 0)], [(0, 0, 0), (0.9, 0, 0)]]):
        for plant, c in enumerate(centres):
            rows += [(0, cluster, len(rows) + i, *map(float, p), plant) for i, p in enumerate(rng.normal(c, 0.07, (220, 3)))]
    df = spark.createDataFrame(rows, "scene_id int, cluster int, point_id long, x double, y double, z double, inst int")
    got = {r["share"]: r for r in sweeps.density_sensitivity(df, splits.Rule(), (1.0, 0.5), 3).collect()}
    assert got[1.0]["clusters"] == got[0.5]["clusters"] == 3 and got[1.0]["correct"] == 1.0 and got[1.0]["mae"] == 0.0
    assert all(abs(r["correct"] + r["over"] + r["under"] - 1) < 1e-9 for r in got.values())
    never, fine = sorted(sweeps.scan(df, [(0.35, 0.92), (0.35, 0.0)], splits.Rule(adaptive=False)).collect())
    assert (fine["correct"], fine["over_clusters"], fine["under_clusters"], fine["parts"], fine["plants"]) == (3, 0, 0, 5, 5)
    assert (never["correct"], never["under_clusters"], never["parts"]) == (1, 2, 3)


def test_descent_changes_one_parameter_at_a_time():
    asked = []

    def score(s):
        asked.append(tuple(sorted(s.items())))
        return -((s["a"] - 3) ** 2) - (s["b"] - 1) ** 2

    best, value = sweeps.coordinate_descent({"a": [1, 2, 3], "b": [0, 1, 2]}, score, {"a": 1, "b": 0})
    assert best == {"a": 3, "b": 1} and value == 0 and len(asked) == len(set(asked))
