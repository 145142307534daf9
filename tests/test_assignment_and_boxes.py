"""Matching in rounds and box joins against plain versions."""

import numpy as np
import pytest

from pointloom.operators import auction, boxes, match

PAIRS = "scene_id int, pred long, gt long, iou double"


def tangled(seed, scenes=((9, 8), (5, 11), (1, 3))):
    """Pairs of which few stand out, so that matches hang on each other."""
    rng, rows = np.random.default_rng(seed), []
    for scene, (n, m) in enumerate(scenes):
        for p in range(n):
            for g in range(m):
                if abs(p * m / n - g) < 2.5:
                    rows.append((scene, p, g, round(float(rng.uniform(0.05, 0.5)), 2)))
    return rows


def best_total(rows):
    total = 0.0
    for scene in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == scene]
        value = np.zeros((max(r[1] for r in mine) + 1, max(r[2] for r in mine) + 1))
        for _, p, g, w in mine:
            value[p, g] = w
        total += sum(value[i, j] for i, j in match.assignment(value))
    return total


def one_to_one(found):
    return len({(r["scene_id"], r["pred"]) for r in found}) == len({(r["scene_id"], r["gt"]) for r in found}) == len(found)


def test_auction_gives_the_best_total(spark):
    rows = tangled(4, ((6, 5), (3, 6)))
    found = auction.auction(spark.createDataFrame(rows, PAIRS), ["scene_id"], decimals=2).collect()
    assert one_to_one(found) and {tuple(r) for r in found} <= set(rows)
    assert sum(r["iou"] for r in found) == pytest.approx(best_total(rows))


def test_auction_settles_equal_values(spark):
    """Five predictions want the same two instances, all alike."""
    rows = [(0, p, g, 0.2) for p in range(5) for g in range(2)]
    found = auction.auction(spark.createDataFrame(rows, PAIRS), ["scene_id"], decimals=1).collect()
    assert one_to_one(found) and len(found) == 2
    assert auction.auction(spark.createDataFrame([], PAIRS), ["scene_id"]).count() == 0


@pytest.mark.parametrize("rounds", [0, 1, 20])
def test_peeled_pairs_belong_to_a_best_matching(spark, rounds):
    rng = np.random.default_rng(11)
    rows = tangled(5, ((12, 12), (7, 4))) + [(2, p, p, round(float(rng.uniform(0.6, 1)), 2)) for p in range(6)] + [(2, p, p + 1, 0.3) for p in range(5)]
    taken, rest = (x.collect() for x in auction.peel(spark.createDataFrame(rows, PAIRS), rounds))
    sides = {(r["scene_id"], "p", r["pred"]) for r in taken} | {(r["scene_id"], "g", r["gt"]) for r in taken}
    assert not any((r["scene_id"], "p", r["pred"]) in sides or (r["scene_id"], "g", r["gt"]) in sides for r in rest)
    left = best_total([tuple(r) for r in rest]) if rest else 0.0
    assert sum(r["iou"] for r in taken) + left == pytest.approx(best_total(rows))
    assert bool(taken) == (rounds > 0)


def test_groups_too_large_for_a_task_are_matched_alike(spark):
    rows = tangled(6, ((4, 4), (3, 2)))
    df = spark.createDataFrame(rows, PAIRS)
    in_tasks, in_rounds = (match.optimal_matches(df, 0.0, largest).collect() for largest in (10**6, 0))
    for found in (in_tasks, in_rounds):
        assert one_to_one(found) and sum(r["iou"] for r in found) == pytest.approx(best_total(rows))


def plain_pairs(rows):
    out = set()
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[0] == b[0] and all(max(a[2 + k], b[2 + k]) <= min(a[5 + k], b[5 + k]) for k in range(3)):
                out.add((a[0], min(a[1], b[1]), max(a[1], b[1])))
    return out


BOX = "scene_id int, id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"


def test_boxes_of_all_sizes_meet_once(spark):
    rng, rows = np.random.default_rng(9), []
    for k in range(160):
        low = np.round(rng.uniform(-4, 4, 3), 1)
        side = np.round(rng.choice([0.0, 0.2, 0.5, 1.0, 4.0, 16.0], 3, p=[0.2, 0.3, 0.2, 0.2, 0.08, 0.02]), 1)
        rows.append((k % 2, k, *map(float, low), *map(float, np.round(low + side, 1))))
    rows += [(0, 1000, *rows[0][2:]), (1, 1001, *[-1e6] * 3, *[1e6] * 3)]
    got = [(r["scene_id"], r["a"]["id"], r["b"]["id"]) for r in boxes.box_pairs(spark.createDataFrame(rows, BOX), "id").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_pairs(rows)


def test_boxes_without_sound_bounds_meet_nothing(spark):
    unit = (0.0, 0.0, 0.0, 1.0, 1.0, 1.0)
    odd = [(0.0, 0.0, 0.0, 1.0, 1.0, v) for v in (None, float("nan"), float("inf"))]
    df = spark.createDataFrame([(0, i, *b) for i, b in enumerate([unit, *odd, unit])], BOX)
    assert [(r["a"]["id"], r["b"]["id"]) for r in boxes.box_pairs(df, "id").collect()] == [(0, 4)]
    assert boxes.box_pairs(df.limit(0), "id").count() == 0
    flat = boxes.box_pairs(df, "id", "xy").collect()
    assert len(flat) == 10
