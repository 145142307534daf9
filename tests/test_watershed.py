"""The watershed against a plain flooding of dense grids, cell by cell."""

import numpy as np
import pytest

from pointloom.operators import watershed as ws


def cloud(seed, blobs, rest):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, s, (n, 3)) for c, s, n in blobs] + [rng.uniform(0, 1, (rest, 3))])


SCENES = {
    "blobs": cloud(3, [((0.2, 0.2, 0.2), 0.07, 160), ((0.55, 0.25, 0.2), 0.08, 150), ((0.8, 0.8, 0.3), 0.05, 90)], 12),
    "plateau": np.array([(x * 0.05 + 0.01, y * 0.05 + 0.01, 0.0) for x in range(14) for y in range(5)] + [(x * 0.05 + 0.01, 0.11, 0.3) for x in range(3)]),
    "one": np.array([[0.3, 0.3, 0.3]]),
}


def plain(p, size, separation, sigma, dilation, most):
    low, high = p.min(0), p.max(0)
    k = 0
    while np.prod(np.ceil((high - low) / (size * 1.1**k)) + 1) > most:
        k += 1
    res = size * 1.1**k
    dims = (np.ceil((high - low) / res) + 1).astype(int)
    idx = np.minimum(np.floor((p - low) / res).astype(int), dims - 1)
    occ = np.zeros(dims, bool)
    occ[tuple(idx.T)] = True
    six = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    inside = lambda c: all(0 <= a < n for a, n in zip(c, dims))
    for _ in range(dilation):
        more = occ.copy()
        for c in np.argwhere(occ):
            for s in six:
                if inside(c + s):
                    more[tuple(c + s)] = True
        occ = more
    empty = np.argwhere(~occ)
    height = np.zeros(dims)
    for c in np.argwhere(occ):
        height[tuple(c)] = np.sqrt(((empty - c) ** 2).sum(1).min()) if len(empty) else 0.0
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in range(3):
        n = dims[axis]
        at = np.arange(-radius, n + radius)
        at = np.where((at % (2 * n)) < n, at % (2 * n), 2 * n - 1 - at % (2 * n))
        height = np.apply_along_axis(lambda v: np.convolve(v[at], w, "valid"), axis, height)
    height = np.round(height, 9)
    cells = sorted((-height[tuple(c)], *map(int, c)) for c in np.argwhere(occ))
    rank = {c[1:]: i for i, c in enumerate(cells)}
    apart, marks = max(1, int(separation / res)), []
    for h, *c in cells:
        window = tuple(slice(max(0, a - apart), a + apart + 1) for a in c)
        if -h > 0 and -h >= np.where(occ, height, -1)[window].max() and all(max(abs(a - b) for a, b in zip(c, m)) > apart for m in marks):
            marks.append(tuple(c))
    group, marked = {c: c for c in rank}, {c: c in marks for c in rank}

    def find(c):
        while group[c] != c:
            c = group[c]
        return c

    edges = []
    for c in rank:
        for s in six:
            d = tuple(a + b for a, b in zip(c, s))
            if d in rank and rank[d] < rank[c]:
                edges.append((rank[c], rank[d], c, d))
    for *_, c, d in sorted(edges):
        a, b = find(c), find(d)
        if a != b and not (marked[a] and marked[b]):
            group[a], marked[b] = b, marked[a] or marked[b]
    owner = [find(tuple(map(int, i))) for i in idx]
    first = {}
    for i, o in enumerate(owner):
        first.setdefault(o, i)
    return [first[o] if marked[o] else None for o in owner]


@pytest.mark.parametrize("separation,sigma,dilation,most", [(0.2, 0.8, 1, 1 << 30), (0.06, 1.0, 0, 3000)])
def test_watershed_equals_plain_flooding(spark, separation, sigma, dilation, most):
    rows = [(s, i, *map(float, p)) for s, ps in SCENES.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "scene_id string, point_id long, x double, y double, z double").repartition(3)
    got = {}
    for r in ws.watershed(df, 0.05, separation, sigma, dilation, most_cells=most).collect():
        got.setdefault(r["scene_id"], {})[r["point_id"]] = r["label"]
    for s, p in SCENES.items():
        expected = plain(p, 0.05, separation, sigma, dilation, most)
        assert [got[s][i] for i in range(len(p))] == expected
    assert len(set(plain(SCENES["blobs"], 0.05, separation, sigma, dilation, most)) - {None}) > 1


def test_watershed_of_nothing(spark):
    df = spark.createDataFrame([], "scene_id string, point_id long, x double, y double, z double")
    assert ws.watershed(df, 0.05, 0.2).count() == 0
