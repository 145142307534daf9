"""Nearest neighbours, centroid clustering and the prefix trie against plain versions."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import centroids, neighbours, tries

from .conftest import SF

VECTORS = "vec_id long, embedding array<float>, label int, v int, bucket string, query long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "b", 2) for i, v in rows], VECTORS)


@pytest.fixture(scope="module")
def cloud():
    """Vectors in crowds of unequal lengths, equal ones, ties and rows that take no part."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 64))
    rows = [(i, (centres[i % 6] * (1 + i % 3) + rng.normal(0, 0.4, 64)).astype(np.float32).tolist()) for i in range(700)]
    same = rows[13][1]
    rows += [(i, same) for i in range(700, 760)]
    rows += [(760, None), (780, [0.0] * 64), (800, [1.0] * 63), (820, [float("nan")] + [1.0] * 63), (840, [None] + [1.0] * 63), (860, [float("inf")] * 64), (None, same), (880, []), (900, [1.0] + [0.0] * 63), (920, [-1.0] + [0.0] * 63)]
    return rows


def nearest(rows, k):
    kept = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 64 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, x = np.array([i for i, _ in kept]), np.stack([v for _, v in kept])
    out = {}
    for i, v in kept:
        if i % 20 == 0:
            score = neighbours.inner(np.repeat(v[None], len(x), 0), x)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_neighbours_near_brute_force(spark, cloud):
    expected, got = nearest(cloud, 20), found(neighbours.search(vectors(spark, cloud).repartition(3), F.col("vec_id") % 20 == 0))
    assert set(got) == set(expected)
    scores = {q: dict(nearest(cloud, 2000)[q]) for q in list(expected)[:3]}
    assert all(scores[q][i] == s for q in scores for i, s in got[q])
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    assert all(got[q] == sorted(got[q], key=lambda p: (-p[1], p[0])) for q in got)


def test_neighbours_are_all_when_all_buckets_are_visited(spark, cloud, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "VISITS", 50)
    got = found(neighbours.search(vectors(spark, cloud), F.col("vec_id") % 20 == 0, tables=1, success=0.999999, width=8.0))
    assert got == nearest(cloud, 20)


def test_neighbours_of_few_and_no_rows(spark):
    none = vectors(spark, [(1, None)])
    assert neighbours.search(none, F.col("vec_id") % 20 == 0).count() == 0
    few = vectors(spark, [(0, [1.0] * 64), (0, [1.0] * 64), (1, [1.0] * 64), (2, [-1.0] * 64)])
    assert found(neighbours.search(few, F.col("vec_id") % 20 == 0, success=0.999999, width=99.0)) == {0: [(1, 64.0), (2, -64.0)]}
    assert neighbours.search(vectors(spark, [(0, [1.0] * 64)]), F.col("vec_id") % 20 == 0).count() == 0


def test_probes_come_in_order_of_chance():
    h, rng = neighbours.Hashing(8, 1, 5, 1.3, 1.0, 1.0), np.random.default_rng(2)
    x = rng.normal(size=(40, 8))
    row, bucket = h.probes(0, x, 0.8)
    few, some = h.probes(0, x, 0.3)
    for i in range(len(x)):
        whole, part = bucket[row == i].tolist(), some[few == i].tolist()
        assert whole[: len(part)] == part and len(set(whole)) == len(whole)
    # neighbours at the distance are in a visited bucket about as often as told
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    inside = 0
    for i in range(len(x)):
        moved = rng.normal(size=(400, 9))
        near = np.r_[unit[i], 0.0] + moved / np.linalg.norm(moved, axis=1)[:, None]
        keys = h._key(0, np.floor((near @ h.directions[0] + h.shifts[0]) / h.width))
        inside += np.isin(keys, bucket[row == i]).sum()
    assert 0.72 < inside / (400 * len(x)) < 0.92


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and None not in v and np.isfinite(np.array(v, float)).all()]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in start]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [place(v)[1] for _, v in kept]
        for j in range(len(c)):
            if mine := [v for (_, v), o in zip(kept, own) if o == j]:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *place(v)[::-1]) for i, v in kept]
    per = {j: sum(d for _, o, d in last if o == j) for j in range(len(c))}
    return sorted((i, o, d, per[o], sum(per.values()), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, o, d in last)


def test_clusters_equal_plain_rounds(spark, cloud):
    rows = [r for r in cloud if r[0] is not None][::5] + cloud[-12:-7] + [(5, cloud[13][1])] * 3
    got = centroids.cluster(vectors(spark, rows).repartition(4))
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(tuple(r) for r in got.select(columns).collect()) == plain_clusters([r for r in rows if r[0] is not None])


def test_clusters_of_few_equal_and_no_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(20)]
    assert sorted(tuple(r) for r in centroids.cluster(vectors(spark, same)).collect()) == plain_clusters(same)
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted(tuple(r) for r in centroids.cluster(vectors(spark, few)).collect()) == plain_clusters(few)
    assert centroids.cluster(vectors(spark, [(1, None), (2, [1e30] * 64)])).count() == 0


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-30, 30, (500, 64)), rng.integers(-30, 30, (9, 64))
    c[4], x[:9] = c[2], c  # a tie between 2 and 4
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    best, least = centroids.nearest(x, c, np.argsort(-x.var(0)))
    assert (best == full.argmin(1)).all() and (least == full.min(1)).all()


TURNS = "conv_id long, turn long, role string, text string, place long, fa long, depth int"


def plain_trie(rows):
    sha = lambda t: hashlib.md5(t.encode()).hexdigest()
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append(((turn is not None, turn or 0), sha(f"{len(role)}:{role}{text}"), (role, text)))
    convs = {c: [t for *_, t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    nodes = {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = []
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        kids = [x for x in below if len(x) == len(k) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talk():
    rng, rows = np.random.default_rng(6), []
    for c in [*range(90, 190), 300, 307, 421, 422, 423, 999, 70012]:
        for t in range(int(rng.integers(0, 9))):
            rows.append((c, t, ["user", "assistant"][t % 2], f"say {int(rng.integers(0, 2)) if t else 0} \U0001f600"))
    rows += [(423, None, None, None), (423, None, "x", ""), (423, 4, "a", "b"), (423, 4, "a", "b"), (423, 4, "ab", ""), (None, 1, "user", "lost"), (500, 0, "user", "only"), (501, 0, "user", "w " * 4000)]
    rows += [(800, t, "user", f"long {t}") for t in range(300)] + [(801, t, "user", f"long {t}") for t in range(300)]
    return rows


@pytest.mark.parametrize("shard", [tries.SHARD, 40, 0])
def test_trie_equals_plain_nodes(spark, talk, shard):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in talk], TURNS).repartition(5)
    got = sorted((tuple(r) for r in tries.prefix_trie(df, shard).collect()), key=str)
    assert got == plain_trie(talk)


def test_trie_in_small_steps_and_pieces(spark, talk, monkeypatch):
    monkeypatch.setattr(tries, "STEP", 1)
    monkeypatch.setattr(tries, "PIECE", 3)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in talk], TURNS)
    assert sorted((tuple(r) for r in tries.prefix_trie(df).collect()), key=str) == plain_trie(talk)
    assert tries.prefix_trie(df.limit(0)).count() == 0


def test_level_order_bits():
    # a root with the trees 0 -> (1, 2 -> 3) and 4
    order, bits, _ = tries.louds(np.array([-1, 0, 0, 2, -1]), np.array([0, 1, 1, 2, 0]), np.arange(5))
    assert order.tolist() == [0, 4, 1, 2, 3]
    assert "".join("10"[not b] for b in bits) == "10" + "110" + "110" + "0" + "0" + "10" + "0"
    assert tries.parents_of(bits).tolist() == [-1, 0, 0, 1, 1, 4] and tries.degrees_of(bits).tolist() == [2, 2, 0, 0, 1, 0]


def test_queries_equal_sql(spark):
    import duckdb

    from pointloom.llm import queries

    con = duckdb.connect()
    for name in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name in ("op12_centroid_clustering", "op13_prefix_trie"):
        df = queries.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, df.select(columns).collect()), key=str) == sorted(expected, key=str)
