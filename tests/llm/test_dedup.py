import random

import duckdb
import numpy as np
import pytest

from pointloom.llm import components, lines, minhash, substrings
from pointloom.llm.common import Tables

from .brute import groups, repeats
from .conftest import SF


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module")
def noisy():
    """Texts with shared passages, copies and near copies of all degrees, ties at the threshold among them."""
    rng, rows = random.Random(4), []
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (19, 20, 21, 55, 90)]
    for i in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        if i % 2:
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(passages)
        if i % 5 == 4:
            text = rows[-rng.randint(1, 4)][1].split()
            for _ in range(rng.randint(0, 6)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, (" " if i % 7 else "\n").join(text)))
    rows += [(120, "a b c d e f g h i j k"), (121, "A b c d e f g h i j k"), (122, " ".join(["z"] * 70)), (123, "b a " * 30)]
    return rows


def test_substrings_equal_brute_force(spark, noisy):
    found = substrings.remove_repeats(spark.createDataFrame(noisy, "doc_id long, text string").repartition(5))
    assert by_id(found, "n_words", "n_removed", "kept") == repeats(noisy)


def test_substring_spans_cover_what_goes(spark, noisy):
    for r in substrings.remove_repeats(spark.createDataFrame(noisy, "doc_id long, text string")).collect():
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]


def test_substrings_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None]
    expected = repeats(rows)
    found = by_id(substrings.remove_repeats(odd), "n_words", "n_removed", "kept")
    assert found.pop(None) == (4, 0, "no id at all") and found == expected
    assert substrings.remove_repeats(nothing).count() == 0


def test_repeated_rows_are_one(spark):
    text = " ".join(f"w{i}" for i in range(30))
    found = substrings.remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_removed"]) for r in found.collect()) == [(1, 0), (1, 0), (2, 30)]


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(spark, noisy, size):
    found = minhash.link(spark.createDataFrame(noisy, "doc_id long, text string").repartition(4), size=size)
    assert {d: c for d, (c,) in by_id(found, "component_id").items()} == groups(noisy, size)


def test_families_are_compared_in_blocks(spark, monkeypatch):
    """Near copies of one base, more than a chunk holds."""
    monkeypatch.setattr(minhash, "CHUNK_ROWS", 20)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(rng.randint(1, 5)):
            text[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    found = minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), size=2)
    assert {d: c for d, (c,) in by_id(found, "component_id").items()} == groups(rows)


@pytest.mark.parametrize("chunk", [256, 4])
def test_links_in_a_crowd_of_strangers(spark, monkeypatch, chunk):
    """Every bucket of a similar pair has a smaller member that is similar to neither."""
    monkeypatch.setattr(minhash, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(6)
    has = np.zeros((3060, 1000), np.float32)
    for i in range(3000):
        has[i, rng.permutation(1000)[: rng.integers(480, 520)]] = 1
    for i in range(3000, 3060, 2):
        words = rng.permutation(1000)
        has[i, words[:500]] = has[i + 1, words[50:550]] = 1
    both = has @ has.T
    similarity = both / (has.sum(1)[:, None] + has.sum(1)[None] - both)
    links = [(a, b) for a, b in np.argwhere(similarity >= 0.8).tolist() if a < b]
    assert len(links) == 30 and all(b == a + 1 and a >= 3000 for a, b in links)
    rows = [(i, " ".join(f"w{k}" for k in np.nonzero(r)[0])) for i, r in enumerate(has)]
    found = minhash.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=1)
    assert {d: c for d, (c,) in by_id(found, "component_id").items() if d != c} == {b: a for a, b in links}


def test_links_among_pages_of_a_template(spark):
    """Strangers of smaller ids share sections with a similar pair, half of all sections each."""
    rng, rows = random.Random(0), []
    sections = [[f"s{k}w{i}" for i in range(10)] for k in range(12)]
    for i in range(3000):
        some = sorted(rng.sample(range(12), 6))
        rows.append((i, " ".join(w for k in some for w in sections[k]) + " " + " ".join(f"o{i}x{j}" for j in range(60))))
    for pair in range(6):
        whole = [w for k in rng.sample(range(12), 12) for w in sections[k]]
        changed = list(whole)
        for at in rng.sample(range(120), 5):
            changed[at] = f"c{pair}x{at}"
        rows += [(3000 + 2 * pair, " ".join(whole)), (3001 + 2 * pair, " ".join(changed))]
    found = minhash.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=2)
    assert {d: c for d, (c,) in by_id(found, "component_id").items() if d != c} == {d: c for d, c in groups(rows[3000:]).items() if d != c}


@pytest.mark.parametrize("name", ["component", "_doc", "_n", "n", "node", "rep", "key", "kept", "component_id", "a.b"])
def test_minhash_takes_clashing_names(spark, name):
    rows = [(1, "a b c d", "x"), (2, "a b c d", "y"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").toDF("doc_id", "text", name)
    found = minhash.link(docs, size=2)
    names = [c for c in docs.columns if c not in ("component_id", "kept")]
    assert found.columns == [*names, "n_shingles", "component_id", "kept"]
    assert sorted((r[0], r["component_id"]) for r in found.collect()) == [(1, 1), (2, 1), (3, 3)]
    if name not in ("component_id", "kept"):
        assert sorted((r[0], r[2]) for r in found.collect() if r[2]) == [(1, "x"), (2, "y")]
    assert minhash.one_of_each(docs).columns == docs.columns


@pytest.mark.parametrize("hub", [5000, 3])
def test_components_of_hubs_and_chains(spark, monkeypatch, hub, tmp_path):
    monkeypatch.setattr(components, "HUB", hub)
    rng = random.Random(2)
    edges = [("a", i, i + 1) for i in range(40)] + [("b", 7, i) for i in range(200)] + [("b", 1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)] + [("a", None, 3), ("a", 9, 9)]
    found = components.components(spark.createDataFrame(edges, "g string, u long, v long").repartition(3), Tables(spark, "test"), "c").collect()
    root = {(g, x): x for g, u, v in edges if u is not None and u != v for x in (u, v)}
    for _ in edges:
        for g, u, v in edges:
            if u is not None and u != v:
                root[g, u] = root[g, v] = min(root[g, u], root[g, v])
    assert {(r["g"], r["node"]): r["component"] for r in found} == root and len(found) == len(root)


def test_minhash_odd_rows(spark, odd, nothing):
    found = minhash.link(odd, size=2)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None]
    got = by_id(found, "component_id", "kept", "n_shingles")
    assert got.pop(None)[:2] == (None, True)
    expected = groups(rows)
    assert {d: c for d, (c, *_) in got.items()} == expected and all(k == (d == c) for d, (c, k, _) in got.items())
    assert got[0][2] == got[2][2] == 0 and got[3][2] == 1
    assert set(odd.columns) < set(found.columns)
    assert minhash.link(nothing).count() == 0 and minhash.one_of_each(nothing).columns == nothing.columns
    assert minhash.one_of_each(odd, size=2).count() == len(set(expected.values())) + 1


def test_lines_equal_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    from pointloom.llm.queries import op3_line_dedup

    got = sorted(tuple(r) for r in op3_line_dedup(spark, SF).select("doc_id", "kept_sha256", "n_lines", "n_removed").collect())
    assert got == sorted(con.execute(f"SELECT doc_id, kept_sha256, n_lines, n_removed FROM ({lines.oracle_sql()})").fetchall())
    assert len(got) == docs.count()


def test_lines_near_the_threshold(spark, odd, nothing):
    rows = [(i, f"own {i}\nshared\n  \nrare", f"s{i % 10}") for i in range(30)] + [(99, "nine\nx", "t")] + [(100 + i, "nine", f"s{i}") for i in range(9)]
    got = by_id(lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")), "text", "n_removed")
    assert got[0] == ("own 0\nshared\n  \nrare", 0) and got[5] == ("own 5\n  ", 2)
    assert got[99] == ("nine\nx", 0) and got[108] == ("", 1)  # ten sites in all
    again = by_id(lines.remove_boilerplate(odd), "n_lines", "n_removed")
    assert again[0] == (1, 0) and all(n == 0 for _, n in again.values())
    assert lines.remove_boilerplate(nothing).count() == 0
