import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pointloom.llm import decontaminate, quality, toxicity
from pointloom.llm.queries import op1_toxicity, op6_quality

from .brute import auc, groups, overlaps
from .conftest import SF

LARGER = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("query", "label", "least"), [(op1_toxicity, "toxic", 0.95), (op6_quality, "quality", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = query(spark, LARGER).collect()
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == 10000 and all(0 <= r["score"] <= 1 for r in rows)
    assert auc(*zip(*held)) >= least


def test_models_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for docs, known in ((odd, labels), (odd, labels.limit(0)), (nothing, labels), (nothing, labels.limit(0))):
        a = toxicity.score(docs, toxicity.fit(docs, known)).collect()
        b = quality.score(docs, quality.fit_documents(docs, known)).collect()
        assert len(a) == len(b) == docs.count() and all(0 <= r["score"] <= 1 for r in [*a, *b])
        same = {r["doc_id"]: r["score"] for r in b}
        assert not same or same[11] == same[12]


def test_misspelled_and_quoted_terms():
    lexicon = toxicity.Lexicon({"worthless": 4.0, "idiot": 4.0}, {"moron": 3.0})
    words, (find, iterate) = toxicity.Words(toxicity.Matcher(lexicon)), toxicity._finders()
    hits = lambda t: [(h[2], h[4], h[6]) for h in toxicity.spans(t, words, find, iterate)]
    assert hits("you worthles idiiot") == [("worthless", 1, False), ("idiot", 1, False)]
    assert hits('he said "idiot" aloud') == [("idiot", 0, True)] and hits("moronic") == [("moron", 0, False)]
    assert hits("worth less ideas") == []


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [last := i + 1] + [last := min(row[j] + (x != y), row[j + 1] + 1, last + 1) for j, y in enumerate(b)]
        return row[-1]

    matcher = toxicity.Matcher(toxicity.Lexicon({"abcde": 1.0, "abxyz": 1.0}, {}))
    import itertools

    for word in ["".join(w) for n in (4, 5, 6) for w in itertools.islice(itertools.product("abcdexyz", repeat=n), 0, None, 37)]:
        assert (matcher.match(word) is not None) == (min(distance(word, t) for t in ("abcde", "abxyz")) <= 1), word


def test_decontamination_equals_brute_force(spark, odd, nothing):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    listed = items.collect()
    got = {r["doc_id"]: sorted(m["item"] for m in r["matches"]) for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {r["doc_id"]: sorted({i["item_id"] for i in listed if overlaps(r["text"], i["text"])}) for r in docs.collect()}
    assert decontaminate.clean(odd, items).count() == odd.count() and decontaminate.clean(odd, items.limit(0)).columns == odd.columns
    assert decontaminate.overlaps(nothing, items).count() == 0


@pytest.mark.parametrize("bits", [(128, 16, 26), (1, 6, 6)])
def test_any_bitmap_gives_the_same_matches(spark, monkeypatch, bits):
    """A bitmap that is too small lets more seeds pass, and changes nothing."""
    for name, value in zip(("BITS", "LEAST_BITS", "MOST_BITS"), bits):
        monkeypatch.setattr(decontaminate, name, value)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(40)]
    items += [(100 + i, items[i][1]) for i in range(20)] + [(200, None), (201, ""), (None, "w1 w2")]
    docs = []
    for i in range(150):
        text = [rng.choice(vocabulary + ["x", "y"]) for _ in range(rng.randint(0, 40))]
        words = rng.choice(items[:40])[1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "z"
        at = rng.randint(0, len(text))
        docs.append((i, " ".join(text[:at] + words + text[at:])))
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    told = {r["doc_id"]: [m["item"] for m in r["matches"]] for r in found.collect()}
    assert told == {d: [i for i, x in items if i is not None and overlaps(t, x)] for d, t in docs}


def test_rows_that_share_an_id_are_told_apart(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text, 5), (1, "clean words here", 6), (None, text, 7), (None, None, 8)], "doc_id long, text string, n int").toDF("doc_id", "text", "a.b")
    items = spark.createDataFrame([(9, "v " + text)], "item_id long, text string")
    assert sorted(r["a.b"] for r in decontaminate.clean(docs, items).collect()) == [6, 8]


def test_templates_of_many_items_and_documents(spark):
    """One long template in all items and many documents, at different places, with words changed and cut off at the ends."""
    rng = np.random.default_rng(14)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    template = word(45)
    items = [(i, " ".join(word(i % 4) + template[i % 3 :] + word(i % 5))) for i in range(14)]
    docs = []
    for d in range(40):
        middle = template[d % 30 :]
        if d % 3 == 0:
            middle = [w if k % 9 else "changed" for k, w in enumerate(middle)]
        docs.append((d, " ".join(word(d % 7) + middle + word(d % 11))))
    docs += [(d, docs[d % 5][1]) for d in range(40, 60)] + [(60, " ".join(template[:12])), (61, " ".join(word(50)))]
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    told = {r["doc_id"]: [(m["item"], m["start"], m["end"], m["agree"]) for m in r["matches"]] for r in found.collect()}
    assert {d: [m[0] for m in ms] for d, ms in told.items()} == {d: [i for i, x in items if overlaps(t, x)] for d, t in docs}
    texts, wanted = dict(docs), dict(items)
    for d, matches in told.items():
        for i, start, end, agree in matches:
            mine, known = texts[d].split(), wanted[i].split()
            best = max(sum(a == b for a, b in zip(mine[s : s + 13], known[o : o + 13])) for s in range(start, end - 12) for o in range(len(known) - 12))
            assert 0 <= start < end <= len(mine) and agree == best
    assert told[61] == []


def test_decontamination_tolerates_substitutions(spark):
    words = [f"w{i}" for i in range(40)]
    changed = [("x" if i in (3, 9) else w) for i, w in enumerate(words[:13])]
    worse = [("x" if i in (1, 5, 9) else w) for i, w in enumerate(words[:13])]
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(worse)), (3, "tiny item here"), (4, "tiny item"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, "Tiny item HERE"), (3, None), (4, "")], "item_id long, text string")
    got = {r["doc_id"]: [m["item"] for m in r["matches"]] for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {1: [1], 2: [], 3: [2], 4: [], 5: []}


def test_pipeline_equals_stages_by_hand(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    scores = {r["doc_id"]: r["score"] for r in op1_toxicity(spark, SF).collect()}
    left = {d: r for d, r in docs.items() if scores[d] < corpus_pipeline.TOXIC}
    lines: dict = {}
    for d in sorted(left):
        for at, line in enumerate((left[d]["text"] or "").split("\n")):
            if line.strip(" "):
                lines.setdefault(line, []).append((d, at, left[d]["source"]))
    gone = {(d, at) for places in lines.values() if len({s for *_, s in places}) >= 10 for d, at, _ in places[1:]}
    texts = {d: "\n".join(x for at, x in enumerate((r["text"] or "").split("\n")) if (d, at) not in gone) for d, r in left.items()}
    parts = groups(texts.items(), 5)
    texts = {d: t for d, t in texts.items() if parts[d] == d}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {d: t for d, t in texts.items() if not any(overlaps(t, i) for i in items)}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {d: t.encode(x, add_special_tokens=False).ids for d, x in texts.items()}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()} == expected


def test_stages_take_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() >= docs.count() - 1, name
