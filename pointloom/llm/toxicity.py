"""Toxicity: a learned lexicon as a trie, met with Levenshtein automata, and scores from the context of each hit.

Learning: over a bounded sample of labelled documents, a word is a term when the word pairs (word before, word) in
which it stands are of toxic documents almost alone; copies of a document add no pair. A beginning that many distinct
words share, nearly all of them of toxic documents alone, becomes a stem.

Matching: trie nodes with a count of edits are the states of the automaton of all terms at once; its transitions are
made as words need them and kept. Terms of at least FUZZY letters allow one edit, stems match as they are.

Scoring: a hit counts as quoted when it stands between quotation marks of its line or near a reporting word, else as abuse. A
logistic regression over the two sums, that of misspelled hits and that of stems gives the score; its weights say how far a
quotation counts. Null and empty texts have no hit and the score of such; without labels no term is known and the score
is the smoothed share of toxic labels.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .labelled import FIT_ROWS, fit_sample

FUZZY, WINDOW = 5, 6
#: Words that a worker remembers.
REMEMBERED = 300_000
#: Letters, with digits or signs that stand for letters inside a word.
TOKEN = r"[^\W\d_]+(?:[@$!*0-9]+[^\W\d_]+)*"
TOKEN_JAVA = r"\p{L}+(?:[@$!*0-9]+\p{L}+)*"
REPORTING = frozenset("said says wrote quote quoted quotes quoting reported called term word slur insult article citation dit cité zitat sagte dijo cita".split())
OPENING, CLOSING = "“«„\"", "”»“\""
MARKS = re.compile(f"[{OPENING}{CLOSING}]")


@dataclass
class Lexicon:
    """Terms and stems with their weights."""

    terms: dict[str, float]
    stems: dict[str, float]


class Matcher:
    """The automaton of all terms: word -> (weight, edits, is stem, term), or None."""

    def __init__(self, lexicon: Lexicon):
        self.children: list[dict[str, int]] = [{}]
        self.end: list[tuple | None] = [None]
        self.stem: list[tuple | None] = [None]
        self.fuzzy: list[bool] = [False]
        for word, weight in sorted(lexicon.terms.items()):
            self.end[self._node(word, len(word) >= FUZZY)] = (weight, word)
        for word, weight in sorted(lexicon.stems.items()):
            self.stem[self._node(word, False)] = (weight, word)
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.first = self._state(self._closed({(0, 0)}))

    def _node(self, word: str, fuzzy: bool) -> int:
        at = 0
        for c in word:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
                self.end.append(None)
                self.stem.append(None)
                self.fuzzy.append(False)
            at = self.children[at][c]
            self.fuzzy[at] |= fuzzy
        return at

    def _closed(self, found: set) -> frozenset:
        """With a letter of a term left out: an edit to any child."""
        return frozenset(found | {(child, 1) for node, edits in found if not edits for child in self.children[node].values() if self.fuzzy[child]})

    def _state(self, members: frozenset) -> int:
        if members not in self.states:
            self.states[members] = len(self.members)
            self.members.append(members)
            self.moves.append({})
        return self.states[members]

    def _move(self, state: int, c: str) -> int:
        found = set()
        for node, edits in self.members[state]:
            if (child := self.children[node].get(c)) is not None:
                found.add((child, edits))
            if not edits:
                found.add((node, 1))  # a letter too many
                found.update((x, 1) for x in self.children[node].values() if self.fuzzy[x])  # another letter
        to = self.moves[state][c] = self._state(self._closed(found)) if found else -1
        return to

    def match(self, word: str) -> tuple | None:
        state, best = self.first, None
        for c in word:
            state = self.moves[state].get(c, -2) if self.moves[state].get(c) is not None else self._move(state, c)
            if state < 0:
                return best
            if best is None:
                for node, edits in self.members[state]:
                    if not edits and self.stem[node]:
                        best = (self.stem[node][0], 0, True, self.stem[node][1])
        ends = [(edits, -self.end[node][0], self.end[node][1]) for node, edits in self.members[state] if self.end[node] and (not edits or len(self.end[node][1]) >= FUZZY)]
        if ends:
            edits, weight, term = min(ends)
            if best is None or not edits:
                return -weight, edits, False, term
        return best


class Words(dict):
    """word -> match, remembered up to a bound."""

    def __init__(self, matcher: Matcher):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: str):
        found = self.matcher.match(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


class Marks:
    """The quotation marks of the line that holds a place, found once for each line; places must not fall back by lines."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, 0, -1
        self.places: dict[str, list[int]] = {}

    def _line(self, place: int) -> None:
        if not self.start <= place <= self.end:
            self.start = self.text.rfind("\n", 0, place) + 1
            end = self.text.find("\n", place)
            self.end = len(self.text) if end < 0 else end
            self.places = {m: [] for m in OPENING + CLOSING}
            for m in MARKS.finditer(self.text, self.start, self.end):
                self.places[m[0]].append(m.start())

    def around(self, start: int, end: int) -> bool:
        """Whether start to end stands between marks of its line: an odd number of straight ones before it and one after it,
        or an opening one that no closing one has ended, and one that does later."""
        self._line(start)
        for a, b in zip(OPENING, CLOSING):
            left, right = self.places[a], self.places[b]
            i, j = bisect_left(left, start), bisect_left(right, start)
            if a == b:
                inside = i % 2 == 1
            else:
                inside = i > 0 and (j == 0 or left[i - 1] > right[j - 1])
            if inside and bisect_left(right, end) < len(right):
                return True
        return False


def reported(before: list[str], after: list[str]) -> bool:
    """Whether a reporting word is among those around a hit."""
    return not REPORTING.isdisjoint(before) or not REPORTING.isdisjoint(after)


def spans(text: str, words: Words, find, iterate) -> list[tuple[int, int, str, float, int, bool, bool]]:
    """Hits of a text: start, end, term, weight, edits, is stem, is quoted."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lower-cased; places are then of the lower-cased text
        text = low
    found = list(map(words.__getitem__, tokens := find(low)))
    if not any(found):
        return []
    out, marks = [], Marks(text)
    for i, m in enumerate(iterate(low)):
        if hit := found[i]:
            is_quoted = marks.around(*m.span()) or reported(tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW])
            out.append((*m.span(), hit[3], hit[0], hit[1], hit[2], is_quoted))
    return out


def evidence(hits: list) -> list[float]:
    """Sums over abuse, quotations, misspelled hits and stems, on a log scale, and whether there are several hits."""
    abuse = quotes = odd = stems = 0.0
    for *_, weight, edits, stem, is_quoted in hits:
        if is_quoted:
            quotes += weight
        elif edits:
            odd += weight
        elif stem:
            stems += weight
        else:
            abuse += weight
    return [np.log1p(abuse), np.log1p(quotes), np.log1p(odd), np.log1p(stems), float(len(hits) > 1)]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # of evidence, and the constant

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """All terms and stems of a sample (text, label), whose bound is theirs too."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_JAVA), F.lit(0))
    words = sample.select("label", tokens.alias("w")).where(F.size("w") > 0)
    before = F.concat(F.array(F.lit("")), F.slice("w", 1, F.size("w") - 1))
    pairs = words.select("label", F.explode(F.arrays_zip(before.alias("p"), F.col("w").alias("w"))).alias("x"))
    pairs = pairs.select(F.col("x.p").alias("p"), F.col("x.w").alias("w"), "label")
    contexts = pairs.groupBy("w", "p").agg(F.max("label").alias("toxic"), F.min("label").alias("all_toxic"))
    each = contexts.groupBy("w").agg(F.sum("all_toxic").alias("t"), F.sum(F.lit(1) - F.col("all_toxic")).alias("n")).persist()
    try:
        total = each.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
        all_t, all_n = float(total["t"] or 0), float(total["n"] or 0)
        if not all_t:
            return Lexicon({}, {})
        lift = F.log(F.col("t") / all_t) - F.log((F.col("n") + 0.5) / max(all_n, 1.0))
        terms = each.where((F.col("t") >= 4) & (F.length("w") >= 3)).select("w", lift.alias("weight")).where(F.col("weight") >= 3)
        lengths = F.array(*[F.lit(k) for k in (4, 5, 6, 7)])
        starts = each.select("t", "n", "w", F.explode(lengths).alias("k")).where(F.length("w") > F.col("k"))
        stems = starts.groupBy(F.expr("left(w, k)").alias("w")).agg(
            F.sum("t").alias("t"), F.sum("n").alias("n"), F.count_if(F.col("n") == 0).alias("pure"), F.count("*").alias("words")
        )
        stems = stems.where((F.col("t") >= 8) & (F.col("pure") >= 5) & (F.col("pure") >= 0.97 * F.col("words"))).select("w", lift.alias("weight")).where(F.col("weight") >= 3)
        told = lambda df: {r["w"]: float(r["weight"]) for r in df.collect()}
        found = told(stems)
        shortest = {w: v for w, v in found.items() if not any(w[:k] in found for k in range(4, len(w)))}
        return Lexicon(told(terms), shortest)
    finally:
        each.unpersist()


def _finders():
    pattern = re.compile(TOKEN)
    return pattern.findall, pattern.finditer


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Learns from at most `rows` labelled documents outside the held-out fold."""
    sample = fit_sample(docs, labels, label, rows)
    lexicon = learn_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (find, iterate) = Words(Matcher(lexicon)), _finders()
        for part in slices(batches):
            x = [evidence(spans(t or "", words, find, iterate)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    found = sample.mapInArrow(run, "label int, x array<double>").toPandas()
    y = found["label"].to_numpy(float) if len(found) else np.zeros(0)
    x = np.c_[np.stack(found["x"]), np.ones(len(y))] if len(y) else np.zeros((0, 6))
    order = np.lexsort((y, *x.T)) if len(y) else []
    x, y = x[order], y[order]
    share = (y.sum() + 1) / (len(y) + 2)
    w, keep = np.r_[np.zeros(5), np.log(share / (1 - share))], np.diag([0.05] * 5 + [1e-6])
    if len(y) and y.min() < y.max():
        for _ in range(25):  # Newton's steps, with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
    return Model(lexicon, w)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_hits, n_quoted and hits (start, end, term, edits, quoted) of every whole text."""
    hit = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words, (find, iterate) = Words(Matcher(model.lexicon)), _finders()
        for part in slices(batches):
            found = [spans(t or "", words, find, iterate) for t in part.column("text").to_pylist()]
            s = model.scores(np.array([evidence(h) for h in found]).reshape(-1, 5))
            rows = [[{"start": a, "end": b, "term": t, "edits": e, "quoted": q} for a, b, t, _, e, _, q in h] for h in found]
            counts = [pa.array([len(h) for h in found], pa.int64()), pa.array([sum(x[6] for x in h) for h in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), *counts, pa.array(rows, pa.list_(hit))], ["doc_id", "score", "n_hits", "n_quoted", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, n_hits long, n_quoted long, hits array<struct<start:int,end:int,term:string,edits:int,quoted:boolean>>"
    )


def keep_below(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows of docs whose texts score below the limit, with all their columns; a null text scores as an empty one."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col("text").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words, (find, iterate) = Words(Matcher(model.lexicon)), _finders()
        for part in slices(batches):
            x = np.array([evidence(spans(t or "", words, find, iterate)) for t in part.column("text").to_pylist()]).reshape(-1, 5)
            kept = pa.RecordBatch.from_arrays(part.columns[:-1], part.schema.names[:-1])
            yield kept.filter(pa.array(model.scores(x) < limit))

    fields = ", ".join(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return plain.mapInArrow(run, fields).toDF(*names)
