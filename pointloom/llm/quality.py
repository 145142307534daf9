"""Quality classifier: a generalised additive model with pairwise interactions, boosted from shallow trees.

Rounds go over the features in turn; each fits a tree of at most four leaves to the bins of one feature and adds it to
that feature's lookup table. Pairs then do the same with a cut in either feature. A score is the sum of looked-up bins.

Features are counts over a text's bytes and words (see FEATURES); labels, languages, sources and ids are not among
them. A null or empty text has zeros for all features and so a score as well; equal texts have equal scores. Without
any labelled row, or with one class only, every score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, bytes_and_bounds, slices, word_spans
from .labelled import FIT_ROWS, fit_sample

FEATURES = [
    "log_bytes", "log_words", "symbols", "stops", "marks", "digits", "upper", "space", "high_bytes", "word_bytes", "distinct_words",
    "top_word", "same_as_last", "repeated_lines", "words_a_line", "symbol_words",
]
_CLASSES = [b"%&$#*|{}<>=@^~_+/\\[]", b".", b",;:!?\"'()-", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" \t\r\n\x0b\x0c", bytes(range(128, 256))]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(texts: pa.Array, hasher: WordHasher) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, bounds = bytes_and_bounds(texts)
    n = len(bounds) - 1
    out, size = np.zeros((n, len(FEATURES))), np.diff(bounds)
    cover = np.zeros(256, np.uint8)
    for i, group in enumerate(_CLASSES):
        cover[list(group)] = i + 1
    kinds = cover[data]
    counts = np.bincount(np.repeat(np.arange(n), size) * 8 + kinds, minlength=n * 8).reshape(n, 8)
    out[:, 2:9] = _ratio(counts[:, 1:], size[:, None])
    starts, ends, rows = word_spans(data, bounds)
    words, of = np.diff(rows), np.repeat(np.arange(n), np.diff(rows))
    out[:, 0], out[:, 1], out[:, 9] = np.log1p(size), np.log1p(words), _ratio(size - counts[:, 6], words)
    if len(starts):
        h = hasher.hashes(data, starts, ends)
        order = np.lexsort((h, of))
        first = np.r_[True, (of[order][1:] != of[order][:-1]) | (h[order][1:] != h[order][:-1])]
        at = np.nonzero(first)[0]
        times, owner = np.diff(np.r_[at, len(h)]), of[order][at]
        top = np.zeros(n)
        np.maximum.at(top, owner, times)
        out[:, 10], out[:, 11] = _ratio(np.bincount(owner, minlength=n), words), _ratio(top, words)
        same = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        out[:, 12] = _ratio(np.bincount(of[1:][same], minlength=n), words)
        out[:, 15] = _ratio(np.bincount(of[kinds[ends - 1] == 1], minlength=n), words)
    breaks = np.nonzero(data == 10)[0]
    edges = np.unique(np.r_[bounds, breaks, breaks + 1])
    a, b = edges[:-1], edges[1:]
    solid = (data[a] != 10) if len(a) else np.zeros(0, bool)
    a, b = a[solid], b[solid]
    if len(a):
        line_of = np.searchsorted(bounds, a, "right") - 1
        pairs = np.unique(np.stack([line_of.astype(np.uint64), hasher.hashes(data, a, b)]), axis=1)
        lines, kept = np.bincount(line_of, minlength=n), np.bincount(pairs[0].astype(np.int64), minlength=n)
        out[:, 13], out[:, 14] = _ratio(lines - kept, lines), _ratio(words, lines)
    return out


@dataclass
class Additive:
    """Bin edges and lookup tables of features and of pairs of features."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z, bins = np.full(len(x), self.base), self.bins(x)
        for i, t in enumerate(self.tables):
            z += t[bins[:, i]]
        for i, j, t in self.pairs:
            z += t[bins[:, i], bins[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of cutting a row of bins in two, and the first bin on the right."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gains))
    return float(gains[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values of a tree of few leaves over ordered bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, part = max((*_cut(g[a:b], h[a:b]), (a, b)) for a, b in parts)
        if gain <= 1e-6:
            break
        a, b = part
        parts.remove(part)
        parts += [(a, a + at), (a + at, b)]
    values = np.zeros(len(g))
    for a, b in parts:
        values[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return values


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of cutting a grid once along its rows and then each side once along its columns."""
    best, values = 0.0, np.zeros_like(g)
    for k in range(1, len(g)):
        sides, gain = [], -_gain(g.sum(), h.sum())
        for part in (slice(0, k), slice(k, len(g))):
            gs, hs = g[part].sum(0), h[part].sum(0)
            more, at = _cut(gs, hs)
            gain += more + _gain(gs.sum(), hs.sum())
            sides.append((part, gs, hs, at))
        if gain > best:
            best = gain
            for part, gs, hs, at in sides:
                values[part, :at] = gs[:at].sum() / (hs[:at].sum() + 1.0)
                values[part, at:] = gs[at:].sum() / (hs[at:].sum() + 1.0)
    return best, values


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 10, pairs: int = 5, rate: float = 0.25, bins: int = 24) -> Additive:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, i], np.arange(1, bins) / bins)) for i in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b, z = model.bins(x), np.full(len(y), model.base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            g, h = residual()
            step = rate * _tree(np.bincount(b[:, i], g, len(table)), np.bincount(b[:, i], h, len(table)))
            table += step
            z += step[b[:, i]]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        n, m = len(model.tables[i]), len(model.tables[j])
        return np.bincount(b[:, i] * m + b[:, j], v, n * m).reshape(n, m)

    g, h = residual()
    count = x.shape[1]
    ranked = sorted(((_quarters(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(count) for j in range(i + 1, count)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for gain, i, j in ranked[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = residual()
            step = rate * _quarters(grid(i, j, g), grid(i, j, h))[1]
            table += step
            z += step[b[:, i], b[:, j]]
    return model


def fit_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Additive:
    """Fits on at most `rows` labelled documents: their features, a few numbers each, are all that the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(5)
        for part in slices(batches):
            x = features(part.column("text"), hasher)
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["label", "x"])

    found = fit_sample(docs, labels, label, rows).mapInArrow(run, "label int, x array<double>").toPandas()
    if not len(found):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(found["x"]), found["label"].to_numpy(float)
    order = np.lexsort((y, *x.T))  # the same model whatever order the rows came in
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id and score, the probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(5)
        for part in slices(batches):
            s = model.scores(features(part.column("text"), hasher))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
