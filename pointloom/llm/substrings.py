"""Substring dedup: seeds from winnowed anchors, extended both ways to maximal repeats, of which the first stays.

A window is LENGTH consecutive words of one document. It repeats if the same words also start earlier: in a smaller
document, or earlier in the same one. All words that a repeating window covers go; windows are judged on the input.

Anchors: each window picks the least hash among its grams of GRAM words (the rightmost of equals), so equal windows pick
equal grams at equal places. Windows side by side that pick the same gram are its run. A seed is an anchor whose gram
is picked more than once anywhere: seeds come from an aggregation of gram hashes and a join with it. Windows of other
anchors repeat nowhere.

Extension: the words from the first to the last window of a run are its span, the reach of the seed to both sides. Of
seeds with equal spans only the first can hold a window that has not started earlier, so all others repeat in full and
need no look at the texts, however many there are. The first of each span goes window by window against the firsts of
the other spans of its gram, by hashes of whole windows: an aggregation finds where each starts first. Runs cut a
document's windows without gaps, so repeating runs and windows join to maximal repeats.

Copies of a whole text are told by their hash: all but the one of the smallest doc_id lose every word that a window
covers, without seeds. Null texts have no words, and texts of fewer than LENGTH words stay. Rows that share a doc_id
stand in the order of a hash of their text, and equal rows are one. Words and windows are compared by 64-bit hashes.
Null doc_ids stand first. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, WordHasher, bytes_and_bounds, ngram_hashes, slices, word_spans

LENGTH, GRAM = 20, 8


class Runs:
    """Runs of one document's windows: gram hash, first window, number of windows and hash of the span."""

    def __init__(self, words: np.ndarray, length: int, gram: int):
        self.windows = max(0, len(words) - length + 1)
        self.first = np.zeros(0, np.int64)
        if not self.windows:
            return
        grams = ngram_hashes(words, gram, 1)
        views = np.lib.stride_tricks.sliding_window_view(grams[:, None], length - gram + 1, axis=0)[:, 0, ::-1]
        picked = np.arange(self.windows) + length - gram - np.argmin(views, axis=1)
        self.first = np.nonzero(np.r_[True, picked[1:] != picked[:-1]])[0]
        self.count = np.diff(np.r_[self.first, self.windows])
        self.gram = grams[picked[self.first]]
        # spans by prefix sums of a polynomial, as their lengths differ
        up, down = _powers(len(words))
        total = np.r_[np.uint64(0), np.cumsum(words * up[: len(words)])]
        end = self.first + self.count - 1 + length
        self.span = ((total[end] - total[self.first]) * down[self.first]) ^ (self.count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0xD1342543DE82EF95
_kept: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_kept[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(max(2 * n, 1 << 16), np.uint64(base), np.uint64)
            p[0] = 1
            _kept[i] = np.cumprod(p)
    return _kept


def _documents(part: pa.RecordBatch, hasher: WordHasher) -> Iterator[tuple]:
    """Bytes, word starts, word ends and word hashes of each text."""
    data, bounds = bytes_and_bounds(part.column("text"))
    starts, ends, rows = word_spans(data, bounds)
    words = hasher.hashes(data, starts, ends)
    for a, b in zip(rows[:-1], rows[1:]):
        yield data, starts[a:b], ends[a:b], words[a:b]


def _key_schema_of(docs: DataFrame) -> str:
    return f"doc {docs.schema['doc'].dataType.simpleString()}, of int"


def _anchors(docs: DataFrame, length: int, gram: int, spans: bool) -> DataFrame:
    """Gram hash of every anchor, or with spans also doc, of, at (first window), n (windows) and span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(9)
        for part in slices(batches):
            found = [Runs(words, length, gram) for *_, words in _documents(part, hasher)]
            full = [i for i, r in enumerate(found) if len(r.first)]
            if not full:
                continue
            joined = lambda f: np.concatenate([f(found[i]) for i in full])
            columns = {"gram": joined(lambda r: r.gram).view(np.int64)}
            if spans:
                row = pa.array(np.repeat(full, [len(found[i].first) for i in full]))
                columns |= {"doc": part.column("doc").take(row), "of": part.column("of").take(row)}
                columns |= {"at": joined(lambda r: r.first).astype(np.int32), "n": joined(lambda r: r.count).astype(np.int32), "span": joined(lambda r: r.span).view(np.int64)}
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    more = f", {_key_schema_of(docs)}, at int, n int, span long" if spans else ""
    return docs.select("doc", "of", "text").mapInArrow(run, f"gram long{more}")


def _windows(seeds: DataFrame, length: int) -> DataFrame:
    """doc, of, at and hash of every window in the runs listed (array of at and n) beside each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(9)
        for part in slices(batches):
            rows, at, hashes = [], [], []
            for i, (listed, (*_, words)) in enumerate(zip(part.column("runs").to_pylist(), _documents(part, hasher))):
                places = _places([(r["at"], r["n"]) for r in listed])
                rows.append(np.full(len(places), i))
                at.append(places)
                hashes.append(ngram_hashes(words, length, 2)[places])
            row = pa.array(np.concatenate(rows))
            columns = [part.column("doc").take(row), part.column("of").take(row), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "of", "at", "window"])

    return seeds.select("doc", "of", "text", "runs").mapInArrow(run, f"{_key_schema_of(seeds)}, at int, window long")


def _places(runs: list[tuple[int, int]]) -> np.ndarray:
    """All windows of runs (first window, number)."""
    if not runs:
        return np.zeros(0, np.int64)
    first, n = np.array(runs, np.int64).T
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["doc"].eqNullSafe(b["doc"]) & (a["of"] == b["of"])


def repeats(docs: DataFrame, tables: Tables, length: int, gram: int) -> DataFrame:
    """doc, of, seeds, firsts and late: runs (at, n) of seeds, those of them that are the first of their span, and
    the windows in the latter that still repeat. docs: doc, of and text, without copies."""
    # what is joined with a skewed side is written first: between two plain exchanges Spark can split a hot key's rows
    grams = tables.write(_anchors(docs, length, gram, False).groupBy("gram").agg(F.count("*").alias("times")).where("times > 1").select("gram"), "grams")
    seeds = tables.write(_anchors(docs, length, gram, True).join(grams, "gram"), "seeds")
    firsts = tables.write(seeds.groupBy("gram", "span").agg(F.min(F.struct("doc", "of", "at", "n")).alias("first")), "firsts")
    several = tables.write(firsts.groupBy("gram").agg(F.count("*").alias("spans")).where("spans > 1").select("gram"), "several")
    compared = firsts.join(several, "gram", "left_semi").select("first.*")
    run = F.struct("at", "n")
    listed = compared.groupBy("doc", "of").agg(F.collect_list(run).alias("runs"))
    beside = docs.join(listed, _same_key(docs, listed)).select(docs["doc"], docs["of"], "text", "runs")
    windows = tables.write(_windows(beside, length), "windows")
    place = F.struct("doc", "of", "at")
    earliest = windows.groupBy("window").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least != most").select("window", "least")
    earliest = tables.write(earliest, "earliest")
    late = windows.join(earliest, "window").where(place != F.col("least")).select("doc", "of", F.struct("at", F.lit(1).alias("n")).alias("run"), F.lit("late").alias("kind"))
    everything = late.unionByName(seeds.select("doc", "of", run.alias("run"), F.lit("seed").alias("kind")))
    everything = everything.unionByName(firsts.select("first.doc", "first.of", F.struct("first.at", "first.n").alias("run"), F.lit("first").alias("kind")))
    lists = {k: F.collect_list(F.when(F.col("kind") == k, F.col("run"))).alias(f"{k}s") for k in ("seed", "first", "late")}
    return everything.groupBy("doc", "of").agg(*lists.values())


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, removed (maximal repeats as start and end word) and kept: the words that stay, joined
    by one space."""
    tables = Tables(docs.sparkSession, "substrings")
    keyed = docs.select(F.col("doc_id").alias("doc"), F.hash(text).alias("of"), F.col(text).alias("text"))
    digest = [F.xxhash64("text").alias("h"), F.crc32("text").alias("c"), F.octet_length("text").alias("size")]
    classes = keyed.where("text IS NOT NULL").select("doc", "of", *digest).groupBy("h", "c", "size").agg(F.min(F.struct("doc", "of")).alias("first"), F.count("*").alias("times"))
    copied = tables.write(classes.where("times > 1").select("h", "c", "size", "first"), "copied")
    rows = keyed.select("doc", "of", *digest).join(copied, ["h", "c", "size"])
    # of copies the first only, and one row of it; a text of its own has no row here
    later = tables.write(rows.where(F.struct("doc", "of") != F.col("first")).select("doc", "of").distinct(), "later")
    single = keyed.join(later, _same_key(keyed, later), "left_anti")
    found = tables.write(repeats(single, tables, length, gram), "found")
    told = found.select("doc", "of", "seeds", "firsts", "lates", F.lit(False).alias("copy")).unionByName(
        later.select("doc", "of", *[F.expr("cast(array() as array<struct<at:int,n:int>>)").alias(c) for c in ("seeds", "firsts", "lates")], F.lit(True).alias("copy"))
    )
    beside = keyed.join(told, _same_key(keyed, told), "left").select(keyed["doc"], "text", "seeds", "firsts", "lates", "copy")
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(9)
        for part in slices(batches):
            counts, gone_counts, removed, kept = [], [], [], []
            listed = [part.column(c).to_pylist() for c in ("seeds", "firsts", "lates", "copy")]
            for seeds, firsts, lates, copy, (data, starts, ends, words) in zip(*listed, _documents(part, hasher)):
                m = len(words)
                windows = np.zeros(max(0, m - length + 1), bool)
                if copy:
                    windows[:] = True
                elif seeds:
                    windows[_places([(r["at"], r["n"]) for r in seeds])] = True
                    windows[_places([(r["at"], r["n"]) for r in firsts])] = False
                    windows[_places([(r["at"], r["n"]) for r in lates])] = True
                edge = np.zeros(m + 1, np.int64)
                at = np.nonzero(windows)[0]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:m]) > 0
                turns = np.nonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))[0].reshape(-1, 2)
                counts.append(m)
                gone_counts.append(int(gone.sum()))
                removed.append([{"start": int(a), "end": int(b)} for a, b in turns])
                raw = data.tobytes() if not m else data[starts[0] : ends[-1]].tobytes()
                base = starts[0] if m else 0
                kept.append(b" ".join(raw[a:b] for a, b in zip((starts[~gone] - base).tolist(), (ends[~gone] - base).tolist())).decode() if m else "")
            columns = [pa.array(counts, pa.int64()), pa.array(gone_counts, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("doc"), *columns], ["doc_id", "n_words", "n_removed", "removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return beside.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string")
