"""Benchmark decontamination: spaced seeds join documents with test items, and the words around each hit verify.

Words are runs of letters, digits and bytes above 127, lower-cased in A-Z. A mask of a seed reads only some of the
positions it spans. An overlap is a stretch of WINDOW words, at the same distance in document and item, of which at
least MATCHES agree; the two masks together hit every such stretch, whichever of its words were substituted. Items of
fewer than WINDOW words count only where all of their words appear in a row.

The seeds of distinct item texts are a table. A bitmap of them, of at most 2 ** MOST_BITS bits whatever their number, is
broadcast, and documents give the seeds that it may hold, each with the words around it. One join on the seed brings
the distinct surroundings of both sides together; as every overlap holds a seed, they suffice to verify it, row by row, and
no text is shuffled. So a passage of many documents or a template of many items is compared once, and only what agrees
goes back to documents and items. With more items than the bitmap tells apart, more seeds are shuffled and the results are the same.

Null and empty texts and items match nothing; items with a null id are left out; repeated items are looked up once and
all told; repeated documents give the same result each. Other columns pass through `clean`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, WordHasher, bytes_and_bounds, mix, slices

WINDOW, MATCHES = 13, 11
MASKS = ("11110101", "10100001111")
#: Bits of the bitmap for each seed, and the logarithms of its least and largest size (8 MB).
BITS, LEAST_BITS, MOST_BITS = 128, 16, 26

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(data: np.ndarray, bounds: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the bounds of the rows' words."""
    solid = _WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.nonzero(solid & ~before)[0], np.nonzero(solid & ~after)[0] + 1
    return hasher.hashes(data, starts, ends), np.searchsorted(starts, bounds)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask laid at each place where it fits."""
    count = len(words) - len(mask) + 1
    h = np.full(max(0, count), np.uint64(len(mask) * 31 + int(mask, 2)), np.uint64)
    for j, read in enumerate(mask):
        if read == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(h)]
    return mix(h)


def _around(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, mask: str, outside: int) -> np.ndarray:
    """The words of all windows that hold the mask laid at `at`, a row for each; outside the text's bounds a filler."""
    n = len(mask)
    reach = np.arange(0, n) if n < WINDOW and mask not in MASKS else np.arange(n - WINDOW, WINDOW)
    places = at[:, None] + reach
    inside = (places >= low[:, None]) & (places < high[:, None])
    return np.where(inside, words[np.clip(places, 0, len(words) - 1)], np.uint64(outside))


def _seeds_of(part: pa.RecordBatch, hasher: WordHasher, outside: int, masks: list[str], seen=None) -> Iterator[tuple]:
    """Row, seed, place in the row and words around, for each mask; with `seen` only seeds that it may hold. Without masks
    told, a row has those of MASKS, or where it is shorter than a window the mask of all its words."""
    words, rows = words_of(*bytes_and_bounds(part.column("text")), hasher)
    length = np.diff(rows)
    for mask in masks or [*MASKS, *("1" * n for n in range(1, WINDOW))]:
        h = seeds(words, mask)
        at = np.arange(len(h)) if seen is None else np.nonzero(seen(h))[0]
        row = np.searchsorted(rows, at, "right") - 1
        ok = at + len(mask) <= rows[row + 1]
        if not masks:
            ok &= (length[row] >= WINDOW) if mask in MASKS else (length[row] == len(mask))
        at, row = at[ok], row[ok]
        if len(at):
            around = _around(words, at, rows[row], rows[row + 1], mask, outside)
            yield row, h[at], at - rows[row], [a.tobytes() for a in around]


def _seed_rows(texts: DataFrame, keys: list[str], masks: list[str], outside: int, bitmap=None) -> DataFrame:
    """keys, seed, place and around of the seeds in texts (keys and text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(11, lower=True)
        seen = bitmap and _tester(bitmap.value)
        for part in slices(batches):
            for row, seed, place, around in _seeds_of(part, hasher, outside, masks, seen):
                taken = [part.column(k).take(pa.array(row)) for k in keys]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(seed.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(around, pa.binary())], [*keys, "seed", "place", "around"])

    fields = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, "text").mapInArrow(run, f"{fields}, seed long, place int, around binary")


def _tester(bitmap: np.ndarray):
    """Whether seeds may be among those of the bitmap: two of its bits are theirs."""
    bits = int(len(bitmap) * 64).bit_length() - 1
    low = np.uint64((1 << bits) - 1)

    def has(p: np.ndarray) -> np.ndarray:
        return (bitmap[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)

    def seen(h: np.ndarray) -> np.ndarray:
        found = has(h >> np.uint64(64 - bits))
        found[found] = has(h[found] >> np.uint64(12) & low)
        return found

    return seen


def _bitmap(seeds: DataFrame, count: int) -> np.ndarray:
    """At most 2 ** MOST_BITS bits, told as 64-bit words that are not 0."""
    bits = min(MOST_BITS, max(LEAST_BITS, (count * BITS).bit_length()))
    places = F.expr(f"explode(array(shiftrightunsigned(seed, {64 - bits}), shiftrightunsigned(seed, 12) & {(1 << bits) - 1}L))")
    words = seeds.select(places.alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("set"))
    found = words.toPandas()  # no more rows than the bitmap has words
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["set"].to_numpy(np.int64).view(np.uint64)
    return out


def _verified(met: DataFrame) -> DataFrame:
    """seed, here, there, first word and end (from the seed's place on) and agree (the most words that agree in a window) of
    surroundings around and of_item in which a window agrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ours, theirs = batch.column("around").to_pylist(), batch.column("of_item").to_pylist()
            lengths = np.array([len(a) if len(a) == len(b) else 0 for a, b in zip(ours, theirs)])
            start, end, agree = (np.zeros(batch.num_rows, np.int32) for _ in range(3))
            for size in np.unique(lengths[lengths > 0]):
                rows, n = np.nonzero(lengths == size)[0], size // 8
                a, b = (np.frombuffer(b"".join(v[i] for i in rows), np.uint64).reshape(-1, n) for v in (ours, theirs))
                if n < WINDOW:
                    agree[rows[(a == b).all(axis=1)]] = n
                    start[rows], end[rows] = 0, n
                    continue
                same, inside = (np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1) for x in (a == b, (a != 0) & (b != 1)))
                total = np.where(inside[:, WINDOW:] - inside[:, :-WINDOW] == WINDOW, same[:, WINDOW:] - same[:, :-WINDOW], 0)
                good, low = total >= MATCHES, WINDOW - n
                agree[rows] = np.where(good.any(axis=1), total.max(axis=1), 0)
                start[rows], end[rows] = low + good.argmax(axis=1), low + n - good[:, ::-1].argmax(axis=1)
            columns = [*(batch.column(c) for c in ("seed", "here", "there")), pa.array(start), pa.array(end), pa.array(agree)]
            yield pa.RecordBatch.from_arrays(columns, ["seed", "here", "there", "start", "end", "agree"]).filter(pa.array(agree > 0))

    return met.mapInArrow(run, "seed long, here long, there long, start int, end int, agree int")


def _found(docs: DataFrame, benchmark: DataFrame, item: str, text: str, tables: Tables) -> DataFrame | None:
    """doc, of, item, start, end and agree of every overlap of docs (doc, of, text), or None if there are no items."""
    known = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    items = tables.write(known.groupBy("text").agg(F.min("item").alias("tid")), "items")
    made = _seed_rows(items, ["tid"], [], 1).select("seed", "tid", F.col("place").alias("item_place"), F.col("around").alias("of_item"), F.xxhash64("around").alias("there"))
    theirs = tables.write(made, "seeds")
    shorts = theirs.select((F.octet_length("of_item") / 8).cast("int").alias("n")).groupBy("n").agg(F.count("*").alias("times")).collect()  # of each length one row
    if not shorts:
        return None
    masks = [*MASKS, *("1" * n for n in sorted(r["n"] for r in shorts) if n < WINDOW)]
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(theirs, sum(r["times"] for r in shorts)))
    # written first: between two plain exchanges Spark can split the rows of a hot seed
    hits = tables.write(_seed_rows(docs, ["doc", "of"], masks, 0, bitmap).withColumn("here", F.xxhash64("around")), "hits")
    # a passage of many documents, or a template of many items, has equal surroundings: each two are compared once
    ours = hits.groupBy("seed", "here").agg(F.first("around").alias("around"))
    apart = theirs.groupBy("seed", "there").agg(F.first("of_item").alias("of_item"))
    agreed = tables.write(_verified(ours.join(tables.write(apart, "surroundings"), "seed")), "agreed")
    of_items = tables.write(agreed.join(theirs.select("seed", "there", "tid", "item_place"), ["seed", "there"]), "of-items")
    at = [F.col("place") + F.col(c) for c in ("start", "end")]
    met = hits.select("doc", "of", "seed", "here", "place").join(of_items, ["seed", "here"])
    met = met.select("doc", "of", "tid", (F.col("place") - F.col("item_place")).alias("shift"), at[0].alias("start"), at[1].alias("end"), "agree")
    each = met.groupBy("doc", "of", "tid", "shift").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("agree").alias("agree"))
    best = F.max(F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s"), "agree"))
    best = each.groupBy("doc", "of", "tid").agg(best.alias("b")).select("doc", "of", "tid", (-F.col("b.s")).alias("start"), (F.col("b.n") - F.col("b.s")).alias("end"), "b.agree")
    members = known.join(items, "text").select("tid", "item").distinct()
    return tables.write(best.join(members, "tid").select("doc", "of", "item", "start", "end", "agree"), "found")


def _of(text: str | Column) -> Column:
    return F.xxhash64(text)


def overlaps(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id and matches of every row of docs: item, first word, end word and the most words that agree in a window, of
    each item that overlaps, at the shift of its longest overlap."""
    keyed = docs.select(F.col("doc_id").alias("doc"), _of("text").alias("of"), "text")
    tables = Tables(docs.sparkSession, "overlaps")
    found = _found(keyed, benchmark, item, text, tables)
    none = F.expr(f"cast(array() AS array<struct<item:{benchmark.schema[item].dataType.simpleString()},start:int,end:int,agree:int>>)")
    if found is None:
        return docs.select("doc_id", none.alias("matches"))
    listed = found.groupBy(F.col("doc").alias("_doc"), F.col("of").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("item", "start", "end", "agree"))).alias("matches"))
    listed = tables.write(listed, "listed")
    out = keyed.join(listed, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("of") == F.col("_of")), "left")
    return out.select(F.col("doc").alias("doc_id"), F.coalesce("matches", none).alias("matches"))


def clean(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of docs whose text overlaps no item."""
    names, tables = docs.columns, Tables(docs.sparkSession, "clean")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc, body = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    found = _found(plain.select(doc.alias("doc"), _of(body).alias("of"), body.alias("text")), benchmark, item, text, tables)
    if found is None:
        return docs
    dirty = tables.write(found.select("doc", "of").distinct(), "dirty")
    return plain.join(dirty, doc.eqNullSafe(F.col("doc")) & (_of(body) == F.col("of")), "left_anti").toDF(*names)
