"""MinHash near-dedup: universal hash minima in bands, signatures that vouch for pairs, exact sets, and components.

A document's set is its distinct word shingles (with fewer words than a shingle, the whole sequence). Documents of one
set are a class, and go on as their smallest doc_id, the class's representative. Steps:

1. BANDS * ROWS minima of hashes a * x + b modulo 2**64; the minima of a band are one band key, 16 bits of each minimum
   make the signature.
2. In every bucket of representatives with the same band key, each is paired with the bucket's smallest (a star, so a
   bucket gives no more pairs than it has members). Pairs whose signatures agree in CONFIRM of the places are confirmed
   on the full sets, and so is every member of a class with its representative. Confirmed links make components.
3. A bucket's smallest member may be a stranger to the rest, so every two members of a bucket that are still in different
   components have their signatures compared, large buckets in blocks of bounded size. Only members that agree enough
   with one of another component go on. Of these each task first proposes no more pairs than would join its components,
   the most alike first; those that the sets confirm shrink the number of components.
4. Then the members that are still so are brought together with their texts, block by block, and compared on their sets
   until the block's components are joined or told apart. So every two documents of a common bucket that agree enough
   are linked, connected by links, or told apart by their sets.
5. Large-star and small-star steps over all links give the components.

Two documents at 0.8 share no band with probability (1 - 0.8 ** 6) ** 40 < 6e-6, and their signatures agree in less than
CONFIRM of the places with a much smaller one. Shingles are compared by 64-bit hashes of whole words in order.

Null and empty texts, and texts of white space alone, have an empty set: no link, a component of their own. Rows with a
null doc_id are kept, without component. Rows that share a doc_id are one node with the links of all. Repeated rows
give repeated results; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, WordHasher, bytes_and_bounds, mix, ngram_hashes, slices, word_spans
from .components import components

BANDS, ROWS = 40, 6
#: Share of a signature's places that must agree for a pair to be confirmed on its sets.
CONFIRM = 0.65
#: Bounds of a chunk of a bucket, in members and in bytes of their sets; one longer text may exceed the latter.
CHUNK_ROWS, CHUNK_BYTES = 1024, 4 << 20
#: Pairs whose signatures are compared in one step, and bytes of text whose sets a step holds.
STEP_PAIRS, STEP_BYTES = 1 << 14, 8 << 20
SIGNATURE = BANDS * ROWS

_rng = np.random.Generator(np.random.PCG64(20))
_A = _rng.integers(0, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SIGNATURE, dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int, hasher: WordHasher) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, bounds = bytes_and_bounds(texts)
    starts, ends, rows = word_spans(data, bounds)
    words = hasher.hashes(data, starts, ends)
    out = []
    for a, b in zip(rows[:-1], rows[1:]):
        w = words[a:b]
        out.append(np.unique(ngram_hashes(w, min(size, len(w)), size)) if len(w) else np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """All minima, a row for each set; zeros for empty sets."""
    out = np.zeros((len(sets), SIGNATURE), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        whole = np.concatenate([sets[i] for i in full])
        at = np.r_[0, np.cumsum([len(sets[i]) for i in full])[:-1]]
        for k in range(SIGNATURE):
            out[full, k] = np.minimum.reduceat(whole * _A[k] + _B[k], at)
    return out


def signatures(least: np.ndarray) -> np.ndarray:
    """Middle bits of the minima, whose high bits are mostly zero."""
    return (least >> np.uint64(16)).astype(np.uint16)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, whose last six bits are the band's number."""
    parts = least.reshape(len(least), BANDS, ROWS)
    h = np.zeros(parts.shape[:2], np.uint64)
    for r in range(ROWS):
        h = mix(h + parts[:, :, r] + np.uint64(1))
    return (h & ~np.uint64(63) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, h1 and h2 (of the set), n (its size), signature and band keys of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(3, lower=True)
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), size, hasher)
            h = np.array([[s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            least = minima(sets)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(least).ravel()), BANDS).cast(pa.list_(pa.int64()))
            columns = [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in signatures(least)], pa.binary()), keys]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "h1", "h2", "n", "signature", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, n long, signature binary, keys array<long>")


def _signed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SIGNATURE)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _agreeing(pairs: DataFrame) -> DataFrame:
    """u and v of the pairs whose signatures us and vs agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                close = np.count_nonzero(_signed(batch.column("us")) == _signed(batch.column("vs")), axis=1) >= CONFIRM * SIGNATURE
                yield batch.select(["u", "v"]).filter(pa.array(close))

    kind = pairs.schema["u"].dataType.simpleString()
    return pairs.select("u", "v", "us", "vs").mapInArrow(run, f"u {kind}, v {kind}")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs u and v, each with its other columns, that are similar by their full sets."""
    more = [c for c in pairs.columns if c not in ("u", "v")]
    first = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("ut"))
    second = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("vt"))
    both = pairs.join(first, "u").join(second, "v").select("u", "v", *more, "ut", "vt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(3, lower=True)
        for batch in slices(batches, "ut"):
            for part in slices([batch], "vt"):
                where = pc.dictionary_encode(part.column("vt"))  # a hub's text is looked at once
                right = shingle_sets(where.dictionary, size, hasher)
                left = shingle_sets(part.column("ut"), size, hasher)
                linked = [_similar(a, right[b], percent) for a, b in zip(left, where.indices.to_pylist())]
                yield part.select(["u", "v", *more]).filter(pa.array(linked))

    kept = pairs.select("u", "v", *more).schema
    return both.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept))


def _pairs_of_runs(key: np.ndarray, chunk: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places a < b of one run of equal keys, STEP_PAIRS or little more at a time; of different chunks where a run has two."""
    starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
    ends = np.r_[starts[1:], len(key)]
    crossed = np.minimum.reduceat(chunk, starts) != np.maximum.reduceat(chunk, starts)
    run = np.repeat(np.arange(len(starts)), ends - starts)
    later = ends[run] - np.arange(len(key)) - 1
    total, a = np.r_[0, np.cumsum(later)], 0
    while a < len(key):
        b = max(a + 1, int(np.searchsorted(total, total[a] + STEP_PAIRS, "right")) - 1)
        n = later[a:b]
        left = np.repeat(np.arange(a, b), n)
        right = left + 1 + np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        ok = ~crossed[run[left]] | (chunk[left] != chunk[right])
        yield left[ok], right[ok]
        a = b


BLOCK = ["key", "low", "high"]


def _blocks(placed: DataFrame, signed: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, once for each block in which they meet others.

    placed: key, rep, n and component of all members of buckets but the smallest, which is compared already; signed: rep
    and signature. Gives BLOCK, chunk, rep, component and signature."""
    weight = F.sum(F.col("n") * 8)
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("rows"), weight.alias("bytes"))
    totals = sizes.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.max(F.struct("rows", "bytes", "component")).alias("most"), F.count("*").alias("several"))
    # members of the largest component need not meet each other: they have the last chunks
    chunks = lambda rows, size: F.ceil(F.greatest(rows / CHUNK_ROWS, size / CHUNK_BYTES)).cast("int")
    some = chunks(F.col("rows") - F.col("most.rows"), F.col("bytes") - F.col("most.bytes")).alias("some")
    large = chunks(F.col("most.rows"), F.col("most.bytes")).alias("large")
    mixed = totals.where("several > 1").select("key", F.col("most.component").alias("largest"), some, large)
    salt, of_largest = F.xxhash64("rep"), F.col("component") == F.col("largest")
    chunk = F.when(of_largest, F.col("some") + F.pmod(salt, F.col("large"))).otherwise(F.pmod(salt, F.col("some"))).cast("int")
    last = F.when(of_largest, F.col("some")).otherwise(F.col("some") + F.col("large")) - 1
    met = placed.join(mixed, "key").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    met = met.where(F.col("chunk") != F.col("other")).join(signed, "rep")
    # a chunk's inner pairs are compared where it meets its neighbour
    inner = F.abs(F.col("chunk") - F.col("other")) == 1
    low, high = F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")
    return met.select("key", low, high, F.when(inner, 0).otherwise(F.col("chunk")).alias("chunk"), "rep", "component", "signature")


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition(*BLOCK).sortWithinPartitions(*BLOCK)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole blocks, many at a time, and the number of each row's block; rows come sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        ids = [rows.column(c).to_numpy() for c in BLOCK]
        number = np.r_[0, np.cumsum(np.any([c[1:] != c[:-1] for c in ids], axis=0))]
        whole = int(np.searchsorted(number, number[-1]))  # the last block may go on in the next batch
        if whole:
            yield rows.slice(0, whole), number[:whole]
        held = rows.slice(whole).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, np.zeros(rows.num_rows, np.int64)


class _Roots(dict):
    """Which components one task has joined."""

    def find(self, f):
        while (up := self.get(f, f)) != f:
            self[f] = self.get(up, up)
            f = up
        return f

    def join(self, f, g) -> bool:
        f, g = self.find(f), self.find(g)
        if f != g:
            self[f] = g
        return f != g


def _close_pairs(rows: pa.Table, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different components that agree enough, the most alike of a step first; a pair counts in the
    first band that it has in common."""
    signature, band = _signed(rows.column("signature")), rows.column("key").to_numpy() & 63
    component = np.unique(rows.column("component").to_numpy(zero_copy_only=False), return_inverse=True)[1]
    for a, b in _pairs_of_runs(number, rows.column("chunk").to_numpy()):
        apart = component[a] != component[b]
        a, b = a[apart], b[apart]
        same = signature[a] == signature[b]
        agree = np.count_nonzero(same, axis=1)
        close = np.nonzero(agree >= CONFIRM * SIGNATURE)[0]
        close = close[np.argmax(same[close].reshape(-1, BANDS, ROWS).all(axis=2), axis=1) == band[a[close]]]
        order = close[np.argsort(-agree[close], kind="stable")]
        yield a[order], b[order]


def _doubtful(blocks: DataFrame) -> DataFrame:
    """The rows of blocks that agree enough with one of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, number in _whole_blocks(batches):
            seen = np.zeros(rows.num_rows, bool)
            for a, b in _close_pairs(rows, number):
                seen[a] = seen[b] = True
            yield from rows.filter(pa.array(seen)).to_batches()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema)
    return _dealt(blocks).mapInArrow(run, fields)


def _proposed(doubtful: DataFrame) -> DataFrame:
    """u and v of pairs that would join the components of a block; a task gives fewer than it has components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = _Roots()
        for rows, number in _whole_blocks(batches):
            names, reps, out = rows.column("component").to_pylist(), rows.column("rep").to_pylist(), ([], [])
            for a, b in _close_pairs(rows, number):
                for i, j in zip(a.tolist(), b.tolist()):
                    if roots.join(names[i], names[j]):
                        out[0].append(reps[i])
                        out[1].append(reps[j])
            yield pa.RecordBatch.from_arrays([pa.array(v, rows.schema.field("rep").type) for v in out], ["u", "v"])

    kind = doubtful.schema["rep"].dataType.simpleString()
    return _dealt(doubtful).mapInArrow(run, f"u {kind}, v {kind}")


def _settled(doubtful: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links u and v found among doubtful members by their full sets, fewer in a task than it has components."""
    beside = doubtful.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select(*doubtful.columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, roots = WordHasher(3, lower=True), _Roots()
        for rows, number in _whole_blocks(batches):
            sizes = np.asarray(pc.binary_length(rows.column("text")), np.int64)
            group = np.maximum.reduceat(np.cumsum(sizes) // STEP_BYTES, np.nonzero(np.r_[True, number[1:] != number[:-1]])[0])[number - number[0]]
            for g in np.unique(group):
                at = np.nonzero(group == g)[0]
                part = rows.slice(at[0], len(at))
                # hashing takes many times a text's bytes, so it goes by smaller slices than the sets are held in
                sets = [x for piece in slices(part.select(["text"]).to_batches()) for x in shingle_sets(piece.column("text"), size, hasher)]
                names, reps, out = part.column("component").to_pylist(), part.column("rep").to_pylist(), ([], [])
                for a, b in _close_pairs(part, number[at]):
                    for i, j in zip(a.tolist(), b.tolist()):
                        if roots.find(names[i]) != roots.find(names[j]) and _similar(sets[i], sets[j], percent):
                            roots.join(names[i], names[j])
                            out[0].append(reps[i])
                            out[1].append(reps[j])
                yield pa.RecordBatch.from_arrays([pa.array(v, part.schema.field("rep").type) for v in out], ["u", "v"])

    kind = doubtful.schema["rep"].dataType.simpleString()
    return _dealt(beside).mapInArrow(run, f"u {kind}, v {kind}")


def _grown(parts: DataFrame | None, links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """node and component after further links; a component's own links hang on its name."""
    links = links.select("u", "v")
    if parts is not None:
        links = links.unionByName(parts.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return components(links.withColumn("g", F.lit("all")), tables, name).drop("g")


def _linked(texts: DataFrame, tables: Tables, size: int, percent: int) -> DataFrame:
    """doc_id, n and component (null: its own) of the documents in texts (doc_id, text)."""
    sketches = tables.write(sketch(texts, size), "sketches")
    real = sketches.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    texts = texts.where("doc_id IS NOT NULL")
    classes = tables.write(real.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    of_class = real.select("doc_id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    own = real.join(classes.withColumnRenamed("rep", "doc_id"), ["h1", "h2", "n", "doc_id"], "left_semi")
    known = tables.write(own.select(F.col("doc_id").alias("rep"), "n", "signature", "keys").distinct(), "representatives")
    signed, bands = known.select("rep", "signature"), known.select("rep", "n", F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot != last").select("key", "pivot")
    # what is joined with a skewed side is written first: between two plain exchanges Spark can split a hot key's rows
    placed = tables.write(bands.join(tables.write(buckets, "buckets"), "key").where("rep != pivot"), "placed")
    stars = tables.write(placed.select(F.col("rep").alias("u"), F.col("pivot").alias("v")).distinct(), "stars")
    us, vs = (signed.select(F.col("rep").alias(k), F.col("signature").alias(f"{k}s")) for k in "uv")
    close = _agreeing(stars.join(us, "u").join(vs, "v")).select("u", "v", F.lit(False).alias("copy"))
    close = tables.write(close.unionByName(of_class.withColumn("copy", F.lit(True))), "close")
    checked = tables.write(_confirmed(close, texts, size, percent), "checked")
    parts = _grown(None, checked.where("NOT copy"), tables, "starred")

    def with_component(rows: DataFrame) -> DataFrame:
        return rows.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    blocks = _blocks(tables.write(with_component(placed).select("key", "rep", "n", "component"), "joined"), signed)
    doubtful = tables.write(_doubtful(blocks), "doubtful")
    proposed = tables.write(_proposed(doubtful).distinct(), "proposed")
    if not proposed.isEmpty():
        found = tables.write(_confirmed(proposed, texts, size, percent), "bridges")
        if not found.isEmpty():
            parts = _grown(parts, found, tables, "bridged")
            again = with_component(doubtful.drop("component")).select(doubtful.columns)
            doubtful = tables.write(_doubtful(again), "still-doubtful")
        found = tables.write(_settled(doubtful, texts, size, percent), "settled")
        if not found.isEmpty():
            parts = _grown(parts, found, tables, "grown")
    # copies hang on their representative, which is one join further, not a node of the steps
    copies = checked.where("copy").select(F.col("u").alias("copy"), F.col("v").alias("node"))
    of_copies = copies.join(parts, "node", "left").select(F.col("copy").alias("node"), F.coalesce("component", "node").alias("component"))
    reached = parts.select("node", "component").unionByName(of_copies).groupBy(F.col("node").alias("doc_id")).agg(F.min("component").alias("component"))
    return sketches.groupBy("doc_id").agg(F.max("n").alias("n")).join(reached, "doc_id", "left")


def link(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs' rows with n_shingles, component_id and kept added (names it replaces if taken).

    size: words of a shingle; percent: the least similarity of a link.
    """
    names, tables = docs.columns, Tables(docs.sparkSession, "minhash")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc, body = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index(text)}")
    told = tables.write(_linked(plain.select(doc.alias("doc_id"), body.alias("text")), tables, size, percent), "told")
    out = plain.join(told, doc.eqNullSafe(F.col("doc_id")), "left")
    component = F.coalesce("component", "doc_id")
    new = {"n_shingles": F.coalesce("n", F.lit(0)).cast("long"), "component_id": component, "kept": F.coalesce(component == doc, F.lit(True))}
    old = [i for i, c in enumerate(names) if c not in new]
    return out.select(*[f"c{i}" for i in old], *[v.alias(f"new_{k}") for k, v in new.items()]).toDF(*[names[i] for i in old], *new)


def one_of_each(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their component."""
    names, tables = docs.columns, Tables(docs.sparkSession, "minhash")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc, body = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index(text)}")
    told = _linked(plain.select(doc.alias("doc_id"), body.alias("text")), tables, size, percent)
    others = tables.write(told.where("component < doc_id").select(F.col("doc_id").alias("other")), "others")
    return plain.join(others, doc == F.col("other"), "left_anti").toDF(*names)
