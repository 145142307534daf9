"""Shared pieces: shared-folder tables, Arrow slicing and word hashing over whole texts.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR; null texts count as empty.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step of a vectorised kernel holds; a longer text is a step of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own where that is unset. Only a
    session whose executors run in the driver's process may have neither; others must say where they share files."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        configured = tempfile.mkdtemp(prefix="pointloom-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Tables:
    """Parquet tables of one job in the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        try:
            _drop(self.spark, f"{self.root}/{name}" if name else self.root)
        except Exception:  # noqa: BLE001  the session may already be gone at exit
            pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each piece stays near the limit."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = _lengths(batch.column(column))
        group = np.cumsum(sizes) // limit
        cuts = np.r_[0, np.nonzero(np.diff(group))[0] + 1, batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)


def bytes_and_bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the column end to end, and the n + 1 bounds of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of a byte string at once, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, seed: int = 1, lower: bool = False):
        rng = np.random.Generator(np.random.PCG64(seed))
        table = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.table = table[_LOWER] if lower else table
        self.base = int(rng.integers(0, 2**63)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("up", self.base), ("down", self.inverse)):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            setattr(self, name, np.cumprod(p))

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 bounds of the rows' words."""
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    after = np.empty_like(solid)
    if len(solid):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = solid[:-1], solid[1:]
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.nonzero(solid & ~before)[0]
    ends = np.nonzero(solid & ~after)[0] + 1
    return starts, ends, np.searchsorted(starts, bounds)


def ngram_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of the n consecutive words that begin at each place; the last n - 1 places are dropped."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    base = np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1) | 1)
    count = len(words) - n + 1
    h = np.zeros(count, np.uint64)
    for j in range(n):
        h = h * base + words[j : j + count]
    return mix(h)


def strings(values: list, kind=pa.string()) -> pa.Array:
    return pa.array(values, type=kind)
