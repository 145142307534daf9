"""Byte-pair encoding, decoding and token counts with public vocabularies.

A short word is held as one array of part boundaries beside one array of the ranks of adjacent parts: the smallest
rank is found by scanning, its boundary deleted and the ranks beside it refreshed. Words of more than LONG symbols
take the same merges from a heap, as repeated scans grow with the square of the length. Merged words are remembered
by each Python worker, up to a bound.

Null texts count as empty and give no token; special strings inside a text become their own token.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Symbols up to which a word is merged by scanning.
LONG = 192
#: Words that a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 250_000, 64
NEVER = 1 << 60

#: Unicode white space, as Rust and Oniguruma take \s.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The word patterns of the two vocabularies. L and N are the classes of letters and numbers.
BYTE_LEVEL = "'(?:[stmd]|re|ve|ll)| ?{L}+| ?{N}+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
WORD_LEVEL = "'(?:[stmd]|re|ve|ll)|{L}+|{N}|[^{s}{l}{n}]+"
#: The letters and numbers below U+0250, for texts that hold no character beyond.
NEAR_LETTERS, NEAR_NUMBERS, BEYOND = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "[^\u0000-\u024f]"


def word_finder(pattern: str) -> Callable[[str], list[str]]:
    """Finds the words of a text; texts of near characters take explicit classes, others Unicode's."""

    def filled(letters: str, numbers: str) -> str:
        return pattern.replace("{L}", f"[{letters}]").replace("{N}", f"[{numbers}]").replace("{s}", SPACE).replace("{l}", letters).replace("{n}", numbers)

    near, wide = re.compile(filled(NEAR_LETTERS, NEAR_NUMBERS)).findall, regex.compile(filled(r"\p{L}", r"\p{N}")).findall
    beyond = re.compile(BEYOND).search
    return lambda text: near(text) if text.isascii() or not beyond(text) else wide(text)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, spare = {}, 256
    for b in range(256):
        if b in own:
            symbols[b] = chr(b)
        else:
            symbols[b], spare = chr(spare), spare + 1
    return [symbols[b] for b in range(256)]


class Merges:
    """Merge rules over ids: (left id, right id) -> rank << SHIFT | id of both, so that the least number is the next merge."""

    SHIFT = 20

    def __init__(self, vocab: dict[str, int], merges: list):
        self.vocab = vocab
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.rules = {(vocab[a], vocab[b]): rank << self.SHIFT | vocab[a + b] for rank, (a, b) in enumerate(pairs)}

    def merge(self, ids: list[int]) -> list[int]:
        return self.scanned(ids) if len(ids) <= LONG else self.heaped(ids)

    def scanned(self, ids: list[int]) -> list[int]:
        """parts[i] begins at boundary i; ranks[i] is the rank of parts i and i + 1 as a pair."""
        rank, never, to_id = self.rules.get, NEVER, (1 << self.SHIFT) - 1
        parts = ids
        ranks = [rank(pair, never) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != never:
            i = ranks.index(least)
            parts[i] = least & to_id
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), never)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), never)
        return parts

    def heaped(self, ids: list[int]) -> list[int]:
        rules, parts, n = self.rules, list(ids), len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (f := rules.get((parts[i], parts[j]))):
                heapq.heappush(heap, (f, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            f, i, a, b = heapq.heappop(heap)
            j, both = after[i], f & (1 << self.SHIFT) - 1
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = both, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p >= 0]


class Vocabulary:
    """A tokenizer file: byte-level words, or lower-cased words with an end mark on the last symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.words = word_finder(WORD_LEVEL if self.end else BYTE_LEVEL)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.merges = Merges(model["vocab"], model["merges"])
        self.strings = {i: s for s, i in [*model["vocab"].items(), *self.special.items()]}
        symbols = byte_symbols()
        self.inner = [model["vocab"][s] for s in symbols]
        self.last = [model["vocab"][s + self.end] for s in symbols]
        self.bytes_of = {s: b for b, s in enumerate(symbols)}

    def normal(self, text: str) -> str:
        if not self.end:
            return text
        text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        inner = self.inner
        return self.merges.merge([*(inner[b] for b in raw[:-1]), self.last[raw[-1]]])

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, string) from left to right."""
        if self.split is None or not (found := [*self.split.finditer(text)]):
            yield False, text
            return
        at = 0
        for m in found:
            yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        yield False, text[at:]

    def whole_tokens(self) -> list[str]:
        """Strings of the vocabulary that are one word of the pattern and provably merge to their own single token."""
        proven = []
        for s, i in self.merges.vocab.items():
            try:
                word = bytes(self.bytes_of[c] for c in s).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if self.word_ids(word) == [i]:
                proven.append(word)
        return proven


class _Remembered(dict):
    """word -> result of make; results of short words stay, as long as there are few."""

    def __init__(self, make: Callable, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.make, self.fixed = make, fixed or {}

    def __missing__(self, word: str):
        made = self.make(word)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED + len(self.fixed):
                self.clear()
                self.update(self.fixed)
            self[word] = made
        return made


_loaded: dict = {}


def _worker(key: tuple, make: Callable):
    """One object of each key in a Python worker, which serves many tasks."""
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def vocabulary(path: str) -> Vocabulary:
    return _worker(("vocabulary", path), lambda: Vocabulary(path))


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs' doc_id with n_bytes and n_tokens. The proof of whole tokens is made once, on the driver, and broadcast:
    it grows with the vocabulary only."""
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(vocabulary(path).whole_tokens())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        # the search among remembered words covers proven whole tokens first; only other words are merged
        counts = _worker(("counts", path), lambda: _Remembered(lambda w: len(v.word_ids(w)), dict.fromkeys(whole.value, 1)))
        of, words = counts.__getitem__, v.words
        for part in slices(batches):
            n = []
            for t in part.column("text").to_pylist():
                n.append(sum(1 if special else sum(map(of, words(v.normal(s)))) for special, s in v.pieces(t)) if t else 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kept = docs.select("doc_id", F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return kept.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of docs, and ids: the tokens of each text, without begin or end."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        packed = _worker(("packed", path), lambda: _Remembered(lambda w: np.array(v.word_ids(w), np.int32).tobytes()))
        special = {s: np.array([i], np.int32).tobytes() for s, i in v.special.items()}
        of, words = packed.__getitem__, v.words
        for part in slices(batches):
            rows = []
            for t in part.column("text").to_pylist():
                rows.append(b"".join(special[s] if mark else b"".join(map(of, words(v.normal(s)))) for mark, s in v.pieces(t)) if t else b"")
            bounds = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in rows], out=bounds[1:])
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(rows), np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], [*part.schema.names[:-1], "ids"])

    fields = ", ".join(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    made = plain.mapInArrow(run, f"{fields}, ids array<int>")
    return made.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names) if c != "ids"], "ids")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """doc_id, ids and decoded: the token strings as the vocabulary's decoder joins them (end-marked vocabularies have
    none: one space between tokens; byte-level ones give the bytes, replacing what is not UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        v = vocabulary(path)

        def table() -> pa.Array:
            size = max(v.strings) + 1
            if v.end:
                return pa.array([v.strings.get(i, "") for i in range(size)], pa.string())
            raw = [v.strings.get(i, "") for i in range(size)]
            return pa.array([s.encode() if s in v.special else bytes(v.bytes_of[c] for c in s) for s in raw], pa.binary())

        strings = _worker(("strings", path), table)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column("ids")
                bounds = lists.offsets
                first = bounds[0].as_py()
                tokens = strings.take(lists.values.slice(first, bounds[-1].as_py() - first))
                rows = pa.ListArray.from_arrays(pc.subtract(bounds, first), tokens)
                text = pc.binary_join(rows, " " if v.end else b"")
                if not v.end:
                    text = pa.array([b.decode("utf-8", "replace") for b in text.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, text], ["doc_id", "ids", "decoded"])

    kept = encoded.select("doc_id", F.col(ids).alias("ids"))
    return kept.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def ids_digest(ids: str | Column = "ids") -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.sha2(F.concat_ws(" ", c.cast("array<string>")), 256)
