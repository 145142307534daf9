"""Media columns: texts stored as lossless 8-bit media, and any stored bytes sniffed, validated, corrected and carved.

Sniffing: an Aho-Corasick automaton over the magic bytes finds every place where a format may begin, and the marks at
which formats end; the format's validator then reads the structure from there and returns where it ends. A hit at byte 0
gives the type, whatever the declared one was; valid hits further in are embedded media and can be carved. What lies
inside an embedded medium is not listed: read the carved bytes again for it. Nothing begins inside compressed data.

Validators read no more than WORK bytes for each byte of content in all, so that contents made of hits take linear time;
hits that are left over are counted in `unchecked`, which is 0 unless a content is built to that end.

Null or empty content has no media: the type is null, there are no samples and nothing is carved. Content that no
validator accepts keeps type null and its declared type. Equal contents give equal rows; other columns pass through.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_and_bounds, slices

ROW = 192
#: Bytes that validators may read for each byte of content, and besides.
WORK, WORK_BASE = 64, 1 << 20

#: Magic bytes of the formats.
MAGIC = {
    "image/png": b"\x89PNG\r\n\x1a\n",
    "image/bmp": b"BM",
    "image/x-portable-graymap": b"P5\n",
    "audio/wav": b"RIFF",
    "image/gif": b"GIF8",
    "image/jpeg": b"\xff\xd8\xff",
    "application/zip": b"PK\x03\x04",
    "application/pdf": b"%PDF-",
    "application/gzip": b"\x1f\x8b\x08",
    "audio/flac": b"fLaC",
    "application/ogg": b"OggS",
}
#: Marks near the end of formats that tell no length.
ENDS = (b"\xff\xd9", b"PK\x05\x06", b"%%EOF", b"startxref")
#: Bits a sample for each colour type of a PNG, and samples a pixel.
PNG_BITS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class Spent(Exception):
    """The content's share of work is used up."""


class Content:
    """Bytes, the places of end marks in them, and the work that is left."""

    def __init__(self, b: bytes):
        self.b, self.left = b, WORK * len(b) + WORK_BASE
        self.marks: dict[bytes, list[int]] = defaultdict(list)
        self.zero = (0, -1)  # from which place on the next zero byte is known, and that byte

    def spend(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise Spent

    def after(self, mark: bytes, at: int) -> int:
        """The next place of an end mark, or -1."""
        places = self.marks[mark]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def next_zero(self, at: int) -> int:
        if not self.zero[0] <= at <= self.zero[1]:
            found = self.b.find(b"\0", at)
            self.zero = (at, found if found >= 0 else len(self.b))
        return self.zero[1]


def _png(c: Content, at: int) -> int:
    b, p = c.b, at + 33
    if p > len(b) or struct.unpack_from(">I4s", b, at + 8) != (13, b"IHDR"):
        return 0
    width, height, bits, colour, packing, filters, laced = struct.unpack_from(">IIBBBBB", b, at + 16)
    if not width or not height or bits not in PNG_BITS.get(colour, ()) or packing or filters or laced > 1:
        return 0
    if struct.unpack_from(">I", b, at + 29)[0] != zlib.crc32(b[at + 12 : at + 29]):
        return 0
    pieces, whole = [], memoryview(b)
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + size > len(b):
            return 0
        c.spend(size + 12)
        if struct.unpack_from(">I", b, p + 8 + size)[0] != zlib.crc32(whole[p + 4 : p + 8 + size]):
            return 0
        if kind == b"IDAT":
            pieces.append(whole[p + 8 : p + 8 + size])
        p += 12 + size
        if kind == b"IEND":
            plain = None if laced else height * (1 + (width * bits * PNG_SAMPLES[colour] + 7) // 8)
            return p if _inflates(c, pieces, plain) else 0
    return 0


def _inflates(c: Content, pieces: list, size: int | None) -> bool:
    """Whether the pieces are one whole stream, and of `size` bytes where that is told."""
    d, total = zlib.decompressobj(), 0
    try:
        for piece in pieces:
            while len(piece) and not d.eof:
                got = d.decompress(piece, 1 << 16)
                total += len(got)
                c.spend(len(got) >> 4)
                if size is not None and total > size:
                    return False
                piece = d.unconsumed_tail
    except zlib.error:
        return False
    return d.eof and bool(total) and (size is None or total == size)


def _bmp(c: Content, at: int) -> int:
    b = c.b
    if at + 54 > len(b):
        return 0
    size, zero, offset, head = struct.unpack_from("<IIII", b, at + 2)
    if zero or head not in (40, 108, 124) or offset < 14 + head or at + size > len(b):
        return 0
    width, height, planes, bits, packing = struct.unpack_from("<iiHHI", b, at + 18)
    row = (abs(width) * bits + 31) // 32 * 4
    fits = planes == 1 and bits in (1, 4, 8, 24, 32) and packing == 0 and width > 0 and height and offset + row * abs(height) == size
    return at + size if fits else 0


def _pgm(c: Content, at: int) -> int:
    b, end = c.b, at
    for _ in range(3):
        end = b.find(b"\n", end, at + 64) + 1
        if not end:
            return 0
    parts = b[at:end].split()
    if len(parts) != 4 or not all(x.isdigit() for x in parts[1:]) or parts[3] != b"255":
        return 0
    size = int(parts[1]) * int(parts[2])
    return end + size if size and end + size <= len(b) else 0


def _wav(c: Content, at: int) -> int:
    b = c.b
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end, p, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    if end > len(b):
        return 0
    while p + 8 <= end:
        c.spend(8)
        kind, size = struct.unpack_from("<4sI", b, p)
        if p + 8 + size > end or (kind == b"fmt " and size < 16):
            return 0
        seen.add(kind if kind in (b"fmt ", b"data") else b"")
        p += 8 + size + size % 2
    return end if {b"fmt ", b"data"} <= seen and p >= end else 0


def _gif(c: Content, at: int) -> int:
    b = c.b
    if b[at + 3 : at + 6] not in (b"87a", b"89a") or at + 13 > len(b):
        return 0
    flags, p = b[at + 10], at + 13
    p += 3 << (flags & 7) + 1 if flags & 128 else 0
    while p < len(b):
        mark = b[p]
        if mark == 0x3B:
            return p + 1
        if mark == 0x21:
            p += 2
        elif mark == 0x2C and p + 10 < len(b):
            flags = b[p + 9]
            p += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        else:
            return 0
        while p < len(b) and b[p]:
            c.spend(8)
            p += 1 + b[p]
        p += 1
    return 0


def _jpeg(c: Content, at: int) -> int:
    b, p = c.b, at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        c.spend(8)
        if b[p + 1] == 0xFF:  # a fill byte
            p += 1
            continue
        kind, size = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if kind == 0xDA:
            return c.after(b"\xff\xd9", p + 2 + size) + 2 if c.after(b"\xff\xd9", p + 2 + size) >= 0 else 0
        if kind == 0 or 0xD0 <= kind <= 0xD9 or size < 2:
            return 0
        p += 2 + size
    return 0


def _zip(c: Content, at: int) -> int:
    """Up to the first end record whose directory lies where it says; records before it are of archives stored inside."""
    b, ends = c.b, c.marks[b"PK\x05\x06"]
    for end in ends[bisect_left(ends, at) :]:
        c.spend(22)
        if end + 22 > len(b):
            return 0
        size, start, comment = struct.unpack_from("<IIH", b, end + 12)
        whole = at + start + size == end and (b[at + start : at + start + 4] == b"PK\x01\x02")
        if whole and end + 22 + comment <= len(b):
            return end + 22 + comment
    return 0


def _pdf(c: Content, at: int) -> int:
    """Up to the last end mark before the next file: later ones are of updates."""
    stop, ends = c.after(b"%PDF-", at + 1), c.marks[b"%%EOF"]
    k = (bisect_left(ends, stop) if stop >= 0 else len(ends)) - 1
    return ends[k] + 5 if k >= 0 and at < c.after(b"startxref", at) < ends[k] else 0


def _gzip_head(c: Content, at: int) -> int:
    """Where the compressed data of a member begin, or 0."""
    b, p = c.b, at + 10
    if p > len(b) or b[at + 3] & 0xE0:
        return 0
    flags = b[at + 3]
    if flags & 4:
        if p + 2 > len(b):
            return 0
        p += 2 + struct.unpack_from("<H", b, p)[0]
    for flag in (8, 16):
        if flags & flag:
            p = c.next_zero(p) + 1
    p += flags & 2
    return p if p < len(b) else 0


def _gzip(c: Content, at: int) -> int:
    """All members that follow each other."""
    b, end = memoryview(c.b), 0
    while c.b[at : at + 3] == MAGIC["application/gzip"] and (p := _gzip_head(c, at)):
        d, crc, total, step = zlib.decompressobj(-15), 0, 0, 64
        try:
            while not d.eof and p < len(b):
                piece = b[p : p + step]
                c.spend(len(piece))
                p, step = p + len(piece), min(2 * step, 1 << 16)
                while len(piece) and not d.eof:
                    got = d.decompress(piece, 1 << 16)
                    c.spend(len(got) >> 4)
                    crc, total, piece = zlib.crc32(got, crc), total + len(got), d.unconsumed_tail
        except zlib.error:
            break
        p -= len(d.unused_data)
        if not d.eof or p + 8 > len(b) or struct.unpack_from("<II", b, p) != (crc, total & 0xFFFFFFFF):
            break
        at = end = p + 8
    return end


def _flac(c: Content, at: int) -> int:
    """-1, an unknown end, where the blocks before the sound are sound: frames tell no length."""
    b, p = c.b, at + 4
    while p + 4 <= len(b):
        c.spend(8)
        head = struct.unpack_from(">I", b, p)[0]
        last, kind, size = head >> 31, head >> 24 & 127, head & 0xFFFFFF
        if (p == at + 4 and (kind, size) != (0, 34)) or p + 4 + size > len(b):
            return 0
        p += 4 + size
        if last:
            return -1 if p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xFC == 0xF8 else 0
    return 0


def _ogg(c: Content, at: int) -> int:
    b, p = c.b, at
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b) and b[p + 4] == 0:
        c.spend(256)
        n, flags = b[p + 26], b[p + 5]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + 27 + n > len(b) or end > len(b):
            return 0
        p = end
        if flags & 4:
            return p
    return 0


VALIDATORS: dict[str, Callable[[Content, int], int]] = {
    "image/png": _png, "image/bmp": _bmp, "image/x-portable-graymap": _pgm, "audio/wav": _wav, "image/gif": _gif, "image/jpeg": _jpeg,
    "application/zip": _zip, "application/pdf": _pdf, "application/gzip": _gzip, "audio/flac": _flac, "application/ogg": _ogg,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, magic in [*MAGIC.items(), *((None, mark) for mark in ENDS)]:
        found.add_word(magic.decode("latin-1"), (kind, magic))
    found.make_automaton()
    return found


def sniff(content: bytes, search: ahocorasick.Automaton) -> tuple[str | None, int | None, list[tuple[str, int, int | None]], int]:
    """Type and length (None: unknown) of what begins at byte 0, (type, start, length) of media embedded in it or after
    it, and the number of hits that were left unchecked."""
    c, hits = Content(content), []
    for last, (name, magic) in search.iter(content.decode("latin-1")):
        at = last - len(magic) + 1
        if name is None or name == "application/pdf":
            c.marks[magic].append(at)
        if name:
            hits.append((at, name))
    kind, size, inside, free, unchecked = None, None, [], 0, 0
    for at, name in hits:
        if at < free:
            continue
        try:
            end = VALIDATORS[name](c, at)
        except Spent:
            unchecked += 1
            continue
        if not end:
            continue
        length = end - at if end > 0 else None
        if at == 0:
            kind, size = name, length
        else:
            inside.append((name, at, length))
        if at or name in ("image/png", "application/gzip"):
            free = end if end > 0 else len(content)
    return kind, size, inside, unchecked


# --- storing payloads -----------------------------------------------------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def as_png(p: bytes) -> bytes:
    rows = np.zeros((len(p) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(p, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return MAGIC["image/png"] + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def as_bmp(p: bytes) -> bytes:
    """24-bit rows of 64 pixels, top row first."""
    head = struct.pack("<IiiHHIIiiII", 40, ROW // 3, -(len(p) // ROW), 1, 24, 0, len(p), 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(p), 0, 0, 54) + head + p


def as_pgm(p: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(p) // ROW) + p


def as_wav(p: bytes) -> bytes:
    """Mono, 8,000 unsigned 8-bit samples a second."""
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(p)) + p
    return b"RIFF" + struct.pack("<I", len(body)) + body


STORED = (as_png, as_bmp, as_pgm, as_wav)


def _chunks(b: bytes, at: int, end: int, big: bool) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size, kind = (struct.unpack_from(">I4s", b, at) if big else struct.unpack_from("<4sI", b, at)[::-1])
        yield kind, at + 8, size
        at += 8 + size + (4 if big else size % 2)


def samples(kind: str | None, b: bytes) -> bytes | None:
    """The 8-bit samples of a structure that its validator accepted: PNG of grey bytes in rows without filter, BMP of 24 bits
    (rows from the top down), PGM, and PCM WAV of 8 bits; None for all others."""
    if kind == "image/png":
        width, height, bits, colour, _, _, laced = struct.unpack_from(">IIBBBBB", b, 16)
        if (bits, colour, laced) != (8, 0, 0):
            return None
        packed = b"".join(b[p : p + n] for x, p, n in _chunks(b, 8, len(b), True) if x == b"IDAT")
        rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
        return None if rows[:, 0].any() else rows[:, 1:].tobytes()
    if kind == "image/bmp":
        size, offset, width, height, bits = *struct.unpack_from("<I4xI", b, 2), *struct.unpack_from("<iixxH", b, 18)
        if bits != 24:
            return None
        rows = np.frombuffer(b[offset:size], np.uint8).reshape(abs(height), -1)[:, : 3 * width]
        return (rows if height < 0 else rows[::-1]).tobytes()
    if kind == "image/x-portable-graymap":
        return b.split(b"\n", 3)[3]
    if kind == "audio/wav":
        found = {k: b[p : p + n] for k, p, n in _chunks(b, 12, len(b), False)}
        form, _, _, _, _, bits = struct.unpack_from("<HHIIHH", found[b"fmt "])
        return found[b"data"] if (form, bits) == (1, 8) else None
    return None


def feature(payload: bytes | None) -> str | None:
    """Counts of the samples below 64, 128 and 192 and of the rest, their sum, and the sum of steps between neighbours."""
    if payload is None:
        return None
    v = np.frombuffer(payload, np.uint8)
    steps = int(np.abs(np.diff(v.astype(np.int16))).sum()) if len(v) else 0
    return ",".join(map(str, [*np.bincount(v >> 6, minlength=4).tolist(), int(v.sum(dtype=np.int64)), steps]))


def store(docs: DataFrame, text: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """doc_id, n_bytes, declared and content: the text (null: empty) as UTF-8, padded with spaces to a positive multiple of
    192, as a PNG, BMP, PGM or WAV; the format follows the payload's CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, bounds = bytes_and_bounds(part.column("text"))
            rows = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                raw = data[a:b].tobytes()
                raw = raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b" ")
                rows.append(STORED[zlib.crc32(raw) % len(STORED)](raw))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(rows, pa.binary())], ["doc_id", "n_bytes", "content"])

    made = docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, content binary")
    return made.select("doc_id", "n_bytes", F.lit(declared).alias("declared"), "content")


#: Columns that `read` adds.
FOUND = "media_type string, media_length long, samples binary, feature string, embedded array<struct<type:string,start:long,length:long,bytes:binary>>, unchecked long"


def read(media: DataFrame, content: str = "content", carve: bool = True, declared: str = "declared") -> DataFrame:
    """All columns of media, and: media_type (sniffed), media_length (of the structure; null if unknown), samples, feature
    (of the samples), embedded (type, start, length and, with carve, bytes of media inside) and unchecked; where media
    has the declared column also corrected_type (sniffed, else declared) and was_wrong (declared, but not as sniffed)."""
    names = media.columns
    plain, place = media.toDF(*[f"c{i}" for i in range(len(names))]), names.index(content)
    item = pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton()
        for part in slices(batches, f"c{place}"):
            rows = []
            for b in part.column(place).to_pylist():
                kind, size, inside, unchecked = sniff(b := b or b"", search)
                found = samples(kind, b[:size])
                inner = [{"type": k, "start": s, "length": n, "bytes": b[s : None if n is None else s + n] if carve else None} for k, s, n in inside]
                rows.append((kind, size, found, feature(found), inner, unchecked))
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.string(), pa.list_(item), pa.int64())
            columns = [pa.array(v, k) for v, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "media_type", "media_length", "samples", "feature", "embedded", "unchecked"])

    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(media.schema.fields))
    made = plain.mapInArrow(run, f"{fields}, {FOUND}")
    own = ["media_type", "media_length", "samples", "feature", "embedded", "unchecked"]
    if declared in names:
        told = F.col(f"c{names.index(declared)}")
        made = made.withColumns({"corrected_type": F.coalesce("media_type", told), "was_wrong": F.coalesce(F.col("media_type") != told, F.lit(False))})
        own += ["corrected_type", "was_wrong"]
    old = [i for i, c in enumerate(names) if c not in own]
    return made.select(*[f"c{i}" for i in old], *own).toDF(*[names[i] for i in old], *own)
