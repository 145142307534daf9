"""Cloud files read by byte ranges, so that many tasks share one large file, and only the columns asked for are decoded.

Three steps: tasks read the heads of files and tell their ranges; tasks survey ranges (lines of text, greatest colour);
tasks decode ranges, whose first point numbers follow from the ranges before. Only the small table of ranges is shuffled.
Files are opened through pyarrow's file systems (local and shared paths, HDFS, object stores) by their URIs."""

from __future__ import annotations

import io
import json
import os
import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .readers import _TYPES, scene_of

#: Columns by the properties that may hold them, tried in turn; the value where a file has none; the Spark type.
COLUMNS = {
    "x": (("^x$",), None, "double"),
    "y": (("^y$",), None, "double"),
    "z": (("^z$",), None, "double"),
    "r": (("^red$", "^(diffuse_)?red"), 0.0, "double"),
    "g": (("^green$", "^(diffuse_)?green"), 0.0, "double"),
    "b": (("^blue$", "^(diffuse_)?blue"), 0.0, "double"),
    "sem": (("semantic", "^label$", "scalar_sf"), 0, "int"),
    "inst": (("instance", "plant_ids?"), -1, "long"),
}
_PCD_TYPES = {"F": "f", "I": "i", "U": "u"}
_RANGE = "path string, head string, start long, stop long"
#: Points that a task decodes at once.
_SLICE = 100_000


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark tells it (nothing in it escaped), and the path within."""
    head, _, rest = path.partition(":/") if ":" in path.split("/")[0] else ("file", "", os.path.abspath(path))
    inner = f"/{rest.lstrip('/')}" if head == "file" or not rest.startswith("/") else rest[1:]
    return fs.FileSystem.from_uri(f"{head}://{quote(inner, safe='/:@')}")


def open_file(path: str):
    """A file open for reading at any place."""
    system, inner = file_system(path)
    return system.open_input_file(inner)


def _header(f) -> bytes:
    """The first bytes of a file, up to the end of its header, at most 1 MB."""
    head = b""
    while len(head) < 1 << 20:
        more = f.read(4096)
        head += more
        marks = (b"end_header", b"\nDATA ") if head.startswith((b"ply", b"#", b"VERSION")) else ()
        if not more or any(b"\n" in head[head.index(m) + len(m) :] for m in marks if m in head) or (head.startswith(b"\x93NUMPY") and len(head) >= 128 and b"}" in head):
            break
    return head


def describe(path: str, head: bytes) -> dict:
    """Fields, layout (rows, columns or lines), offset and count of the points of a PLY, PCD or NPY file."""
    if head.startswith(b"\x93NUMPY"):
        f = io.BytesIO(head)
        version = np.lib.format.read_magic(f)
        shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if len(shape) != 2 or kind.names:
            raise ValueError(f"{path} is no table of points")
        names = ["x", "y", "z", "red", "green", "blue", "semantic", "instance"][: shape[1]]
        names += [f"_{k}" for k in range(len(names), shape[1])]
        return {"fields": [(n, kind.str) for n in names], "layout": "columns" if by_column else "rows", "offset": f.tell(), "count": shape[0]}
    if head.startswith(b"ply"):
        end = head.index(b"\n", head.index(b"end_header")) + 1
        words = [line.split() for line in head[:end].decode("ascii", "replace").splitlines()]
        form = next(w[1] for w in words if w[:1] == ["format"])
        order = ">" if "big" in form else "<"
        fields, element, count = [], None, 0
        for w in words:
            if w[:1] == ["element"]:
                if element is None and w[1] != "vertex":
                    raise ValueError(f"{path} does not begin with its vertices")
                element, count = w[1], int(w[2]) if w[1] == "vertex" else count
            elif w[:1] == ["property"] and element == "vertex":
                fields.append((w[-1], order + _TYPES[w[1]]))
        return {"fields": fields, "layout": "lines" if form == "ascii" else "rows", "offset": end, "count": count}
    if head.startswith((b"# .PCD", b"VERSION")):
        end = head.index(b"\n", head.index(b"\nDATA ") + 1) + 1
        words = {w[0]: w[1:] for w in (line.split() for line in head[:end].decode("ascii", "replace").splitlines()) if w and not w[0].startswith("#")}
        if words["DATA"] not in (["ascii"], ["binary"]):
            raise ValueError(f"PCD data of kind {words['DATA']} can't be read")
        fields = [(n, f"<{_PCD_TYPES[t]}{s}") for n, t, s in zip(words["FIELDS"], words["TYPE"], words["SIZE"])]
        return {"fields": fields, "layout": "lines" if words["DATA"] == ["ascii"] else "rows", "offset": end, "count": int(words["POINTS"][0])}
    raise ValueError(f"{path} is no PLY, PCD or NPY file")


def _width(head: dict) -> int:
    return sum(np.dtype(t).itemsize for _, t in head["fields"])


def _ranges_of(path: str, length: int, span: int) -> list[tuple]:
    """Ranges of about `span` bytes: of points where these have a width, of bytes of a text."""
    if not length:
        return []
    with open_file(path) as f:
        head = describe(path, _header(f))
    told = json.dumps(head)
    if head["layout"] == "lines":
        return [(path, told, a, min(a + span, length)) for a in range(head["offset"], length, span)]
    if head["offset"] + head["count"] * _width(head) > length:
        raise ValueError(f"{path} is shorter than its header tells")
    step = max(1, span // max(_width(head), 1))
    return [(path, told, a, min(a + step, head["count"])) for a in range(0, head["count"], step)]


def _lines(f, start: int, stop: int, offset: int, size: int = 1 << 22) -> Iterator[bytes]:
    """Whole lines that begin within start and stop, in pieces of about `size` bytes; the first line begins at offset."""
    at = start
    if start > offset:  # the line that runs into the range belongs to the one before
        f.seek(start - 1)
        while more := f.read(1 << 16):
            cut = more.find(b"\n")
            if cut >= 0:
                at = f.tell() - len(more) + cut + 1
                break
        else:
            return
    f.seek(at)
    rest = b""
    while at < stop:
        more = f.read(min(size, stop - at))
        if not more:
            break
        at += len(more)
        piece = rest + more
        last = piece.rfind(b"\n") + 1
        rest = piece[last:]
        if last:
            yield piece[:last]
    while rest and not rest.endswith(b"\n"):  # the last line may end beyond the range
        more = f.read(1 << 16)
        if not more:
            break
        rest += more[: more.find(b"\n") + 1 or len(more)]
    if rest:
        yield rest


def _field(head: dict, column: str) -> int | None:
    names = [n for n, _ in head["fields"]]
    return next((i for p in COLUMNS[column][0] for i, n in enumerate(names) if re.search(p, n, re.I)), None)


def _packed(head: dict) -> int | None:
    """The field of colours packed in four bytes, as PCD files have."""
    return next((i for i, (n, t) in enumerate(head["fields"]) if n == "rgb" and t.endswith("4")), None)


def _tables(head: dict, path: str, start: int, stop: int, columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns asked for, in slices, as they stand in the file; a column that the file has not is left out."""
    places = {c: _field(head, c) for c in columns}
    packed = _packed(head)
    shifts = {"r": 16, "g": 8, "b": 0} if packed is not None else {}

    def taken(get) -> dict[str, np.ndarray]:
        out = {c: get(i) for c, i in places.items() if i is not None}
        return out | {c: np.ascontiguousarray(get(packed)).view("<u4") >> s & 255 for c, s in shifts.items() if c in places and places[c] is None}

    kinds = [np.dtype(t) for _, t in head["fields"]]
    with open_file(path) as f:
        if head["layout"] == "lines":
            for piece in _lines(f, start, stop, head["offset"]):
                rows = [line.split() for line in piece.split(b"\n") if line.strip()]
                if rows:
                    words = [[r[i] if i < len(r) else b"nan" for r in rows] for i in range(len(kinds))]
                    yield {"_n": len(rows)} | taken(lambda i: np.array(words[i], float) if i != packed else np.array(words[i], float).astype(kinds[i]))
        elif head["layout"] == "columns":
            for a in range(start, stop, _SLICE):
                n = min(_SLICE, stop - a)

                def column(i: int) -> np.ndarray:
                    f.seek(head["offset"] + (i * head["count"] + a) * kinds[i].itemsize)
                    return np.frombuffer(f.read(n * kinds[i].itemsize), kinds[i])

                yield {"_n": n} | taken(column)
        else:
            row = np.dtype([(f"f{i}", k) for i, k in enumerate(kinds)])
            f.seek(head["offset"] + start * row.itemsize)
            for a in range(start, stop, _SLICE):
                n = min(_SLICE, stop - a)
                table = np.frombuffer(f.read(n * row.itemsize), row)
                yield {"_n": n} | taken(lambda i: table[f"f{i}"])


def ranges(spark: SparkSession, folder: str, names: str, span: int) -> DataFrame:
    """path, head, start and stop of all ranges of the files under a folder; heads are read by tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("path").rlike(names)).select("path", "length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"]):
                found = _ranges_of(path, length, span)
                if found:
                    yield pd.DataFrame(found, columns=["path", "head", "start", "stop"])

    return files.mapInPandas(run, _RANGE)


def clouds(spark: SparkSession, folder: str, names: str = r"\.(ply|pcd|npy)$", columns: tuple[str, ...] = tuple(COLUMNS), scene: str | None = None, span: int = 64 << 20) -> DataFrame:
    """scene_id, point_id (the place in the file) and the columns asked for of all PLY, PCD and NPY files under a folder whose
    paths match, ranges of `span` bytes each on their own.

    Colours are brought to 0 to 1 by files whose greatest is over 1.1; NaN labels become 0 and -1; a column that a file has
    not is 0 (instances -1), but for coordinates, which are null. scene: a pattern of paths whose first group is the scene
    instead of the file's stem. Empty files have no points; a missing folder, a file of another kind or one that is shorter
    than its header tells raises."""
    columns = list(columns)
    tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = ranges(spark, folder, names, span).repartition(tasks, "path", "start")
    colours = [c for c in "rgb" if c in columns]

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, told, start, stop in batch.itertuples(index=False):
                head, n, peak = json.loads(told), stop - start, float("-inf")
                if head["layout"] == "lines" or colours:
                    n = 0
                    for table in _tables(head, path, start, stop, colours):
                        n += table.pop("_n")
                        peak = max([peak, *(float(np.nanmax(v)) for v in table.values() if len(v) and not np.isnan(v).all())])
                yield pd.DataFrame({"path": [path], "head": [told], "start": [start], "stop": [stop], "n": [n], "peak": [peak]})

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of a range that holds lines of other elements after the points, the greatest colour of the points alone."""
        for batch in batches:
            for i, told, start, stop, n, first in zip(batch.index, batch["head"], batch["start"], batch["stop"], batch["n"], batch["first"]):
                head = json.loads(told)
                left = head["count"] - first
                if n > left and colours:
                    peak = float("-inf")
                    for table in _tables(head, batch.at[i, "path"], start, stop, colours) if left > 0 else ():
                        here, left = max(left, 0), left - table.pop("_n")
                        peak = max([peak, *(float(np.nanmax(v[:here])) for v in table.values() if not np.isnan(v[:here]).all())])
                    batch.at[i, "peak"] = peak
            yield batch

    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    known = spread.mapInPandas(survey, f"{_RANGE}, n long, peak double")
    known = known.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    known = known.mapInPandas(bounded, f"{_RANGE}, n long, peak double, first long")
    known = known.withColumn("peak", F.max("peak").over(W.partitionBy("path")))
    known = known.withColumn("scene_id", F.regexp_extract("path", scene, 1) if scene else scene_of("path")).select("path", "head", "start", "stop", "peak", "first", "scene_id").repartition(tasks, "path", "start")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, told, start, stop, peak, first, name in batch.itertuples(index=False):
                head, at = json.loads(told), first
                for table in _tables(head, path, start, stop, columns):
                    n = min(table["_n"], head["count"] - at)  # other elements may follow the points
                    if n <= 0:
                        break
                    out = {"scene_id": np.repeat(name, n), "point_id": np.arange(at, at + n)}
                    for c in columns:
                        none, kind = COLUMNS[c][1:]
                        v = np.asarray(table[c][:n], float) if c in table else np.full(n, np.nan if none is None else none)
                        if c in colours and peak > 1.1:
                            v = v / 255.0
                        out[c] = v if kind == "double" else np.nan_to_num(v, nan=none).astype(np.int32 if kind == "int" else np.int64)
                    yield pd.DataFrame(out)
                    at += n

    return known.mapInPandas(decode, "scene_id string, point_id long, " + ", ".join(f"{c} {COLUMNS[c][2]}" for c in columns))
