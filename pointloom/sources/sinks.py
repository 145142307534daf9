"""Writing cloud files by tasks that commit or abort: format "pointloom_cloud" of df.write.

A task writes whole files into a folder of its own run beside the target; the job's commit moves the files of the tasks that
succeeded, and its abort removes the folder, so that neither a failed task nor one run twice leaves a file behind."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .ranges import file_system

#: Types of PLY properties by Spark's.
_PLY = {"double": ("double", "f8"), "float": ("float", "f4"), "int": ("int", "i4"), "smallint": ("short", "i2"), "tinyint": ("char", "i1"), "bigint": ("double", "f8")}


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: their place in the run's folder and below the target."""

    files: list[tuple[str, str]]


def encode(table: pa.Table, schema: StructType, form: str) -> bytes:
    """A file of the rows: binary PLY (little or big endian), PLY as text, or the vertex lines of an OBJ."""
    columns = {f.name: table[f.name].to_numpy() for f in schema.fields}
    if form == "obj":
        texts = [[repr(float(v)) for v in columns[c]] for c in ("x", "y", "z", "r", "g", "b") if c in columns]
        return "".join(f"v {' '.join(row)}\n" for row in zip(*texts)).encode()
    kinds = {f.name: _PLY[f.dataType.simpleString()] for f in schema.fields}
    if any(table[c].null_count for c, k in kinds.items() if k[1][0] == "i"):
        raise ValueError("integer properties of a PLY can't be null")
    words = {"ply_ascii": "ascii", "ply_little": "binary_little_endian", "ply_big": "binary_big_endian"}[form]
    names = {"r": "red", "g": "green", "b": "blue", "sem": "semantic", "inst": "instance"}
    head = ["ply", f"format {words} 1.0", f"element vertex {table.num_rows}", *(f"property {k} {names.get(c, c)}" for c, (k, _) in kinds.items()), "end_header", ""]
    if form == "ply_ascii":
        texts = [[repr(float(v)) if k[1][0] == "f" else str(v) for v in columns[c].tolist()] for c, k in kinds.items()]
        return "\n".join([*head[:-1], *(" ".join(row) for row in zip(*texts)), ""]).encode()
    order = "<" if form == "ply_little" else ">"
    out = np.empty(table.num_rows, np.dtype([(c, order + k[1]) for c, k in kinds.items()]))
    for c in kinds:
        out[c] = columns[c]
    return "\n".join(head).encode() + out.tobytes()


class CloudWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.target, self.form = options["path"].rstrip("/"), options.get("form", "ply_little")
        self.rows, self.overwrite = int(options.get("rows", 1_000_000)), overwrite
        self.schema = StructType([f for f in schema.fields if f.name != "scene_id"])
        self.staging = f"{self.target}/_unfinished-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Files of at most `rows` points of one scene each; the rows of a scene should come together."""
        system, staging = file_system(self.staging)
        system.create_dir(staging, recursive=True)
        suffix, files, held, scene = "obj" if self.form == "obj" else "ply", [], [], None

        def flush() -> None:
            if held:
                name = f"{uuid.uuid4().hex}.{suffix}"
                with system.open_output_stream(f"{staging}/{name}") as f:
                    f.write(encode(pa.Table.from_batches(held), self.schema, self.form))
                files.append((name, f"scene={quote(str(scene), safe='')}/{name}"))
                held.clear()

        for batch in iterator:
            ids = batch.column("scene_id").to_pylist()
            at = 0
            while at < len(ids):
                room = self.rows - sum(b.num_rows for b in held)
                if ids[at] != scene or room <= 0:
                    flush()
                    scene, room = ids[at], self.rows
                end = at
                while end < len(ids) and end - at < room and ids[end] == scene:
                    end += 1
                held.append(batch.slice(at, end - at).select([f.name for f in self.schema.fields]))
                at = end
        flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, target = file_system(self.target)
        staging = file_system(self.staging)[1]
        system.create_dir(target, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(target)):
                if old.path.rstrip("/").rsplit("/", 1)[-1].startswith("scene="):
                    system.delete_dir(old.path)
        moves = [f for m in messages if m for f in m.files]
        for folder in {place.split("/")[0] for _, place in moves}:
            system.create_dir(f"{target}/{folder}", recursive=True)
        for name, place in moves:
            system.move(f"{staging}/{name}", f"{target}/{place}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, staging = file_system(self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class CloudSink(DataSource):
    """Options: path, form (ply_little, ply_big, ply_ascii, obj), rows (of a file, at most). Mode append or overwrite."""

    @classmethod
    def name(cls) -> str:
        return "pointloom_cloud"

    def writer(self, schema: StructType, overwrite: bool) -> CloudWriter:
        return CloudWriter(dict(self.options), schema, overwrite)


def cloud_files(spark: SparkSession, points: DataFrame, path: str, form: str = "ply_little", rows: int = 1_000_000, mode: str = "append") -> None:
    """Files of points, below a folder for each scene: all columns but scene_id are properties (point_id, where there is
    one, only orders the rows), and a large scene is written by many tasks, a file each or more. Long integers are written
    as doubles, as PLY has none; nulls become NaN, and raise in integer columns."""
    key = F.pmod(F.xxhash64("point_id"), F.lit(64)) if "point_id" in points.columns else F.pmod(F.xxhash64(*points.columns), F.lit(64))
    order = ["scene_id", "point_id"] if "point_id" in points.columns else ["scene_id"]
    kept = points.repartition("scene_id", key).sortWithinPartitions(*order).drop("point_id")
    spark.dataSource.register(CloudSink)
    kept.write.format(CloudSink.name()).option("form", form).option("rows", rows).mode(mode).save(path)
