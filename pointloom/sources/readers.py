"""Point-cloud files as tables: text, PLY, PCD and NPY scenes, splits, logs.

Text formats are read by Spark's text source and parsed by columns; binary ones are read whole by the binary-file source
and decoded in batches, a file at a time, so that any file system that Spark reads will do.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.lineage import cut

POINT_SCHEMA = "scene_id string, point_id long, x double, y double, z double, r double, g double, b double, sem int, inst long"
_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}


def scene_of(path: str | Column) -> Column:
    """The file's stem."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(c, r"([^/]*?)(?:_gt)?(?:\.[^./]*)?$", 1)


def discover(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("ply", "txt", "npy", "pcd")) -> DataFrame:
    """path and length of the scene files under a folder, ground truth left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.where(F.col("path").rlike(rf"\.({'|'.join(suffixes)})$") & ~F.col("path").contains("_gt"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """scene_id, line and point_id, the line's number in its file from 0, whatever the cuts of the file.

    A cut's rows have consecutive numbers, so that its first number and the rows of the cuts before it give the place."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.trim("value").alias("line"), F.monotonically_increasing_id().alias("_m"))
    text = cut(text)
    blocks = text.groupBy("_file", "_block").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    placed = text.join(blocks.withColumn("_before", F.coalesce(before, F.lit(0))), ["_file", "_block"])
    return placed.select(scene_of(F.col("_file")).alias("scene_id"), "line", (F.col("_before") + F.col("_m") - F.col("_first")).alias("point_id"))


def ground_truth(spark: SparkSession, path: str, label: int = -2, instance: int = -1, binarize: bool = False) -> DataFrame:
    """Points of whitespace-separated text: coordinates first, class and instance by place (negative from the end);
    negative instances become 0; lines that are no numbers are left out."""
    parts = _lines(spark, path).where(F.col("line").rlike(r"^[-+.\d]")).withColumn("v", F.split("line", r"\s+")).where(F.size("v") >= 5)
    at = lambda k: F.try_element_at("v", F.lit(k + 1 if k >= 0 else k)).try_cast("double")
    sem = at(label).cast("int")
    return parts.select(
        "scene_id", "point_id", *[at(k).alias(c) for k, c in enumerate("xyz")],
        (F.when(sem > 0, 1).otherwise(0) if binarize else sem).alias("sem"), F.greatest(at(instance).cast("long"), F.lit(0)).alias("inst"),
    ).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def labelled_ascii(spark: SparkSession, path: str) -> DataFrame:
    """Points x y z ... label: comments, headers and malformed rows are dropped, any label but 0 is 1."""
    parts = _lines(spark, path).where(~F.col("line").rlike("^(#|//)")).withColumn("v", F.transform(F.split("line", r"[\s,;]+"), lambda s: s.try_cast("double")))
    good = parts.where((F.size("v") >= 4) & ~F.exists("v", lambda x: x.isNull()))
    return good.select("scene_id", "point_id", *[F.get("v", F.lit(k)).alias(c) for k, c in enumerate("xyz")], (F.try_element_at("v", F.lit(-1)) != 0).cast("int").alias("sem"))


def organ_text(spark: SparkSession, path: str) -> DataFrame:
    """x y z in millimetres, class, and an instance if there is one; metres here."""
    v = _lines(spark, path).withColumn("v", F.transform(F.split("line", r"\s+"), lambda s: s.try_cast("double"))).where(F.size("v") >= 4)
    return v.select("scene_id", "point_id", *[(F.get("v", F.lit(k)) / 1000).alias(c) for k, c in enumerate("xyz")], F.get("v", F.lit(3)).cast("int").alias("sem"), F.get("v", F.lit(4)).cast("long").alias("inst"))


def parse_ply(content: bytes) -> pd.DataFrame:
    """The vertex table of an ASCII or binary PLY, by the names that its header declares."""
    end = content.index(b"end_header")
    end = content.index(b"\n", end) + 1
    header = content[:end].decode("ascii", "replace").splitlines()
    form = next(line.split()[1] for line in header if line.startswith("format"))
    count, fields, inside = 0, [], False
    for line in header:
        word = line.split()
        if word[:1] == ["element"]:
            inside = word[1] == "vertex"
            count = int(word[2]) if inside else count
        elif word[:1] == ["property"] and inside:
            fields.append((word[-1], _TYPES[word[1]]))
    if form == "ascii":
        rows = np.loadtxt(io.BytesIO(content[end:]), max_rows=count, ndmin=2) if count else np.zeros((0, len(fields)))
        return pd.DataFrame({n: rows[:, i] for i, (n, _) in enumerate(fields)})
    order = ">" if "big" in form else "<"
    table = np.frombuffer(content, np.dtype([(n, order + t) for n, t in fields]), count, end)
    return pd.DataFrame({n: table[n].astype(float) for n, _ in fields})


def _named(table: pd.DataFrame, *patterns: str) -> np.ndarray | None:
    for p in patterns:
        for n in table.columns:
            if re.search(p, n, re.I):
                return table[n].to_numpy(float)
    return None


def parse_pcd(content: bytes) -> pd.DataFrame:
    """The points of an ASCII or plain binary PCD by its fields; a packed rgb field gives red, green and blue."""
    header, at = {}, 0
    while "DATA" not in header:
        end = content.index(b"\n", at)
        word = content[at:end].decode("ascii", "replace").split()
        at = end + 1
        if word and not word[0].startswith("#"):
            header[word[0]] = word[1:]
    names, count = header["FIELDS"], int(header["POINTS"][0])
    kinds = ["<" + {"F": "f", "I": "i", "U": "u"}[t] + n for t, n in zip(header["TYPE"], header["SIZE"])]
    if header["DATA"] == ["ascii"]:
        rows = np.loadtxt(io.BytesIO(content[at:]), max_rows=count, ndmin=2) if count else np.zeros((0, len(names)))
        columns = {n: rows[:, i].astype(k) for i, (n, k) in enumerate(zip(names, kinds))}
    elif header["DATA"] == ["binary"]:
        table = np.frombuffer(content, np.dtype(list(zip(names, kinds))), count, at)
        columns = {n: table[n] for n in names}
    else:
        raise ValueError(f"PCD data of kind {header['DATA']} can't be read")
    if "rgb" in columns:
        packed = np.ascontiguousarray(columns.pop("rgb")).view("<u4")
        columns |= {c: packed >> shift & 255 for c, shift in (("red", 16), ("green", 8), ("blue", 0))}
    return pd.DataFrame({n: v.astype(float) for n, v in columns.items()})


def parse_cloud(path: str, content: bytes) -> pd.DataFrame:
    """Coordinates, colours in 0 to 1, class and instance of a PLY, PCD or NPY file, told apart by how it begins; NaN labels
    become 0 and -1. A file of another kind raises, an empty one has no points."""
    if not content:
        return pd.DataFrame({c: pd.Series(dtype=k) for c, k in zip(["x", "y", "z", "r", "g", "b", "sem", "inst"], [*["float64"] * 6, "int32", "int64"])})
    if content.startswith(b"\x93NUMPY"):
        a = np.load(io.BytesIO(content), allow_pickle=False)
        names = ["x", "y", "z", "red", "green", "blue", "semantic", "instance"][: a.shape[1]]
        table = pd.DataFrame({n: a[:, i] for i, n in enumerate(names)})
    elif content.startswith(b"ply"):
        table = parse_ply(content)
    elif content.startswith((b"# .PCD", b"VERSION")):
        table = parse_pcd(content)
    else:
        raise ValueError(f"{path} is no PLY, PCD or NPY file")
    out = pd.DataFrame({c: table[c].to_numpy(float) for c in "xyz"})
    colours = [_named(table, f"^{c}$", f"^(diffuse_)?{c}") for c in ("red", "green", "blue")]
    scale = 255.0 if colours[0] is not None and len(table) and max(np.nanmax(c) for c in colours if c is not None) > 1.1 else 1.0
    for c, v in zip("rgb", colours):
        out[c] = v / scale if v is not None else 0.0
    sem, inst = _named(table, "semantic", "^label$", "scalar_sf"), _named(table, "instance", "plant_ids?")
    out["sem"] = np.nan_to_num(sem, nan=0).astype(np.int32) if sem is not None else np.int32(0)
    out["inst"] = np.nan_to_num(inst, nan=-1).astype(np.int64) if inst is not None else np.int64(-1)
    return out


def clouds(spark: SparkSession, folder: str, names: str = r"\.(ply|pcd|npy)$") -> DataFrame:
    """The points of all PLY, PCD and NPY files under a folder whose paths match; a missing folder raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("path").rlike(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, scene, content in zip(batch["path"], batch["scene_id"], batch["content"]):
                out = parse_cloud(path, bytes(content))
                out.insert(0, "scene_id", scene)
                out.insert(1, "point_id", np.arange(len(out)))
                yield out

    return files.select("path", scene_of("path").alias("scene_id"), "content").mapInPandas(run, POINT_SCHEMA)


def from_palette(points: DataFrame, palette: DataFrame, grey: tuple[float, float, float] = (0.1, 0.1, 0.1)) -> DataFrame:
    """Labels from colours: the nearest palette row (label, pr, pg, pb); grey is noise. The palette is a few rows."""
    gap = lambda c: sum(((F.col(a) - b) * (F.col(a) - b) for a, b in zip("rgb", c)), F.lit(0.0))
    colours = points.select(*"rgb").distinct()  # far fewer than points
    best = colours.join(palette).groupBy(*"rgb").agg(F.min(F.struct(gap([F.col("pr"), F.col("pg"), F.col("pb")]).alias("d"), "label")).alias("_best"))
    label = F.when(gap([F.lit(v) for v in grey]) <= F.col("_best.d"), None).otherwise(F.col("_best.label"))
    return points.join(best.select(*"rgb", label.alias("label")), list("rgb"), "left")


def labels_of_colours(points: DataFrame) -> DataFrame:
    """Sequential labels from the distinct colours of each scene."""
    from pyspark.sql import Window as W

    colours = points.select("scene_id", *"rgb").distinct().withColumn("label", F.dense_rank().over(W.partitionBy("scene_id").orderBy(*"rgb")) - 1)
    return points.join(colours, ["scene_id", *"rgb"])


def split_scenes(spark: SparkSession, path: str) -> DataFrame:
    """split and scene_id of a JSON manifest with one list of scenes for each split."""
    raw = spark.read.json(path, multiLine=True)
    names = [f.name for f in raw.schema.fields if f.dataType.simpleString() == "array<string>"]
    parts = [raw.select(F.lit(n).alias("split"), F.explode(n).alias("scene_id")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_split(points: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    return points.join(splits.where(F.col("split") == split), "scene_id", "left_semi")


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """epoch, train_loss and val_loss of the lines that tell them."""
    number = r"([-+.\deE]+)"
    take = lambda p: F.regexp_extract("value", p, 1).try_cast("double")
    out = spark.read.text(path).select(take(rf"[Ee]poch\D*{number}").cast("int").alias("epoch"), take(rf"train\D*loss\D*?{number}").alias("train_loss"), take(rf"val\D*loss\D*?{number}").alias("val_loss"))
    return out.where("epoch IS NOT NULL")
