"""Sinks: scenes as Parquet and PLY text, coloured labels, comparison tables, manifests, resumable appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The twenty-colour palette in which labels are drawn, as red, green and blue in 0 to 1.
PALETTE = [
    (0.122, 0.467, 0.706), (0.682, 0.780, 0.910), (1.000, 0.498, 0.055), (1.000, 0.733, 0.471), (0.173, 0.627, 0.173),
    (0.596, 0.875, 0.541), (0.839, 0.153, 0.157), (1.000, 0.596, 0.588), (0.580, 0.404, 0.741), (0.773, 0.690, 0.835),
    (0.549, 0.337, 0.294), (0.769, 0.612, 0.580), (0.890, 0.467, 0.761), (0.969, 0.714, 0.824), (0.498, 0.498, 0.498),
    (0.780, 0.780, 0.780), (0.737, 0.741, 0.133), (0.859, 0.859, 0.553), (0.090, 0.745, 0.812), (0.620, 0.855, 0.898),
]
GREY = (0.1, 0.1, 0.1)


def scenes(points: DataFrame, path: str) -> None:
    """One folder for each scene, sorted by id within files."""
    points.repartition("scene_id", F.pmod(F.xxhash64("point_id"), F.lit(16))).sortWithinPartitions("point_id").write.partitionBy("scene_id").parquet(path)


def coloured(points: DataFrame, label: str) -> DataFrame:
    """Colours by label modulo the palette; null labels are grey."""
    table = F.array(*[F.array(*[F.lit(v) for v in c]) for c in PALETTE])
    colour = F.get(table, F.pmod(F.col(label), F.lit(len(PALETTE))).cast("int"))
    return points.withColumns({c: F.when(F.col(label).isNull(), GREY[k]).otherwise(F.get(colour, F.lit(k))) for k, c in enumerate("rgb")})


def ply_text(points: DataFrame) -> DataFrame:
    """The vertex lines of a PLY by scene, x y z red green blue with colours in 0 to 255, and the header's count."""
    colour = [F.round(F.col(c) * 255).cast("int").cast("string") for c in "rgb"]
    lines = points.select("scene_id", "point_id", F.concat_ws(" ", *[F.format_number(c, 6) for c in "xyz"], *colour).alias("line"))
    return lines.join(points.groupBy("scene_id").agg(F.count("*").alias("vertices")), "scene_id")


def ply_files(points: DataFrame, path: str, rows: int = 10_000) -> None:
    """ASCII PLY files under a path, of about `rows` points of one scene each, with colours, semantic and instance."""
    chunks = points.groupBy("scene_id").agg(F.ceil(F.count("*") / rows).cast("int").alias("_chunks"))
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"], *[F.round(F.col(c) * 255).cast("int").cast("string") for c in "rgb"], F.col("sem").cast("string"), F.col("inst").cast("string"))
    placed = points.join(chunks, "scene_id").select("scene_id", F.pmod(F.xxhash64("point_id"), F.col("_chunks")).alias("_chunk"), line.alias("line"))
    files = placed.groupBy("scene_id", "_chunk").agg(F.collect_list("line").alias("lines"))
    fields = [*(f"property double {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")), "property int semantic", "property int instance"]
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.size("lines").cast("string"), F.lit("\n" + "\n".join(fields) + "\nend_header\n"))
    files.select(F.concat(head, F.array_join("lines", "\n"))).write.option("maxRecordsPerFile", 1).text(path)


def evaluation(rows: DataFrame, folder: str, config: str, split: str, clustered: bool = True) -> str:
    """Writes evaluation rows as JSON under a name made of the configuration's stem, the skipped clustering and the split."""
    stem = config.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    path = f"{folder}/{stem}{'' if clustered else '_nocluster'}_{split}.json"
    rows.write.mode("overwrite").json(path)
    return path


def training_rows(points: DataFrame, background: int = -100) -> DataFrame:
    """Rows as networks are trained on: coordinates from the scene's mean and colours in -1 to 1 as floats, class and
    instance, the latter `background` where there is none."""
    mean = points.groupBy("scene_id").agg(*[F.avg(c).alias(f"_{c}") for c in "xyz"])
    moved = [(F.col(c) - F.col(f"_{c}")).cast("float").alias(c) for c in "xyz"]
    inst = F.when(F.col("inst") > 0, F.col("inst")).otherwise(background).cast("long").alias("inst")
    return points.join(mean, "scene_id").select("scene_id", "point_id", *moved, *[(F.col(c) * 2 - 1).cast("float").alias(c) for c in "rgb"], F.col("sem").cast("long").alias("sem"), inst)


def canonical(points: DataFrame) -> DataFrame:
    """Converted scenes: x y z r g b sem inst, instances numbered from 1 in each scene, background -1."""
    from pointloom.operators.labels import renumbered

    known = renumbered(points.withColumn("inst", F.when(F.col("inst") > 0, F.col("inst"))), "inst", 1)
    return known.select("scene_id", "point_id", *"xyz", *"rgb", F.col("sem").cast("int").alias("sem"), F.coalesce("inst", F.lit(-1)).cast("long").alias("inst"))


def obj_text(points: DataFrame) -> DataFrame:
    return points.select("scene_id", "point_id", F.concat_ws(" ", F.lit("v"), *[F.col(c).cast("string") for c in "xyz"], *[F.col(c).cast("string") for c in "rgb"]).alias("line"))


def instance_ids(points: DataFrame, label: str, cls: str) -> DataFrame:
    """class * 1000 + instance for each point, 0 where there is no instance."""
    return points.select("scene_id", "point_id", F.when(F.col(label) > 0, F.col(cls) * 1000 + F.col(label)).otherwise(0).alias("id"))


def rounded_records(plants: DataFrame, digits: int = 2) -> DataFrame:
    """Plant records as they are written to JSON and CSV."""
    return plants.withColumns({f.name: F.round(f.name, digits) for f in plants.schema.fields if f.dataType.simpleString() == "double"})


def comparison(*tables: DataFrame) -> DataFrame:
    """All rows with the union of columns, in the order in which columns first appear."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def manifest(spark, folder: str) -> DataFrame:
    """path, size and SHA-256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def not_yet_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of work whose keys are not among those done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def repeated(rows: DataFrame, times: int | Column) -> DataFrame:
    """Every row `times` times, numbered."""
    last = (times if isinstance(times, Column) else F.lit(times)) - 1
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), last)))
