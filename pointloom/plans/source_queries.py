"""Queries of sources and sinks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.lineage import shared_folder
from pointloom.sources import ranges, readers, sinks, writers
from pointloom.streaming import scenes
from pointloom.views import view

from .point_queries import rounded
from .registry import query


def _scenes(spark, d):
    return view(spark, d, "points").select("scene_id", "point_id", *"xyz", *"rgb", F.col("sem_gt").alias("sem"), F.col("gt_inst").alias("inst"))


def _text(spark, d, name, *columns):
    """Rows of points, written as lines to the shared folder."""
    folder = shared_folder(spark, name)
    _scenes(spark, d).select(F.concat_ws(" ", *[c.cast("string") for c in columns]).alias("line")).write.text(folder)
    return folder


_SUMS = "count(*) AS n, round(sum(x), 4) AS x, round(sum(y), 4) AS y, round(sum(z), 4) AS z"


def _sums(df, *keys):
    return rounded(df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "xyz"]), 4, *"xyz")


@query("src1_discovered_files", "SELECT scene_id % 2 AS parity, count(*) AS n FROM points GROUP BY ALL")
def src1(spark, d):
    """Files of two folders, found and read again; as many points as were written."""
    folder = shared_folder(spark, "discover")
    for parity in (0, 1):
        _scenes(spark, d).where(F.col("scene_id") % 2 == parity).select(F.concat_ws(" ", *"xyz").alias("line")).write.text(f"{folder}/parity={parity}")
    files = readers.discover(spark, folder, ("txt",)).select(F.regexp_extract("path", r"parity=(\d)", 1).cast("long").alias("parity")).distinct()
    lines = spark.read.option("basePath", folder).text(folder).groupBy(F.col("parity").cast("long").alias("parity")).agg(F.count("*").alias("n"))
    return lines.join(files, "parity", "left_semi")


@query("src2_cloud_files", f"SELECT sem_gt AS sem, gt_inst AS inst, {_SUMS} FROM points GROUP BY ALL")
def src2(spark, d):
    """Scenes written as PLY files and read again (SRC2, SRC4, SRC5, SRC6)."""
    folder = shared_folder(spark, "ply")
    writers.ply_files(_scenes(spark, d), folder)
    return _sums(readers.clouds(spark, folder, r"\.txt$"), "sem", "inst")


_SCENE = r"/scene=([^/]+)/"


def _read_again(spark, d, columns, spans=1 << 16, **forms):
    """Scenes (their columns, with the names to write) in files of each form, read again by small ranges."""
    folder = shared_folder(spark, "clouds")
    for form, scenes_of in forms.items():
        points = _scenes(spark, d).where(scenes_of).select("scene_id", "point_id", *[F.col(c).alias(n) for c, n in columns.items()])
        sinks.cloud_files(spark, points, folder, form, rows=20_000)
    read = ranges.clouds(spark, folder, r"\.ply$", tuple(columns), _SCENE, spans)
    return read.withColumn("scene_id", F.col("scene_id").cast("long"))


@query("src4_ascii_ply", f"SELECT CAST(scene_id AS BIGINT) AS scene_id, CASE WHEN gt_inst = 0 THEN 0 ELSE sem_gt END AS sem, CASE WHEN gt_inst = 0 THEN -1 ELSE gt_inst END AS inst, {_SUMS}, round(sum(r), 4) AS r FROM points GROUP BY 1, 2, 3")
def src4(spark, d):
    """PLY as text with class and instance, both NaN for points of no instance."""
    folder = shared_folder(spark, "clouds")
    known = [F.when(F.col("inst") > 0, F.col(c)).otherwise(float("nan")).cast("double").alias(n) for c, n in (("sem", "semantic"), ("inst", "instance"))]
    sinks.cloud_files(spark, _scenes(spark, d).select("scene_id", "point_id", *"xyz", *"rgb", *known), folder, "ply_ascii", rows=20_000)
    read = ranges.clouds(spark, folder, r"\.ply$", scene=_SCENE, span=1 << 16).withColumn("scene_id", F.col("scene_id").cast("long"))
    out = read.groupBy("scene_id", "sem", "inst").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "xyzr"])
    return rounded(out, 4, *"xyzr")


@query("src5_binary_ply", f"SELECT CAST(scene_id AS BIGINT) AS scene_id, gt_inst AS inst, {_SUMS} FROM points GROUP BY ALL")
def src5(spark, d):
    """Binary PLY of both byte orders, instances under `plant_ids`; no other column is decoded."""
    even = F.col("scene_id") % 2 == 0
    columns = {**{c: c for c in "xyz"}, "inst": "plant_ids"}
    return _sums(_read_again(spark, d, columns, ply_little=even, ply_big=~even), "scene_id", "inst")


@query("src6_named_ply", f"SELECT CAST(scene_id AS BIGINT) AS scene_id, sem_gt AS sem, {_SUMS}, round(max(b), 4) AS b FROM points GROUP BY 1, 2")
def src6(spark, d):
    """Text and binary PLY whose property names are only alike."""
    even = F.col("scene_id") % 2 == 0
    columns = {**{c: c for c in "xyz"}, "r": "diffuse_red", "g": "diffuse_green", "b": "diffuse_blue", "sem": "scalar_sf_class"}
    read = _read_again(spark, d, columns, ply_ascii=even, ply_little=~even)
    out = read.groupBy("scene_id", "sem").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "xyz"], F.max("b").alias("b"))
    return rounded(out, 4, *"xyzb")


@query("src3_ground_truth_text", f"SELECT sem_gt AS sem, gt_inst AS inst, {_SUMS} FROM points GROUP BY ALL")
def src3(spark, d):
    columns = [F.col(c) for c in "xyz"] + [F.col(c) * 255 for c in "rgb"] + [F.col("sem"), F.when(F.col("inst") > 0, F.col("inst")).otherwise(-1)]
    return _sums(readers.ground_truth(spark, _text(spark, d, "gt", *columns)), "sem", "inst")


@query("src8_plot_text", "SELECT CAST(gt_inst > 0 AS INT) AS sem, count(*) AS n, count(DISTINCT gt_inst) AS labels FROM points GROUP BY ALL")
def src8(spark, d):
    """Eight columns whose class is made two-valued, kept as Parquet after the first read."""
    path = _text(spark, d, "plots", *[F.col(c) for c in "xyz"], *[F.col(c) for c in "rgb"], F.col("inst"), F.col("inst"))
    kept = shared_folder(spark, "plots-parquet")
    readers.ground_truth(spark, path, binarize=True).write.parquet(kept)
    return spark.read.parquet(kept).groupBy("sem").agg(F.count("*").alias("n"), F.count_distinct("inst").alias("labels"))


@query("src10_split_manifest", "SELECT CASE WHEN scene_id < 3 THEN 'train' WHEN scene_id = 3 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM points GROUP BY ALL")
def src10(spark, d):
    folder = shared_folder(spark, "splits")
    names = view(spark, d, "points").select("scene_id").distinct().withColumn("split", F.when(F.col("scene_id") < 3, "train").when(F.col("scene_id") == 3, "val").otherwise("test"))
    listed = [F.array_sort(F.collect_list(F.when(F.col("split") == s, F.col("scene_id").cast("string")))).alias(s) for s in ("train", "val", "test")]
    names.agg(*listed).write.json(folder)
    splits = readers.split_scenes(spark, folder)
    points = view(spark, d, "points").withColumn("scene_id", F.col("scene_id").cast("string"))
    return points.join(splits, "scene_id").groupBy("split").agg(F.count("*").alias("n"))


@query("src11_organ_text", f"SELECT sem_gt AS sem, {_SUMS} FROM points GROUP BY ALL")
def src11(spark, d):
    path = _text(spark, d, "organs", *[F.col(c) * 1000 for c in "xyz"], F.col("sem"), F.col("inst"))
    return _sums(readers.organ_text(spark, path), "sem")


@query("src12_training_log", "SELECT o_orderkey AS epoch, o_totalprice AS train_loss, CAST(o_custkey AS DOUBLE) AS val_loss FROM orders")
def src12(spark, d):
    folder = shared_folder(spark, "log")
    o = spark.read.parquet(f"{d}/orders.parquet")
    line = F.concat(F.lit("[Epoch "), F.col("o_orderkey"), F.lit("] train loss: "), F.col("o_totalprice"), F.lit(" | val loss: "), F.col("o_custkey"))
    o.select(F.array(line, F.lit("saved checkpoint")).alias("a")).select(F.explode("a").alias("line")).write.text(folder)
    return readers.training_log(spark, folder)


@query("src13_labelled_ascii", f"SELECT CAST(gt_inst <> 0 AS INT) AS sem, {_SUMS} FROM points GROUP BY ALL")
def src13(spark, d):
    return _sums(readers.labelled_ascii(spark, _text(spark, d, "ascii", *[F.col(c) for c in "xyz"], F.col("inst"))), "sem")


@query("snk4_evaluation_json", "SELECT scene_id, count(*) AS n FROM points GROUP BY ALL")
def snk4(spark, d):
    rows = view(spark, d, "points").groupBy("scene_id").agg(F.count("*").alias("n"))
    return spark.read.json(writers.evaluation(rows, shared_folder(spark, "evaluation"), "configs/default.yaml", "test", clustered=False)).select("scene_id", "n")


@query("snk8_converted_scenes", """
SELECT scene_id, CASE WHEN gt_inst > 0 THEN dense_rank() OVER (PARTITION BY scene_id, gt_inst > 0 ORDER BY gt_inst) ELSE -1 END AS inst, n FROM (SELECT scene_id, gt_inst, count(*) AS n FROM points GROUP BY ALL)""")
def snk8(spark, d):
    return writers.canonical(_scenes(spark, d)).groupBy("scene_id", "inst").agg(F.count("*").alias("n"))


@query("snk8_training_rows", "SELECT CASE WHEN gt_inst > 0 THEN gt_inst ELSE -100 END AS inst, count(*) AS n, min(sem_gt) AS least, max(sem_gt) AS most FROM points GROUP BY ALL")
def snk8b(spark, d):
    kept = shared_folder(spark, "training")
    writers.training_rows(_scenes(spark, d)).write.parquet(kept)
    return spark.read.parquet(kept).groupBy("inst").agg(F.count("*").alias("n"), F.min("sem").alias("least"), F.max("sem").alias("most"))


@query("src7_labels_from_palette", """
WITH p(label, pr, pg, pb) AS (VALUES (0, 0.0, 0.0, 0.2), (1, 0.05, 0.1, 0.6), (2, 0.08, 0.02, 0.9)),
c AS (SELECT DISTINCT r, g, b FROM points), d AS (SELECT c.*, label, (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) AS d FROM c, p),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY r, g, b ORDER BY d, label) = 1)
SELECT CASE WHEN (p.r - 0.1) * (p.r - 0.1) + (p.g - 0.1) * (p.g - 0.1) + (p.b - 0.1) * (p.b - 0.1) <= d THEN NULL ELSE label END AS label, count(*) AS n FROM points p JOIN n ON p.r = n.r AND p.g = n.g AND p.b = n.b GROUP BY 1""")
def src7(spark, d):
    palette = spark.sql("SELECT * FROM VALUES (0, 0.0D, 0.0D, 0.2D), (1, 0.05D, 0.1D, 0.6D), (2, 0.08D, 0.02D, 0.9D) AS t(label, pr, pg, pb)")
    return readers.from_palette(view(spark, d, "points"), palette).groupBy("label").agg(F.count("*").alias("n"))


@query("src9_repeated_training_rows", "SELECT scene_id, CAST(k.k AS INT) AS repeat, count(*) AS n FROM points, range(0, 4) k(k) GROUP BY ALL")
def src9(spark, d):
    return writers.repeated(view(spark, d, "points"), 4).groupBy("scene_id", "repeat").agg(F.count("*").alias("n"))


@query("src14_labels_of_colours", "SELECT scene_id, CAST(dense_rank() OVER (PARTITION BY scene_id ORDER BY r, g, b) - 1 AS INT) AS label, n FROM (SELECT scene_id, r, g, b, count(*) AS n FROM points GROUP BY ALL)")
def src14(spark, d):
    return readers.labels_of_colours(view(spark, d, "points")).groupBy("scene_id", "label").agg(F.count("*").alias("n"))


@query("snk2_coloured_labels", "SELECT scene_id, pred_inst % 20 AS label, count(*) AS n, CASE WHEN pred_inst = 0 THEN CAST(0.1 AS DOUBLE) END AS grey FROM points GROUP BY ALL")
def snk2(spark, d):
    p = view(spark, d, "points").withColumn("label", F.when(F.col("pred_inst") > 0, F.col("pred_inst")))
    out = writers.coloured(p, "label").withColumn("grey", F.when(F.col("label").isNull(), F.col("r")))
    return out.groupBy("scene_id", (F.col("pred_inst") % 20).alias("label"), "grey").agg(F.count("*").alias("n"))


@query("snk3_plant_records", "SELECT scene_id, gt_inst, round(avg(x), 2) AS x, round(max(z), 2) AS z FROM points GROUP BY ALL")
def snk3(spark, d):
    return writers.rounded_records(view(spark, d, "points").groupBy("scene_id", "gt_inst").agg(F.avg("x").alias("x"), F.max("z").alias("z")))


@query("snk5_comparison_columns", "SELECT model, avg_metric, n FROM (SELECT model, round(avg(metric), 4) AS avg_metric, NULL :: BIGINT AS n FROM results GROUP BY ALL UNION ALL SELECT model, NULL, count(*) FROM results GROUP BY ALL)")
def snk5(spark, d):
    r = view(spark, d, "results")
    return writers.comparison(r.groupBy("model").agg(F.round(F.avg("metric"), 4).alias("avg_metric")), r.groupBy("model").agg(F.count("*").alias("n")))


@query("snk6_instance_ids", "SELECT scene_id, CASE WHEN pred_inst > 0 THEN sem_pred * 1000 + pred_inst ELSE 0 END AS id, count(*) AS n FROM points GROUP BY ALL")
def snk6(spark, d):
    return writers.instance_ids(view(spark, d, "points"), "pred_inst", "sem_pred").groupBy("scene_id", "id").agg(F.count("*").alias("n"))


@query("snk6_obj_lines")
def snk6b(spark, d):
    return writers.obj_text(view(spark, d, "points")).groupBy("scene_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("snk6_obj_files", "SELECT CAST(scene_id AS BIGINT) AS scene_id, count(*) AS vertices, round(sum(x), 4) AS x, round(sum(b), 4) AS b FROM points GROUP BY 1")
def snk6c(spark, d):
    """OBJ files, written by tasks that commit, and the numbers on their lines."""
    folder = shared_folder(spark, "obj")
    sinks.cloud_files(spark, _scenes(spark, d).select("scene_id", "point_id", *"xyz", *"rgb"), folder, "obj", rows=20_000)
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select(F.regexp_extract(F.col("_metadata.file_path"), _SCENE, 1).cast("long").alias("scene_id"), F.split("value", " ").alias("v"))
    out = lines.where("v[0] = 'v'").groupBy("scene_id").agg(F.count("*").alias("vertices"), F.sum(F.col("v")[1].cast("double")).alias("x"), F.sum(F.col("v")[6].cast("double")).alias("b"))
    return rounded(out, 4, "x", "b")


@query("snk1_ply_lines", "SELECT scene_id, count(*) AS lines, count(*) AS vertices FROM points GROUP BY ALL")
def snk1(spark, d):
    return writers.ply_text(writers.coloured(view(spark, d, "points"), "pred_inst")).groupBy("scene_id").agg(F.count("*").alias("lines"), F.max("vertices").alias("vertices"))


@query("snk7_text_digests", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS length FROM documents")
def snk7(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("length"))


_DONE = ["model", "clustering", "scene_id", "plant_id"]


@query("snk9_resume", f"""
SELECT {", ".join(_DONE)}, count(*) AS n FROM results r WHERE NOT EXISTS (SELECT 1 FROM results d WHERE d.metric > 495 AND {" AND ".join(f"d.{k} = r.{k}" for k in _DONE)}) GROUP BY ALL""")
def snk9(spark, d):
    r = view(spark, d, "results")
    return writers.not_yet_done(r, r.where("metric > 495"), _DONE).groupBy(*_DONE).agg(F.count("*").alias("n"))


@query("str1_windowed_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def str1(spark, d):
    return scenes.windowed_counts(spark.read.parquet(f"{d}/events.parquet"), "ts", ["event_type"])
