"""Queries over single point clouds: filters, samples, tiles, labels and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import filters, labels, sampling, spatial
from pointloom.views import view

from .registry import query


def rounded(df, digits: int = 6, *columns: str):
    return df.withColumns({c: F.round(c, digits) for c in (columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"])})


PLANES = "SELECT scene_id, CAST(0.1 AS DOUBLE) AS pa, CAST(-0.2 AS DOUBLE) AS pb, CAST(1.0 AS DOUBLE) AS pc, CAST(-0.05 AS DOUBLE) AS pd FROM points GROUP BY scene_id"
_UNIFORM = "((((({id} % 1000003) * 2654435761 + {s}) % 4294967296) % 1000033) * 2246822519 + (({id} % 1000003) * 2654435761 + {s}) % 4294967296) % 4294967296 / 4294967296.0"


def uniform_sql(seed: int, column: str = "point_id") -> str:
    return "(" + _UNIFORM.format(id=column, s=seed * 97) + ")"


def _planes(points):
    return points.select("scene_id").distinct().select("scene_id", F.lit(0.1).alias("pa"), F.lit(-0.2).alias("pb"), F.lit(1.0).alias("pc"), F.lit(-0.05).alias("pd"))


@query("flt1_plane_ground", f"""
SELECT p.scene_id, count(*) AS ground, round(avg(abs(pa * x + pb * y + pc * z + pd) / sqrt(pa * pa + pb * pb + pc * pc)), 6) AS mean_distance
FROM points p JOIN ({PLANES}) q ON p.scene_id = q.scene_id
WHERE abs(pa * x + pb * y + pc * z + pd) / sqrt(pa * pa + pb * pb + pc * pc) < 0.03 GROUP BY p.scene_id""")
def flt1(spark, d):
    p = view(spark, d, "points")
    near = filters.to_plane(p, _planes(p)).where("distance < 0.03")
    return rounded(near.groupBy("scene_id").agg(F.count("*").alias("ground"), F.avg("distance").alias("mean_distance")))


@query("flt2_percentile_prefilter", """
SELECT p.scene_id, point_id, z FROM points p
JOIN (SELECT scene_id, quantile_cont(z, 0.2) AS q FROM points GROUP BY scene_id) l ON p.scene_id = l.scene_id WHERE z <= q""")
def flt2(spark, d):
    return filters.below_percentile(view(spark, d, "points"), 0.2).select("scene_id", "point_id", "z")


_KNN = """
near AS (SELECT a.scene_id, a.point_id, b.point_id AS other, {d} AS distance,
  row_number() OVER (PARTITION BY a.point_id ORDER BY {d}, b.point_id) AS rank
  FROM event_points a JOIN event_points b ON a.scene_id = b.scene_id)"""
_D3 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_D2 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query("flt3_statistical_outliers", f"""
WITH {_KNN.format(d=_D3).strip()},
m AS (SELECT scene_id, point_id, avg(distance) AS m FROM near WHERE rank <= 8 GROUP BY ALL),
l AS (SELECT scene_id, avg(m) + 1.0 * stddev_samp(m) AS lim FROM m GROUP BY ALL)
SELECT m.scene_id, point_id, round(m, 6) AS mean_distance, m < lim AS keep FROM m JOIN l ON m.scene_id = l.scene_id""")
def flt3(spark, d):
    return rounded(filters.statistical_outliers(view(spark, d, "event_points"), 8, 1.0, 0.4))


@query("flt4_radius_outliers", f"""
SELECT scene_id, point_id, n AS neighbours FROM (SELECT a.scene_id, a.point_id, count(*) AS n
  FROM event_points a JOIN event_points b ON a.scene_id = b.scene_id WHERE {_D3} < 0.15 GROUP BY ALL) WHERE n > 10""")
def flt4(spark, d):
    return filters.radius_outliers(view(spark, d, "event_points"), 0.15, 10).select("scene_id", "point_id", "neighbours")


@query("flt5_post_semantic", f"""
WITH f AS (SELECT e.* FROM event_points e JOIN (SELECT scene_id, quantile_cont(z, 0.1) AS q FROM event_points GROUP BY ALL) l
  ON e.scene_id = l.scene_id WHERE e.z > q)
SELECT scene_id, count(*) AS kept FROM (SELECT a.scene_id, a.point_id, count(*) AS n
  FROM f a JOIN f b ON a.scene_id = b.scene_id WHERE {_D3} < 0.15 GROUP BY ALL) WHERE n > 10 GROUP BY scene_id""")
def flt5(spark, d):
    e = view(spark, d, "event_points")
    low = e.groupBy("scene_id").agg(F.percentile("z", F.lit(0.1)).alias("q"))
    kept = filters.radius_outliers(e.join(low, "scene_id").where("z > q"), 0.15, 10)
    return kept.groupBy("scene_id").agg(F.count("*").alias("kept"))


@query("flt6_local_ground", f"""
WITH {_KNN.format(d=_D2).strip()},
g AS (SELECT n.scene_id, n.point_id, quantile_cont(e.z, 0.05) AS ground FROM near n JOIN event_points e ON e.point_id = n.other
  WHERE rank <= 12 GROUP BY ALL),
h AS (SELECT e.*, e.z - ground AS height FROM event_points e JOIN g ON e.point_id = g.point_id),
t AS (SELECT DISTINCT a.point_id FROM h a JOIN h b ON a.scene_id = b.scene_id AND b.height > 0.28 WHERE {_D3} < 0.05)
SELECT scene_id, point_id, round(height, 6) AS height FROM h WHERE height > 0.25 OR point_id IN (SELECT point_id FROM t)""")
def flt6(spark, d):
    kept = filters.above_local_ground(view(spark, d, "event_points"), 12, 0.05, 0.25, 0.28, 0.05, 0.6)
    return rounded(kept.select("scene_id", "point_id", "height"))


@query("flt7_mad_filter", """
WITH c AS (SELECT scene_id, gt_inst, median(x) AS mx, median(y) AS my, median(z) AS mz, count(*) AS n FROM points GROUP BY ALL),
f AS (SELECT p.scene_id, p.gt_inst, n, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS d
  FROM points p JOIN c ON p.scene_id = c.scene_id AND p.gt_inst = c.gt_inst),
m AS (SELECT scene_id, gt_inst, median(d) AS m FROM f GROUP BY ALL),
s AS (SELECT f.scene_id, f.gt_inst, median(abs(d - m)) AS mad FROM f JOIN m ON f.scene_id = m.scene_id AND f.gt_inst = m.gt_inst GROUP BY ALL)
SELECT f.scene_id, f.gt_inst, count(*) AS kept FROM f JOIN m ON f.scene_id = m.scene_id AND f.gt_inst = m.gt_inst
JOIN s ON f.scene_id = s.scene_id AND f.gt_inst = s.gt_inst
WHERE n < 100 OR mad < 1e-9 OR d <= m + 0.8 * CAST(1.4826 AS DOUBLE) * mad GROUP BY ALL""")
def flt7(spark, d):
    kept = filters.away_from_median(view(spark, d, "points"), ("scene_id", "gt_inst"), factor=0.8)
    return kept.groupBy("scene_id", "gt_inst").agg(F.count("*").alias("kept"))


@query("flt8_density", """
SELECT scene_id, gt_inst, n, round(span, 6) AS span FROM (SELECT scene_id, gt_inst, count(*) AS n,
  greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS span FROM points GROUP BY ALL)
WHERE n >= 50 AND span > 0 AND n / span >= 30""")
def flt8(spark, d):
    return rounded(filters.dense_enough(view(spark, d, "points"), ("scene_id", "gt_inst"), 50, 30.0))


@query("flt9_cluster_size", """
WITH c AS (SELECT scene_id, gt_inst, count(*) AS n FROM points GROUP BY ALL)
SELECT p.scene_id, CASE WHEN n BETWEEN 20 AND 1000 THEN p.gt_inst END AS gt_inst, count(*) AS n
FROM points p JOIN c ON p.scene_id = c.scene_id AND p.gt_inst = c.gt_inst GROUP BY 1, 2""")
def flt9(spark, d):
    return filters.sized(view(spark, d, "points"), "gt_inst", 20, 1000).groupBy("scene_id", "gt_inst").agg(F.count("*").alias("n"))


@query("flt10_score_threshold", """
SELECT scene_id, count(*) FILTER (logit1 > logit0) AS by_argmax, count(*) FILTER (1.0 / (1.0 + exp(logit0 - logit1)) > 0.7) AS by_score,
  round(avg(1.0 / (1.0 + exp(logit0 - logit1))), 6) AS mean_score FROM points GROUP BY scene_id""")
def flt10(spark, d):
    p = view(spark, d, "points").withColumn("p", filters.probability())
    return rounded(p.groupBy("scene_id").agg(F.count_if(F.col("logit1") > F.col("logit0")).alias("by_argmax"), F.count_if(F.col("p") > 0.7).alias("by_score"), F.avg("p").alias("mean_score")))


@query("flt11_adaptive_threshold", """
WITH s AS (SELECT scene_id, 1.0 / (1.0 + exp(logit0 - logit1)) AS p FROM points),
a AS (SELECT scene_id, avg(CASE WHEN p > 0.9 THEN 1.0 ELSE 0.0 END) AS kept, quantile_cont(p, 0.8) AS lo, quantile_cont(p, 0.4) AS hi FROM s GROUP BY ALL)
SELECT scene_id, round(kept, 6) AS kept, round(CASE WHEN kept < 0.2 THEN greatest(0.05, least(0.95, lo))
  WHEN kept > 0.6 THEN greatest(0.05, least(0.95, hi)) ELSE 0.9 END, 6) AS threshold FROM a""")
def flt11(spark, d):
    scores = view(spark, d, "points").select("scene_id", filters.probability().alias("p"))
    return rounded(filters.adapted_threshold(scores, "p", 0.9, 0.2, 0.6))


@query("flt12_box_crop", """
SELECT scene_id, count(*) AS n, round(sum(z), 6) AS z FROM points
WHERE x BETWEEN 1.4 - 0.4 AND 1.4 + 0.4 AND y BETWEEN 1.3 - 0.3 AND 1.3 + 0.3 AND z BETWEEN 0.15 - 0.1 AND 0.15 + 0.1 GROUP BY ALL""")
def flt12(spark, d):
    kept = filters.in_box(view(spark, d, "points"), (1.4, 1.3, 0.15), (0.8, 0.6, 0.2))
    return rounded(kept.groupBy("scene_id").agg(F.count("*").alias("n"), F.sum("z").alias("z")))


@query("smp1_stratified_sample", f"""
WITH s AS (SELECT scene_id, point_id, CASE WHEN z > 0.2 THEN 'high' ELSE 'low' END AS stratum, {uniform_sql(7)} AS u FROM points)
SELECT scene_id, point_id, stratum FROM s
QUALIFY row_number() OVER (PARTITION BY scene_id, stratum ORDER BY u, point_id) <= CASE WHEN stratum = 'high' THEN 200 ELSE 100 END""")
def smp1(spark, d):
    stratum = F.when(F.col("z") > 0.2, "high").otherwise("low")
    return sampling.stratified(view(spark, d, "points"), stratum, {"high": 200, "low": 100}, 7).select("scene_id", "point_id", "stratum")


@query("smp2_stride_sample", """
WITH p AS (SELECT scene_id, point_id, row_number() OVER (PARTITION BY scene_id ORDER BY point_id) - 1 AS place,
  count(*) OVER (PARTITION BY scene_id) AS n FROM event_points),
w AS (SELECT DISTINCT scene_id, CAST(floor(i * (n - 1) / 99.0) AS BIGINT) AS place FROM (SELECT DISTINCT scene_id, n FROM p), range(0, 100) t(i))
SELECT p.scene_id, point_id FROM p JOIN w ON p.scene_id = w.scene_id AND p.place = w.place""")
def smp2(spark, d):
    return sampling.strided(view(spark, d, "event_points"), 100).select("scene_id", "point_id")


@query("smp3_thinning", f"SELECT scene_id, count(*) AS n, sum(point_id % 1000) :: BIGINT AS ids FROM points WHERE {uniform_sql(3)} < 0.1 GROUP BY ALL")
def smp3(spark, d):
    return sampling.thinned(view(spark, d, "points"), 0.1, 3).groupBy("scene_id").agg(F.count("*").alias("n"), F.sum(F.col("point_id") % 1000).alias("ids"))


@query("smp4_pad_to_size", """
WITH p AS (SELECT scene_id, point_id, row_number() OVER (PARTITION BY scene_id ORDER BY point_id) - 1 AS place,
  count(*) OVER (PARTITION BY scene_id) AS n FROM event_points)
SELECT p.scene_id, CAST(s.i AS INT) AS slot, point_id FROM p JOIN range(0, 4096) s(i) ON s.i % p.n = p.place""")
def smp4(spark, d):
    return sampling.padded(view(spark, d, "event_points"), 4096).select("scene_id", "slot", "point_id")


@query("smp5_farthest_points")
def smp5(spark, d):
    return sampling.farthest(view(spark, d, "event_points"), 8)


@query("smp6_voxel_downsample", """
WITH l AS (SELECT scene_id, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM points GROUP BY ALL)
SELECT p.scene_id, CAST(floor((x - x0) / 0.1) AS BIGINT) AS ix, CAST(floor((y - y0) / 0.1) AS BIGINT) AS iy, CAST(floor((z - z0) / 0.1) AS BIGINT) AS iz,
  round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b,
  CAST(avg(sem_gt) > 0.5 AS INT) AS label, arg_min(gt_inst, point_id) AS instance, min(point_id) AS point_id, count(*) AS points
FROM points p JOIN l ON p.scene_id = l.scene_id GROUP BY 1, 2, 3, 4""")
def smp6(spark, d):
    return rounded(sampling.voxels(view(spark, d, "points"), 0.1))


@query("smp6e_voxel_to_target")
def smp6e(spark, d):
    size, out = sampling.voxels_to_target(view(spark, d, "points"), 0.1, 500)
    return out.groupBy("scene_id").agg(F.count("*").alias("cells"), F.sum("points").alias("points")).withColumn("size", F.round(F.lit(size), 6))


_TILES = """
WITH l AS (SELECT scene_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM points GROUP BY ALL),
t AS (SELECT p.scene_id, p.point_id, i.i AS tile_x, j.j AS tile_y FROM points p JOIN l ON p.scene_id = l.scene_id
  JOIN range(0, 100) i(i) ON x - x0 >= i.i * 0.5 AND x - x0 < i.i * 0.5 + 1.0 AND i.i <= floor((x1 - x0) / 0.5)
  JOIN range(0, 100) j(j) ON y - y0 >= j.j * 0.5 AND y - y0 < j.j * 0.5 + 1.0 AND j.j <= floor((y1 - y0) / 0.5))"""


@query("til1_sliding_tiles", _TILES + """
SELECT scene_id, CAST(tile_x AS INT) AS tile_x, CAST(tile_y AS INT) AS tile_y, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 100""")
def til1(spark, d):
    out = spatial.tiles(view(spark, d, "points"), 1.0, 0.5, 100)
    return out.groupBy("scene_id", "tile_x", "tile_y").agg(F.count("*").alias("n"))


@query("til2_anchored_tiles", """
WITH l AS (SELECT scene_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM points GROUP BY ALL),
t AS (SELECT p.scene_id, p.point_id, i.i AS tile_x, j.j AS tile_y FROM points p JOIN l ON p.scene_id = l.scene_id
  JOIN range(0, 100) i(i) ON i.i <= greatest(0, ceil((x1 - x0 - 1.0) / 0.7)) AND x BETWEEN greatest(x0, least(x0 + i.i * 0.7, x1 - 1.0)) AND greatest(x0, least(x0 + i.i * 0.7, x1 - 1.0)) + 1.0
  JOIN range(0, 100) j(j) ON j.j <= greatest(0, ceil((y1 - y0 - 1.0) / 0.7)) AND y BETWEEN greatest(y0, least(y0 + j.j * 0.7, y1 - 1.0)) AND greatest(y0, least(y0 + j.j * 0.7, y1 - 1.0)) + 1.0)
SELECT scene_id, CAST(tile_x AS INT) AS tile_x, CAST(tile_y AS INT) AS tile_y, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 32""")
def til2(spark, d):
    out = spatial.anchored_tiles(view(spark, d, "points"), 1.0, 0.7)
    return out.groupBy("scene_id", "tile_x", "tile_y").agg(F.count("*").alias("n")).where("n >= 32")


@query("prj1_rigid_transform", """
SELECT scene_id, round(sum((x * cos(radians(30)) - y * sin(radians(30))) * -1.1 + 1.0), 3) AS x, round(sum((x * sin(radians(30)) + y * cos(radians(30))) * 1.1), 3) AS y,
  round(sum(z * 1.1 + 0.5), 3) AS z FROM points GROUP BY ALL""")
def prj1(spark, d):
    out = labels.rotated(view(spark, d, "points"), 30.0, 1.1, True, (1.0, 0.0, 0.5))
    return rounded(out.groupBy("scene_id").agg(*[F.sum(c).alias(c) for c in "xyz"]), 3)


@query("prj1_align_vectors", """
SELECT scene_id, round(sum(x * x + y * y + z * z), 3) AS lengths, round(avg(-z), 6) AS x FROM points GROUP BY ALL""")
def prj1b(spark, d):
    out = labels.turned(view(spark, d, "points"), labels.rotation_between((0.0, 0.0, -1.0), (1.0, 0.0, 0.0)))
    return out.groupBy("scene_id").agg(F.round(F.sum(F.expr("x * x + y * y + z * z")), 3).alias("lengths"), F.round(F.avg("x"), 6).alias("x"))


@query("prj1_elastic")
def prj1c(spark, d):
    out = labels.elastic(view(spark, d, "points"), 0.5, 0.05)
    return out.select("scene_id", "point_id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("prj2_normalise", """
SELECT p.scene_id, gt_inst, round(avg(x - x0), 6) AS x, round(max(y - y0), 6) AS y, round(min(z - z0), 6) AS z, round(avg(2 * r - 1), 6) AS r
FROM points p JOIN (SELECT scene_id, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM points GROUP BY ALL) o ON p.scene_id = o.scene_id GROUP BY ALL""")
def prj2(spark, d):
    out = labels.normalised(view(spark, d, "points"), ("scene_id",))
    return rounded(out.groupBy("scene_id", "gt_inst").agg(F.avg("x").alias("x"), F.max("y").alias("y"), F.min("z").alias("z"), F.avg("r").alias("r")))


@query("prj3_crop_relabel", """
WITH c AS (SELECT * FROM points WHERE x BETWEEN 0.5 AND 0.9 AND y BETWEEN 0.5 AND 0.9)
SELECT scene_id, CAST(dense_rank() OVER (PARTITION BY scene_id ORDER BY gt_inst) - 1 AS INT) AS gt_inst, n
FROM (SELECT scene_id, gt_inst, count(*) AS n FROM c GROUP BY ALL)""")
def prj3(spark, d):
    out = labels.cropped(view(spark, d, "points"), "gt_inst", (0.5, 0.5), (0.9, 0.9))
    return out.groupBy("scene_id", "gt_inst").agg(F.count("*").alias("n"))


@query("prj4_renumber", """
SELECT scene_id, CAST(dense_rank() OVER (PARTITION BY scene_id ORDER BY gt_inst) AS INT) AS gt_inst, n
FROM (SELECT scene_id, gt_inst, count(*) AS n FROM points GROUP BY ALL)""")
def prj4(spark, d):
    out = labels.renumbered(view(spark, d, "points"), "gt_inst", 1)
    return out.groupBy("scene_id", "gt_inst").agg(F.count("*").alias("n"))


@query("prj5_centroid_offsets", """
WITH i AS (SELECT scene_id, gt_inst, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, min(x) AS nx, max(x) AS hx FROM points GROUP BY ALL)
SELECT p.scene_id, p.gt_inst, round(avg(abs(mx - x)), 3) AS dx, round(avg(abs(my - y)), 3) AS dy, round(avg(abs(mz - z)), 3) AS dz, round(max(hx - nx), 3) AS width
FROM points p JOIN i ON p.scene_id = i.scene_id AND p.gt_inst = i.gt_inst GROUP BY ALL""")
def prj5(spark, d):
    out = labels.centroid_offsets(view(spark, d, "points"), "gt_inst")
    mean = [F.avg(F.abs(f"offset_{c}")).alias(f"d{c}") for c in "xyz"]
    return rounded(out.groupBy("scene_id", "gt_inst").agg(*mean, F.max(F.col("max_x") - F.col("min_x")).alias("width")), 3)
