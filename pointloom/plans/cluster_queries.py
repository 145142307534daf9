"""Queries of clustering, refinement, ground, traits and of the whole scene pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.lineage import cut
from pointloom.operators import agglomeration, alpha, clusters, filters, ground, hierarchy, labels, refine, spatial, splits, traits
from pointloom.views import view

from .join_queries import _NEAR
from .point_queries import _D3, rounded
from .registry import query


def _events(spark, d):
    return view(spark, d, "event_points")


def _sizes(labelled, *keys):
    return labelled.groupBy("scene_id", *keys, "label").agg(F.count("*").alias("n"))


def dbscan_sql(eps: float, least: int, same: str = "TRUE", x: str = "x") -> str:
    """Partition of the event points: components of core points by label passing, then borders."""
    return f"""
WITH RECURSIVE s AS (SELECT scene_id, point_id, inst, {x} AS x, y, z FROM event_points),
near AS (SELECT a.scene_id, a.point_id AS u, b.point_id AS v FROM s a JOIN s b ON a.scene_id = b.scene_id AND {_D3} <= {eps} AND {same}),
core AS (SELECT u FROM near GROUP BY u HAVING count(*) >= {least}),
e AS (SELECT u, v FROM near WHERE u IN (SELECT u FROM core) AND v IN (SELECT u FROM core)),
cc(node, component) USING KEY (node) AS (
  SELECT u, u FROM core
  UNION
  SELECT e.u, min(c.component) FROM e JOIN cc c ON c.node = e.v JOIN recurring.cc o ON o.node = e.u WHERE c.component < o.component GROUP BY e.u),
l AS (SELECT n.v AS point_id, min(cc.component) AS border FROM near n JOIN cc ON cc.node = n.u GROUP BY n.v),
f AS (SELECT s.scene_id, s.point_id, coalesce(cc.component, l.border) AS label FROM s LEFT JOIN cc ON cc.node = s.point_id LEFT JOIN l ON l.point_id = s.point_id)"""


_CC_POINTS = """
cc(scene_id, node, component) USING KEY (scene_id, node) AS (
  SELECT scene_id, node, node FROM nodes
  UNION
  SELECT e.scene_id, e.u, min(c.component) FROM e JOIN cc c ON c.scene_id = e.scene_id AND c.node = e.v
  JOIN recurring.cc o ON o.scene_id = e.scene_id AND o.node = e.u WHERE c.component < o.component GROUP BY e.scene_id, e.u)"""


@query("cl1_euclidean", dbscan_sql(0.12, 8).strip() + " SELECT scene_id, label, count(*) AS n FROM f GROUP BY ALL")
def cl1(spark, d):
    return _sizes(clusters.dbscan(_events(spark, d), 0.12, 8))


@query("cl2_dbscan", dbscan_sql(0.1, 5).strip() + " SELECT scene_id, point_id, label FROM f")
def cl2(spark, d):
    return clusters.dbscan(_events(spark, d), 0.1, 5).select("scene_id", "point_id", "label")


@query("cl3_density_tree")
def cl3(spark, d):
    return _sizes(hierarchy.density_tree(_events(spark, d), 5, 0.4, 15))


@query("cl4_density_peaks")
def cl4(spark, d):
    return _sizes(clusters.density_peaks(_events(spark, d), 8, 12, 0.5, 0.4))


@query("cl5_grid_mean_shift")
def cl5(spark, d):
    return _sizes(clusters.mean_shift(_events(spark, d), 0.6, 0.4))


@query("cl6_k_means")
def cl6(spark, d):
    return _sizes(clusters.k_means(_events(spark, d), 6))


@query("cl8_summaries", f"""
WITH RECURSIVE p AS (SELECT *, floor(x / 0.1) AS ix, floor(y / 0.1) AS iy, floor(z / 0.1) AS iz FROM event_points),
nodes AS (SELECT scene_id, ix, iy, iz, min(point_id) AS node, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY ALL),
e AS (SELECT a.scene_id, a.node AS u, b.node AS v FROM nodes a JOIN nodes b ON a.scene_id = b.scene_id AND {_D3} < 0.2),{_CC_POINTS}
SELECT p.scene_id, component AS label, count(*) AS n FROM p JOIN nodes n ON p.scene_id = n.scene_id AND p.ix = n.ix AND p.iy = n.iy AND p.iz = n.iz
JOIN cc ON cc.scene_id = n.scene_id AND cc.node = n.node GROUP BY ALL""")
def cl8(spark, d):
    return _sizes(clusters.summarised(_events(spark, d), 0.1, 0.2))


def _tree_sql(radius: float) -> str:
    """Levels of the feature tree, one after the other."""
    cells = ", ".join(f"floor({c} / {radius / 8}) AS i{c}" for c in "xyz")
    spread = "sqrt(greatest(0.0, ss / n - (sx * sx + sy * sy + sz * sz) / (n * n)))"
    parts = [f"""t0 AS (SELECT scene_id, {cells}, min(point_id) AS label, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x * x + y * y + z * z) AS ss
FROM event_points GROUP BY ALL)"""]
    for k in range(clusters.TREE_LEVELS):
        up = ", ".join(f"floor(i{c} / 2) AS i{c}" for c in "xyz")
        same = " AND ".join(f"floor(t.i{c} / 2) = g.i{c}" for c in "xyz")
        parts.append(f"""t{k + 1} AS (SELECT * FROM (SELECT scene_id, {up}, min(label) AS label, CAST(sum(n) AS BIGINT) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sz) AS sz, sum(ss) AS ss
FROM t{k} GROUP BY scene_id, floor(ix / 2), floor(iy / 2), floor(iz / 2)) WHERE {spread} <= {radius}),
c{k} AS (SELECT * FROM t{k} t WHERE NOT EXISTS (SELECT 1 FROM t{k + 1} g WHERE g.scene_id = t.scene_id AND {same}))""")
    rows = " UNION ALL ".join(f"SELECT * FROM {t}" for t in [*(f"c{k}" for k in range(clusters.TREE_LEVELS)), f"t{clusters.TREE_LEVELS}"])
    return f"WITH {', '.join(parts)} SELECT scene_id, label, n, n AS points, round(sx / n, 6) AS mean_x, round({spread}, 5) AS radius FROM ({rows})"


def _rounded_mean(column: str, digits: int):
    """The mean of an aggregation, rounded, from a sum of decimals: one of doubles follows the order of its rows, and its last
    bit turns the rounding where the mean lies halfway. Values are taken to 12 decimals; where one does not fit into those
    (1e16 and more, or not a number), all of the group are summed as doubles."""
    exact = F.col(column).try_cast("decimal(28,12)")
    whole = F.count(exact) == F.count(column)
    return F.when(whole, F.round(F.avg(exact), digits).cast("double")).otherwise(F.round(F.avg(column), digits))


@query("cl8_feature_leaves", _tree_sql(0.0937))
def cl8b(spark, d):
    labelled, leaves = clusters.feature_leaves(_events(spark, d), 0.0937)
    counted = labelled.groupBy("scene_id", "label").agg(F.count("*").alias("points"), _rounded_mean("x", 6).alias("mean_x"))
    return leaves.join(counted, ["scene_id", "label"]).select("scene_id", "label", "n", "points", "mean_x", F.round("radius", 5).alias("radius"))


@query("cl9_mean_shift")
def cl9(spark, d):
    return _sizes(clusters.mean_shift(_events(spark, d), 0.6, 0.4, least=5))


@query("cl10_linked_neighbours", f"""
WITH RECURSIVE {_NEAR.format(d=_D3, on='').strip()},
k AS (SELECT * FROM n WHERE rank <= 5 AND distance <= 0.12), nodes AS (SELECT scene_id, point_id AS node FROM event_points),
e AS (SELECT scene_id, left_id AS u, right_id AS v FROM k UNION SELECT scene_id, right_id, left_id FROM k),{_CC_POINTS}
SELECT scene_id, component AS label, count(*) AS n FROM cc GROUP BY ALL""")
def cl10(spark, d):
    return _sizes(clusters.linked(_events(spark, d), 5, 0.4, 0.12))


@query("cl10_agglomerated")
def cl10_agglomerated(spark, d):
    return _sizes(agglomeration.agglomerated(_events(spark, d), 5, 0.4, 0.12))


@query("cl11_watershed")
def cl11(spark, d):
    return _sizes(clusters.watershed(_events(spark, d), 0.1, 0.6))


@query("cl12_one_cluster", "SELECT scene_id, 0 AS label, count(*) AS n FROM event_points GROUP BY ALL")
def cl12(spark, d):
    return _sizes(_events(spark, d).withColumn("label", F.lit(0)))


@query("cl13_adaptive_seed")
def cl13(spark, d):
    distance, out = clusters.with_adaptive_seed(_events(spark, d), (1.2, 0.6), 0.1)
    return _sizes(out).withColumn("seed_distance", F.lit(distance))


@query("cl14_shifted_dbscan", dbscan_sql(0.1, 6, x="x + (inst - 3) * 0.02").strip() + " SELECT scene_id, label, count(*) AS n FROM f GROUP BY ALL")
def cl14(spark, d):
    e = _events(spark, d).withColumns({"dx": (F.col("inst") - 3) * 0.02, "dy": F.lit(0.0), "dz": F.lit(0.0)})
    return _sizes(clusters.shifted_dbscan(e, ("dx", "dy", "dz"), 0.1, 6))


@query("cl15_fallback_dbscan", dbscan_sql(0.08, 20).strip() + " SELECT scene_id, label, count(*) AS n FROM f GROUP BY ALL")
def cl15(spark, d):
    return _sizes(clusters.dbscan(_events(spark, d), 0.08, 20))


_BALL = dbscan_sql(0.25, 1, "a.inst = b.inst").replace(f"{_D3} <= 0.25", f"{_D3} < 0.25").strip()


@query("cl16_ball_components", _BALL + """
, k AS (SELECT component, count(*) AS n FROM cc GROUP BY ALL)
SELECT s.scene_id, s.inst, CASE WHEN k.n >= 5 THEN cc.component END AS label, count(*) AS n FROM s JOIN cc ON cc.node = s.point_id JOIN k ON k.component = cc.component GROUP BY ALL""")
def cl16(spark, d):
    return _sizes(clusters.ball_components(_events(spark, d), 0.25, 5, "inst"), "inst")


@query("cl17_soft_groups", f"""
WITH RECURSIVE s AS (SELECT scene_id || '/' || c AS scene_id, scene_id AS scene, CAST(c AS INT) AS cls, point_id, x, y, z FROM event_points, range(0, 2) g(c) WHERE 0.2 + (inst + c) % 3 * 0.3 > 0.4),
nodes AS (SELECT scene_id, point_id AS node, scene, cls FROM s),
e AS (SELECT a.scene_id, a.point_id AS u, b.point_id AS v FROM s a JOIN s b ON a.scene_id = b.scene_id AND {_D3} < 0.15),{_CC_POINTS}
SELECT scene AS scene_id, cls, component AS proposal_id, count(*) AS n FROM cc JOIN nodes USING (scene_id, node) GROUP BY ALL HAVING count(*) >= 5""")
def cl17(spark, d):
    e = _events(spark, d)
    scores = {c: F.lit(0.2) + F.pmod(F.col("inst") + c, F.lit(3)) * 0.3 for c in range(2)}
    return clusters.soft_groups(e, scores, 0.4, 0.15, 5).groupBy("scene_id", "cls", "proposal_id").agg(F.count("*").alias("n"))


@query("cl18_dual_groups", f"""
WITH RECURSIVE s AS (SELECT scene_id || '/' || c AS scene_id, scene_id AS scene, CAST(c AS INT) AS source, point_id, inst, x + c * (0.01 * inst) AS x, y, z FROM event_points, range(0, 2) g(c)),
nodes AS (SELECT scene_id, point_id AS node, scene, source FROM s),
e AS (SELECT a.scene_id, a.point_id AS u, b.point_id AS v FROM s a JOIN s b ON a.scene_id = b.scene_id AND a.inst = b.inst AND {_D3} < 0.25),{_CC_POINTS},
k AS (SELECT scene, source, component, count(*) AS n FROM cc JOIN nodes USING (scene_id, node) GROUP BY ALL HAVING count(*) >= 5)
SELECT scene AS scene_id, source, component AS proposal_id, n, round(least(1.0, n / CAST(max(n) OVER (PARTITION BY scene) AS DOUBLE)), 6) AS score FROM k""")
def cl18(spark, d):
    e = _events(spark, d).withColumns({"dx": F.lit(0.01) * F.col("inst"), "dy": F.lit(0.0), "dz": F.lit(0.0)})
    return rounded(clusters.dual_groups(e, ("dx", "dy", "dz"), 0.25, 5, "inst"))


@query("cl20_leaf_dbscan_mm", dbscan_sql(0.1, 5).strip() + " SELECT scene_id, count(DISTINCT label) AS leaves, count(*) FILTER (label IS NULL) AS noise FROM f GROUP BY ALL")
def cl20(spark, d):
    """Coordinates in millimetres."""
    mm = _events(spark, d).withColumns({c: F.col(c) * 1000 for c in "xyz"})
    out = clusters.dbscan(mm, 100.0000001, 5)
    return out.groupBy("scene_id").agg(F.count_distinct("label").alias("leaves"), F.count_if(F.col("label").isNull()).alias("noise"))


@query("gp2_sticky_clusters", dbscan_sql(0.1, 1).strip() + """
SELECT scene_id, label, n, instances FROM (SELECT f.scene_id, f.label, count(*) AS n, count(DISTINCT s.inst) AS instances FROM f JOIN s ON s.point_id = f.point_id GROUP BY ALL) WHERE n >= 20 AND instances >= 2""")
def gp2(spark, d):
    e = _events(spark, d)
    out = clusters.dbscan(e, 0.1, 1).groupBy("scene_id", "label").agg(F.count("*").alias("n"), F.count_distinct("inst").alias("instances"))
    return out.where("n >= 20 AND instances >= 2")


@query("ag8_weighted_vote", f"""
WITH {_NEAR.format(d=_D3, on="AND b.inst >= 3 AND a.inst < 3").strip()},
v AS (SELECT n.scene_id, left_id, e.inst, sum(1.0 / (distance + 1e-6)) AS w FROM n JOIN event_points e ON e.point_id = right_id WHERE rank <= 10 GROUP BY ALL)
SELECT scene_id, left_id AS point_id, inst FROM v QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY round(w, 6) DESC, inst) = 1""")
def ag8(spark, d):
    e = _events(spark, d)
    near = spatial.knn_join(e.where("inst < 3"), e.where("inst >= 3").withColumn("to", F.col("inst")), 10, 0.4, extra=("to",))
    votes = near.groupBy("scene_id", "left_id", "to").agg(F.sum(1.0 / (F.col("distance") + 1e-6)).alias("w"))
    best = votes.groupBy("scene_id", F.col("left_id").alias("point_id")).agg(F.min(F.struct((-F.round("w", 6)).alias("w"), "to"))["to"].alias("inst"))
    return best


# --- refinement ------------------------------------------------------------------------------------------------------


def _labelled(spark, d):
    return _events(spark, d).withColumn("label", F.col("inst").cast("long"))


@query("jn14_centroid_axis_pairs")
def jn14(spark, d):
    out = refine.merge_fragments(_labelled(spark, d), "label", 10.0, 3.0, 60.0)
    return out.groupBy("scene_id", "inst", "label").agg(F.count("*").alias("n"))


@query("rf1_skeleton_split")
def rf1(spark, d):
    return _sizes(splits.split(_labelled(spark, d), "label"))


@query("rf2_recursive_cuts")
def rf2(spark, d):
    """One pass of recursive cuts of every cluster, with the path of each part."""
    e = _labelled(spark, d).withColumns({"spacing": F.lit(0.35), "valley": F.lit(0.92)})
    return splits.parts(e, "label", splits.Rule()).groupBy("scene_id", "label", "path").agg(F.count("*").alias("n"))


@query("rf3_dynamic_spacing")
def rf3(spark, d):
    return _sizes(splits.split(_labelled(spark, d), "label", splits.Rule(spacing=6.0), dynamic=True, longest=0.6, least_points=20))


@query("rf4_horizontal_split")
def rf4(spark, d):
    return _sizes(splits.split(_labelled(spark, d), "label", splits.Rule("horizontal"), every=True))


@query("rf16_legacy_split")
def rf16(spark, d):
    return _sizes(splits.split(_labelled(spark, d), "label", splits.Rule("legacy", valley=0.9, diameter=0.5, aspect=2.0)))


@query("rf5_merge_fragments")
def rf5(spark, d):
    return _sizes(refine.merge_fragments(_labelled(spark, d), "label", 10.0, 3.0, 80.0))


@query("rf6_merge_stacked", f"""
WITH RECURSIVE c AS (SELECT DISTINCT scene_id, inst, floor(x / 0.03) AS ix, floor(y / 0.03) AS iy FROM event_points),
k AS (SELECT scene_id, inst, count(*) AS cells FROM c GROUP BY ALL),
b AS (SELECT scene_id, inst, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, avg(x) AS xm, avg(y) AS ym, avg(z) AS zm FROM event_points GROUP BY ALL HAVING count(*) >= 10),
m AS (SELECT a.scene_id, a.inst AS u, b.inst AS v, count(*) AS shared FROM c a JOIN c b ON a.scene_id = b.scene_id AND a.ix = b.ix AND a.iy = b.iy AND a.inst < b.inst GROUP BY ALL),
g AS (SELECT m.scene_id, m.u, m.v FROM m JOIN b p ON p.scene_id = m.scene_id AND p.inst = u JOIN b q ON q.scene_id = m.scene_id AND q.inst = v
  JOIN k i ON i.scene_id = m.scene_id AND i.inst = u JOIN k j ON j.scene_id = m.scene_id AND j.inst = v
  WHERE shared >= 0.04 * least(i.cells, j.cells) AND abs(p.zm - q.zm) >= 0.003 AND sqrt((p.xm - q.xm) * (p.xm - q.xm) + (p.ym - q.ym) * (p.ym - q.ym)) <= 0.4
  AND sqrt((greatest(p.x1, q.x1) - least(p.x0, q.x0)) ** 2 + (greatest(p.y1, q.y1) - least(p.y0, q.y0)) ** 2 + (greatest(p.z1, q.z1) - least(p.z0, q.z0)) ** 2) <= 100),
nodes AS (SELECT DISTINCT scene_id, inst AS node FROM event_points), e AS (SELECT scene_id, u, v FROM g UNION ALL SELECT scene_id, v, u FROM g),{_CC_POINTS}
SELECT p.scene_id, CAST(component AS BIGINT) AS label, count(*) AS n FROM event_points p JOIN cc ON cc.scene_id = p.scene_id AND cc.node = p.inst GROUP BY ALL""")
def rf6(spark, d):
    return _sizes(refine.merge_stacked(_labelled(spark, d), "label", 0.4, 0.003, 100.0, 0.04))


@query("rf7_tiny_fragments", """
WITH f AS (SELECT scene_id, gt_inst AS l, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points GROUP BY ALL),
b AS (SELECT s.scene_id, s.l, t.l AS big FROM f s JOIN f t ON s.scene_id = t.scene_id AND t.n >= 900 AND s.n >= 700 AND s.n < 900
  WHERE sqrt((s.cx - t.cx) * (s.cx - t.cx) + (s.cy - t.cy) * (s.cy - t.cy) + (s.cz - t.cz) * (s.cz - t.cz)) <= 0.2
  QUALIFY row_number() OVER (PARTITION BY s.scene_id, s.l ORDER BY sqrt((s.cx - t.cx) * (s.cx - t.cx) + (s.cy - t.cy) * (s.cy - t.cy) + (s.cz - t.cz) * (s.cz - t.cz)), t.l) = 1)
SELECT f.scene_id, CASE WHEN f.n < 700 THEN NULL ELSE coalesce(b.big, f.l) END AS label, CAST(sum(f.n) AS BIGINT) AS n FROM f LEFT JOIN b ON f.scene_id = b.scene_id AND f.l = b.l GROUP BY 1, 2""")
def rf7(spark, d):
    p = view(spark, d, "points").withColumn("label", F.col("gt_inst"))
    return _sizes(refine.clean_up(p, "label", 700, 900, 0.2))


@query("rf8_reassign_by_votes", f"""
WITH k AS (SELECT scene_id, inst, count(*) AS n FROM event_points GROUP BY ALL), s AS (SELECT p.*, k.n FROM event_points p JOIN k USING (scene_id, inst)),
r AS (SELECT a.scene_id, a.point_id, b.inst, {_D3} AS d, row_number() OVER (PARTITION BY a.scene_id, a.point_id ORDER BY {_D3}, b.point_id) AS r FROM s a JOIN s b ON a.scene_id = b.scene_id AND a.n < 280 AND b.n >= 280),
v AS (SELECT scene_id, point_id, inst, round(sum(1.0 / (d + 1e-6)), 9) AS w FROM r WHERE r <= 10 GROUP BY ALL),
t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY scene_id, point_id ORDER BY w DESC, inst) = 1)
SELECT s.scene_id, CAST(coalesce(t.inst, s.inst) AS BIGINT) AS label, count(*) AS n FROM s LEFT JOIN t ON t.scene_id = s.scene_id AND t.point_id = s.point_id GROUP BY ALL""")
def rf8(spark, d):
    return _sizes(refine.reassign_by_votes(_labelled(spark, d), "label", 280, 10, 0.4))


@query("rf9_noise_votes", f"""
WITH r AS (SELECT a.scene_id, a.point_id, b.inst, row_number() OVER (PARTITION BY a.point_id ORDER BY {_D3}, b.point_id) AS k
  FROM event_points a JOIN event_points b ON a.scene_id = b.scene_id AND a.inst = 0 AND b.inst > 0 AND {_D3} < 0.25),
v AS (SELECT scene_id, point_id, inst, count(*) AS n FROM r WHERE k <= 5 GROUP BY ALL HAVING count(*) >= 3),
t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY n DESC, inst) = 1)
SELECT e.scene_id, CASE WHEN e.inst > 0 THEN e.inst ELSE t.inst END :: BIGINT AS label, count(*) AS n FROM event_points e LEFT JOIN t ON t.point_id = e.point_id GROUP BY ALL""")
def rf9(spark, d):
    e = _labelled(spark, d).withColumn("label", F.when(F.col("inst") > 0, F.col("label")))
    return _sizes(refine.vote_noise(e, "label", 0.25))


@query("rf10_noise_to_nearest", f"""
WITH r AS (SELECT a.point_id, b.inst, row_number() OVER (PARTITION BY a.point_id ORDER BY {_D3}, b.point_id) AS k
  FROM event_points a JOIN event_points b ON a.scene_id = b.scene_id AND a.inst = 0 AND b.inst > 0 AND {_D3} < 0.1)
SELECT e.scene_id, CASE WHEN e.inst > 0 THEN e.inst ELSE r.inst END :: BIGINT AS label, count(*) AS n FROM event_points e LEFT JOIN r ON r.point_id = e.point_id AND r.k = 1 GROUP BY ALL""")
def rf10(spark, d):
    e = _labelled(spark, d).withColumn("label", F.when(F.col("inst") > 0, F.col("label")))
    return _sizes(refine.nearest_label(e, "label", 0.1))


@query("rf11_foreground_fill")
def rf11(spark, d):
    e = _labelled(spark, d).withColumn("label", F.when(F.col("inst") > 2, F.col("label")))
    return _sizes(refine.filled(e, "label", 0.1))


@query("rf12_post_stage_chain", f"""
WITH a0 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY scene_id, inst) >= 100 THEN inst END AS l FROM event_points),
r AS (SELECT a.scene_id, a.point_id, b.l, row_number() OVER (PARTITION BY a.scene_id, a.point_id ORDER BY {_D3}, b.point_id) AS k FROM a0 a JOIN a0 b ON a.scene_id = b.scene_id AND a.l IS NULL AND b.l IS NOT NULL AND {_D3} < 0.2),
v AS (SELECT scene_id, point_id, l, count(*) AS n FROM r WHERE k <= 5 GROUP BY ALL HAVING count(*) >= 3),
t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY scene_id, point_id ORDER BY n DESC, l) = 1),
a1 AS (SELECT a0.scene_id, a0.point_id, x, y, z, coalesce(a0.l, t.l) AS l FROM a0 LEFT JOIN t ON t.scene_id = a0.scene_id AND t.point_id = a0.point_id),
a2 AS (SELECT * REPLACE (CASE WHEN l IS NOT NULL AND count(*) OVER (PARTITION BY scene_id, l) >= 280 THEN l END AS l) FROM a1),
q AS (SELECT a.scene_id, a.point_id, b.l, row_number() OVER (PARTITION BY a.scene_id, a.point_id ORDER BY {_D3}, b.point_id) AS k FROM a2 a JOIN a2 b ON a.scene_id = b.scene_id AND a.l IS NULL AND b.l IS NOT NULL AND {_D3} < 0.2),
a3 AS (SELECT a2.scene_id, coalesce(a2.l, q.l) AS l FROM a2 LEFT JOIN q ON q.scene_id = a2.scene_id AND q.point_id = a2.point_id AND q.k = 1),
o AS (SELECT scene_id, l, dense_rank() OVER (PARTITION BY scene_id ORDER BY l) AS label FROM (SELECT DISTINCT scene_id, l FROM a3 WHERE l IS NOT NULL))
SELECT a3.scene_id, o.label, count(*) AS n FROM a3 LEFT JOIN o ON o.scene_id = a3.scene_id AND o.l = a3.l GROUP BY ALL""")
def rf12(spark, d):
    return _sizes(post_stages(_labelled(spark, d), 100, 280, 0.2))


def post_stages(points, discard: int, least: int, radius: float):
    """Small clusters go, noise takes votes and then the nearest label, and labels are numbered from 1."""
    kept = cut(filters.sized(cut(points), "label", discard, 1 << 60))
    voted = cut(refine.vote_noise(kept, "label", radius))
    big = cut(filters.sized(voted, "label", least, 1 << 60))
    return cut(labels.renumbered(cut(refine.nearest_label(big, "label", radius)), "label", 1))


@query("rf13_refine_external_labels")
def rf13(spark, d):
    out = splits.split(_labelled(spark, d), "label")
    return _sizes(post_stages(refine.merge_fragments(out, "label", 0.5, 0.5, 30.0), 10, 20, 0.2))


@query("rf14_ablation_switches")
def rf14(spark, d):
    """Labels with the split alone, with the merge alone, and with neither."""
    e = _labelled(spark, d)
    arms = {"base": e, "split": splits.split(e, "label"), "merge": refine.merge_fragments(e, "label", 10.0, 3.0, 80.0)}
    out = None
    for name, arm in arms.items():
        counted = arm.groupBy("scene_id").agg(F.count_distinct("label").alias("clusters")).withColumn("arm", F.lit(name))
        out = counted if out is None else out.unionByName(counted)
    return out


@query("rf15_density_profiles")
def rf15(spark, d):
    p = refine.with_peaks(refine.profiles(_labelled(spark, d), ["scene_id", "label"], "x", 15, 0.5), 2, 0.1)
    return p.select("scene_id", "label", F.size("peaks").alias("n_peaks"), F.round(F.array_min("smooth"), 6).alias("least"))


@query("rf17_recluster_large", dbscan_sql(0.2, 3, "a.inst = b.inst").strip() + """,
b AS (SELECT scene_id, inst FROM event_points GROUP BY ALL HAVING count(*) >= 250 AND sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) >= 1.0)
SELECT s.scene_id, CAST(CASE WHEN b.inst IS NOT NULL AND f.label IS NOT NULL THEN f.label + 1000 ELSE s.inst END AS BIGINT) AS label, count(*) AS n
FROM s JOIN f ON f.scene_id = s.scene_id AND f.point_id = s.point_id LEFT JOIN b ON b.scene_id = s.scene_id AND b.inst = s.inst GROUP BY ALL""")
def rf17(spark, d):
    """Instances with enough points and a long enough diagonal are clustered again; the others keep their labels."""
    e = _labelled(spark, d)
    box = e.groupBy("scene_id", "label").agg(F.count("*").alias("_n"), spatial.length(*[F.max(c) - F.min(c) for c in "xyz"]).alias("_d"))
    big = e.join(box.where("_n >= 250 AND _d >= 1.0").select("scene_id", "label"), ["scene_id", "label"], "left_semi")
    again = clusters.dbscan(big.withColumnRenamed("label", "old"), 0.2, 3, same="inst").where("label IS NOT NULL").select("scene_id", "point_id", (F.col("label") + 1000).alias("new"))
    out = e.join(again, ["scene_id", "point_id"], "left").withColumn("label", F.coalesce("new", "label"))
    return _sizes(out)


@query("rf18_recover_leftovers", dbscan_sql(0.2, 5, "a.inst >= 4 AND b.inst >= 4").strip() + """
SELECT s.scene_id, CAST(CASE WHEN s.inst < 4 THEN s.inst ELSE f.label + 1000 END AS BIGINT) AS label, count(*) AS n FROM s JOIN f ON f.scene_id = s.scene_id AND f.point_id = s.point_id GROUP BY ALL""")
def rf18(spark, d):
    """Points of no proposal, clustered and added."""
    e = _labelled(spark, d)
    taken, rest = e.where("inst < 4"), e.where("inst >= 4").drop("label")
    found = clusters.dbscan(rest, 0.2, 5).withColumn("label", F.col("label") + 1000)
    return _sizes(taken.unionByName(found.select(taken.columns)))


# --- ground and traits -----------------------------------------------------------------------------------------------


@query("gd1_ground_plane")
def gd1(spark, d):
    return rounded(ground.plane(view(spark, d, "points"), share=0.3))


@query("gd2_plane_segmentation")
def gd2(spark, d):
    p = view(spark, d, "points")
    return ground.without_ground(p, "plane", share=1.0, tries=1000).groupBy("scene_id").agg(F.count("*").alias("kept"))


_TERRAIN = """
WITH l AS (SELECT scene_id, min(x) AS x0, min(y) AS y0 FROM points GROUP BY ALL),
p AS (SELECT p.scene_id, p.point_id, p.z, floor((x - x0) / 0.3) AS ix, floor((y - y0) / 0.3) AS iy FROM points p JOIN l ON p.scene_id = l.scene_id),
c AS (SELECT scene_id, ix, iy, count(*) AS n, quantile_cont(z, 0.05) AS h FROM p GROUP BY ALL),
k AS (SELECT a.scene_id, a.ix, a.iy, b.h, row_number() OVER (PARTITION BY a.scene_id, a.ix, a.iy ORDER BY sqrt((a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy)), b.ix * 1000003 + b.iy) AS k
  FROM c a JOIN c b ON a.scene_id = b.scene_id AND b.n >= 60 WHERE a.n < 60),
t AS (SELECT scene_id, ix, iy, h FROM c WHERE n >= 60 UNION ALL SELECT scene_id, ix, iy, h FROM k WHERE k = 1)"""


@query("gd3_terrain_grid", _TERRAIN.strip() + """,
w AS (SELECT scene_id, count(*) FILTER (n >= 60) < 10 AS by_plane FROM c GROUP BY scene_id),
g AS (SELECT p.scene_id, w.by_plane, count(*) AS n, count(*) FILTER (p.z - t.h >= -0.02 AND p.z - t.h <= 0.03) AS ground
  FROM p JOIN w ON w.scene_id = p.scene_id LEFT JOIN t ON p.scene_id = t.scene_id AND p.ix = t.ix AND p.iy = t.iy GROUP BY p.scene_id, w.by_plane)
SELECT scene_id, by_plane, n, CASE WHEN NOT by_plane THEN ground END AS ground FROM g""")
def gd3(spark, d):
    """Scenes that fall back to a plane, which is drawn at random, are told without their count."""
    out = ground.terrain(view(spark, d, "points"), 0.3, 0.05, 60)
    counted = out.groupBy("scene_id", "by_plane").agg(F.count("*").alias("n"), F.count_if("ground").alias("ground"))
    return counted.withColumn("ground", F.when(~F.col("by_plane"), F.col("ground")))


@query("gd4_smoothed_terrain")
def gd4(spark, d):
    out = ground.terrain(view(spark, d, "points"), 0.3, 0.05, 60, smooth=1.0)
    return out.groupBy("scene_id").agg(F.count_if("ground").alias("ground"))


@query("gd5_preprocess")
def gd5(spark, d):
    e = _events(spark, d)
    keep = filters.statistical_outliers(e, 8, 1.0, 0.4).where("keep").select("scene_id", "point_id")
    clean = e.join(keep, ["scene_id", "point_id"], "left_semi")
    return ground.without_ground(clean, "terrain", cell=0.5).groupBy("scene_id").agg(F.count("*").alias("kept"))


@query("tt1_trait_record", """
SELECT scene_id, gt_inst, count(*) AS n, round(avg(x), 6) AS cx, round(avg(z), 6) AS cz, round(min(x), 6) AS min_x, round(max(y), 6) AS max_y FROM points WHERE gt_inst > 0 GROUP BY ALL HAVING count(*) >= 4""")
def tt1(spark, d):
    t = traits.basic(view(spark, d, "points"), "gt_inst")
    return rounded(t.select("scene_id", "gt_inst", "n", F.col("centroid.x").alias("cx"), F.col("centroid.z").alias("cz"), "box.min_x", "box.max_y"))


@query("tt2_heights", """
WITH h AS (SELECT p.scene_id, p.gt_inst, z - z0 AS d FROM points p JOIN (SELECT scene_id, gt_inst, min(z) AS z0 FROM points GROUP BY ALL) q ON p.scene_id = q.scene_id AND p.gt_inst = q.gt_inst WHERE p.gt_inst > 0)
SELECT scene_id, gt_inst, round((quantile_cont(d, 0.99) - quantile_cont(d, 0.01)) * 100, 6) AS height, round(max(d) * 100, 6) AS max_height FROM h GROUP BY ALL""")
def tt2(spark, d):
    return rounded(traits.heights(view(spark, d, "points"), "gt_inst"))


@query("tt3_spans", """
SELECT scene_id, gt_inst, round((max(x) - min(x)) * 100, 6) AS ew, round((max(y) - min(y)) * 100, 6) AS ns, round(((max(x) - min(x)) * 100 + (max(y) - min(y)) * 100) / 2, 6) AS mean_width FROM points WHERE gt_inst > 0 GROUP BY ALL""")
def tt3(spark, d):
    return rounded(traits.spans(view(spark, d, "points"), "gt_inst"))


@query("tt4_largest_diameter", """
SELECT a.scene_id, a.inst, round(max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS max_diameter
FROM event_points a JOIN event_points b ON a.scene_id = b.scene_id AND a.inst = b.inst WHERE a.inst > 0 GROUP BY ALL""")
def tt4(spark, d):
    return rounded(traits.hulls(view(spark, d, "event_points"), "inst").select("scene_id", "inst", "max_diameter"), 6, "max_diameter")


@query("tt3_crown_hull")
def tt3b(spark, d):
    return rounded(traits.hulls(view(spark, d, "event_points"), "inst"))


@query("tt5_voxel_volume", """
WITH c AS (SELECT scene_id, gt_inst, count(DISTINCT (floor(x / 0.03), floor(y / 0.03), floor(z / 0.03))) * CAST(0.03 AS DOUBLE) ** 3 AS volume, (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS box FROM points WHERE gt_inst > 0 GROUP BY ALL)
SELECT scene_id, gt_inst, round(volume, 6) AS volume, round(CASE WHEN box > 1e-6 THEN volume / box ELSE 0 END, 6) AS compactness FROM c""")
def tt5(spark, d):
    return rounded(traits.voxel_volume(view(spark, d, "points"), "gt_inst"))


@query("tt5_alpha_volume")
def tt5b(spark, d):
    """Alpha volumes of instances; tests hold the operator against all tetrahedra with an empty sphere."""
    return rounded(alpha.volumes(_events(spark, d), "inst", 0.08))


@query("pipeline_scene_traits")
def scene_pipeline(spark, d):
    """Ground off, clusters, clean-up and traits of all scenes in one run."""
    e = _events(spark, d)
    above = cut(ground.without_ground(e, "terrain", cell=0.5))
    found = clusters.dbscan(above, 0.15, 5)
    final = post_stages(found, 5, 8, 0.2)
    return rounded(traits.spans(final, "label").join(traits.heights(final, "label"), ["scene_id", "label"]))
