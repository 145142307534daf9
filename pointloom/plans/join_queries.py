"""Queries of spatial, interval, equi, semi and anti joins, of graphs and of proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import blocks, boxes, graph, sampling, spatial
from pointloom.views import view

from .point_queries import _D2, _D3, rounded
from .registry import query

_NEAR = """
n AS (SELECT a.scene_id, a.point_id AS left_id, b.point_id AS right_id, {d} AS distance,
  row_number() OVER (PARTITION BY a.point_id ORDER BY {d}, b.point_id) AS rank
  FROM event_points a JOIN event_points b ON a.scene_id = b.scene_id {on})"""


@query("jn1_nearest_join", f"WITH {_NEAR.format(d=_D3, on='AND b.inst >= 3').strip()} SELECT scene_id, left_id, right_id, round(distance, 6) AS distance FROM n WHERE rank = 1")
def jn1(spark, d):
    e = view(spark, d, "event_points")
    return rounded(spatial.nearest_join(e, e.where("inst >= 3"), 0.4))


@query("jn2_nearest_within", f"""
WITH {_NEAR.format(d=_D3, on="AND b.inst >= 3").strip()}
SELECT scene_id, left_id, right_id, round(distance, 6) AS distance FROM n WHERE rank = 1 AND distance < 0.08""")
def jn2(spark, d):
    e = view(spark, d, "event_points")
    return rounded(spatial.nearest_within(e, e.where("inst >= 3"), 0.08))


@query("jn3_back_mapping", """
WITH l AS (SELECT scene_id, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM points GROUP BY ALL),
c AS (SELECT p.scene_id, p.point_id, p.gt_inst, floor((x - x0) / 0.2) AS ix, floor((y - y0) / 0.2) AS iy, floor((z - z0) / 0.2) AS iz FROM points p JOIN l ON p.scene_id = l.scene_id),
v AS (SELECT scene_id, ix, iy, iz, arg_min(gt_inst, point_id) AS inst FROM c GROUP BY ALL)
SELECT c.scene_id, count(*) AS n, count(*) FILTER (inst = gt_inst) AS same FROM c JOIN v ON c.scene_id = v.scene_id AND c.ix = v.ix AND c.iy = v.iy AND c.iz = v.iz GROUP BY ALL""")
def jn3(spark, d):
    p = view(spark, d, "points")
    low = p.groupBy("scene_id").agg(*[F.min(c).alias(f"_{c}") for c in "xyz"])
    placed = p.join(low, "scene_id").withColumns({f"i{c}": F.floor((F.col(c) - F.col(f"_{c}")) / 0.2) for c in "xyz"}).select("scene_id", "point_id", "gt_inst", "ix", "iy", "iz")
    back = placed.join(sampling.voxels(p, 0.2).select("scene_id", "ix", "iy", "iz", "instance"), ["scene_id", "ix", "iy", "iz"])
    return back.groupBy("scene_id").agg(F.count("*").alias("n"), F.count_if(F.col("instance") == F.col("gt_inst")).alias("same"))


@query("jn4_knn_join", f"WITH {_NEAR.format(d=_D3, on='').strip()} SELECT scene_id, left_id, round(avg(distance), 6) AS mean, round(max(distance), 6) AS far, count(*) AS n FROM n WHERE rank <= 5 GROUP BY ALL")
def jn4(spark, d):
    e = view(spark, d, "event_points")
    near = blocks.neighbour_lists(e, e, 5)
    return rounded(near.select("scene_id", "left_id", blocks.mean_distance().alias("mean"), F.array_max("found.distance").alias("far"), F.size("found").cast("long").alias("n")))


@query("jn4_knn_interpolation", f"""
WITH {_NEAR.format(d=_D3, on="AND b.inst >= 3").strip()}
SELECT n.scene_id, left_id, round(sum(e.z / (distance + 1e-8)) / sum(1.0 / (distance + 1e-8)), 6) AS z FROM n JOIN event_points e ON e.point_id = right_id WHERE rank <= 3 GROUP BY ALL""")
def jn4b(spark, d):
    """Inverse-distance interpolation from the three nearest, as decoders of point networks use it."""
    e = view(spark, d, "event_points")
    near = spatial.knn_join(e, e.where("inst >= 3").withColumn("value", F.col("z")), 3, 0.4, extra=("value",))
    w = 1.0 / (F.col("distance") + 1e-8)
    return rounded(near.groupBy("scene_id", "left_id").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("z")))


@query("jn5_radius_join", f"SELECT a.scene_id, count(*) AS pairs, round(sum({_D3}), 4) AS distance FROM event_points a JOIN event_points b ON a.scene_id = b.scene_id AND {_D3} < 0.1 GROUP BY ALL")
def jn5(spark, d):
    e = view(spark, d, "event_points")
    both = spatial.position_pairs(spatial.positions(e), 0.1).withColumn("n", 2 * F.col("a.n") * F.col("b.n")).select("scene_id", "n", "distance")
    own = spatial.positions(e).select("scene_id", (F.col("n") * F.col("n")).alias("n"), F.lit(0.0).alias("distance"))
    return rounded(both.unionByName(own).groupBy("scene_id").agg(F.sum("n").alias("pairs"), F.sum(F.col("n") * F.col("distance")).alias("distance")), 4)


@query("jn6_ball_query", f"""
SELECT a.scene_id, a.point_id AS left_id, count(*) AS n FROM points a JOIN points b ON a.scene_id = b.scene_id
AND b.x BETWEEN a.x - 0.06 AND a.x + 0.06 AND {_D3} < 0.05 GROUP BY ALL""")
def jn6(spark, d):
    p = view(spark, d, "points")
    return spatial.neighbour_counts(p, 0.05).groupBy("scene_id", F.col("point_id").alias("left_id")).agg(F.sum("neighbours").alias("n"))


@query("jn7_batched_ball_query", f"""
SELECT a.scene_id, a.inst, count(*) AS pairs FROM event_points a JOIN event_points b ON a.scene_id = b.scene_id AND a.inst = b.inst AND {_D3} < 0.2 GROUP BY ALL""")
def jn7(spark, d):
    e = view(spark, d, "event_points")
    counted = spatial.neighbour_counts(e, 0.2, ("scene_id", "inst"))
    return counted.groupBy("scene_id", "inst").agg(F.sum("neighbours").alias("pairs"))


@query("jn8_point_in_tile", """
WITH l AS (SELECT scene_id, min(x) AS x0, min(y) AS y0 FROM event_points GROUP BY ALL)
SELECT e.scene_id, CAST(i.i AS INT) AS tile_x, CAST(j.j AS INT) AS tile_y, count(*) AS n FROM event_points e JOIN l ON e.scene_id = l.scene_id
JOIN range(0, 1000) i(i) ON x - x0 >= i.i * 1.0 AND x - x0 < i.i * 1.0 + 2.0 AND i.i <= floor((SELECT max(x) - min(x) FROM event_points f WHERE f.scene_id = e.scene_id) / 1.0)
JOIN range(0, 100) j(j) ON y - y0 >= j.j * 1.0 AND y - y0 < j.j * 1.0 + 2.0 AND j.j <= floor((SELECT max(y) - min(y) FROM event_points f WHERE f.scene_id = e.scene_id) / 1.0) GROUP BY ALL""")
def jn8(spark, d):
    return spatial.tiles(view(spark, d, "event_points"), 2.0, 1.0).groupBy("scene_id", "tile_x", "tile_y").agg(F.count("*").alias("n"))


@query("jn9_voxel_maps", """
WITH v AS (SELECT scene_id, CAST(floor(x / 0.25) AS BIGINT) AS ix, CAST(floor(y / 0.25) AS BIGINT) AS iy, CAST(floor(z / 0.25) AS BIGINT) AS iz, avg(r) AS f, count(*) AS n FROM points GROUP BY 1, 2, 3, 4)
SELECT p.scene_id, round(sum(abs(p.r - v.f)), 6) AS spread, CAST(sum(v.n) AS BIGINT) AS n FROM points p JOIN v ON p.scene_id = v.scene_id
AND floor(p.x / 0.25) = v.ix AND floor(p.y / 0.25) = v.iy AND floor(p.z / 0.25) = v.iz GROUP BY ALL""")
def jn9(spark, d):
    placed = spatial.cells(view(spark, d, "points"), 0.25)
    keys = ["scene_id", "ix", "iy", "iz"]
    back = placed.join(placed.groupBy(*keys).agg(F.avg("r").alias("f"), F.count("*").alias("n")), keys)
    return rounded(back.groupBy("scene_id").agg(F.sum(F.abs(F.col("r") - F.col("f"))).alias("spread"), F.sum("n").alias("n")))


@query("jn10_contingency", "SELECT scene_id, pred_inst AS pred, gt_inst AS gt, count(*) AS n FROM points GROUP BY ALL")
def jn10(spark, d):
    p = view(spark, d, "points")
    pred, gt = p.select("scene_id", "point_id", F.col("pred_inst").alias("pred")), p.select("scene_id", "point_id", F.col("gt_inst").alias("gt"))
    if p.count() != p.select("point_id").distinct().count():  # ids that repeat can't be joined one to one
        return p.groupBy("scene_id", F.col("pred_inst").alias("pred"), F.col("gt_inst").alias("gt")).agg(F.count("*").alias("n"))
    return pred.join(gt, ["scene_id", "point_id"]).groupBy("scene_id", "pred", "gt").agg(F.count("*").alias("n"))


_OVER = """
s AS (SELECT scene_id, proposal_id, count(*) AS n FROM proposals GROUP BY ALL),
o AS (SELECT a.scene_id, a.proposal_id AS a, b.proposal_id AS b, count(*) AS shared FROM proposals a JOIN proposals b
  ON a.scene_id = b.scene_id AND a.point_id = b.point_id AND a.proposal_id < b.proposal_id GROUP BY ALL),
i AS (SELECT o.*, x.n AS n_a, y.n AS n_b, shared / CAST(x.n + y.n - shared AS DOUBLE) AS iou, shared / CAST(least(x.n, y.n) AS DOUBLE) AS of_smaller
  FROM o JOIN s x ON x.scene_id = o.scene_id AND x.proposal_id = a JOIN s y ON y.scene_id = o.scene_id AND y.proposal_id = b)"""


@query("jn11_proposal_overlaps", f"WITH {_OVER.strip()} SELECT scene_id, a, b, shared, n_a, n_b, round(iou, 6) AS iou, round(of_smaller, 6) AS of_smaller FROM i")
def jn11(spark, d):
    return rounded(graph.overlaps(view(spark, d, "proposals")))


_BOX = "SELECT scene_id, gt_inst, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*) AS n FROM points GROUP BY ALL"


def _boxes(spark, d):
    ends = [f(c).alias(f"{c}{k}") for c in "xyz" for f, k in ((F.min, 0), (F.max, 1))]
    return view(spark, d, "points").groupBy("scene_id", "gt_inst").agg(*ends, *[F.avg(c).alias(f"c{c}") for c in "xyz"], F.count("*").alias("n"))


@query("jn12_box_overlap", f"""
WITH q AS ({_BOX}) SELECT a.scene_id, a.gt_inst AS a, b.gt_inst AS b FROM q a JOIN q b ON a.scene_id = b.scene_id AND a.gt_inst < b.gt_inst
AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND a.z0 <= b.z1 AND b.z0 <= a.z1""")
def jn12(spark, d):
    met = boxes.box_pairs(_boxes(spark, d), "gt_inst")
    return met.select("scene_id", F.col("a.gt_inst").alias("a"), F.col("b.gt_inst").alias("b"))


@query("jn13_cluster_pairs", f"""
WITH q AS ({_BOX}) SELECT a.scene_id, a.gt_inst AS a, b.gt_inst AS b, round(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)), 6) AS distance FROM q a JOIN q b
ON a.scene_id = b.scene_id AND a.gt_inst < b.gt_inst AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) <= 0.2
AND sqrt(power(greatest(a.x1, b.x1) - least(a.x0, b.x0), 2) + power(greatest(a.y1, b.y1) - least(a.y0, b.y0), 2) + power(greatest(a.z1, b.z1) - least(a.z0, b.z0), 2)) <= 4.5""")
def jn13(spark, d):
    q = _boxes(spark, d)
    ends = [f"{c}{k}" for c in "xyz" for k in "01"]
    centres = q.select("scene_id", F.col("gt_inst").alias("point_id"), *[F.col(f"c{c}").alias(c) for c in "xyz"], F.struct(*ends).alias("box"))
    near = spatial.radius_join(centres, centres.withColumnRenamed("box", "box2"), 0.2, "xy", ("box2",), ("box",), closed=True).where("left_id < right_id")
    whole = spatial.length(*[F.greatest(f"box.{c}1", f"box2.{c}1") - F.least(f"box.{c}0", f"box2.{c}0") for c in "xyz"])
    return rounded(near.where(whole <= 4.5).select("scene_id", F.col("left_id").alias("a"), F.col("right_id").alias("b"), "distance"))


@query("jn15_nearest_centroid", f"""
WITH q AS ({_BOX}), t AS (SELECT p.scene_id, p.point_id, q.gt_inst, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS d FROM points p JOIN q ON p.scene_id = q.scene_id)
SELECT scene_id, gt_inst, count(*) AS n FROM (SELECT * FROM t WHERE d < 0.8 QUALIFY row_number() OVER (PARTITION BY scene_id, point_id ORDER BY d, gt_inst) = 1) GROUP BY ALL""")
def jn15(spark, d):
    p, q = view(spark, d, "points"), _boxes(spark, d).select("scene_id", F.col("gt_inst").alias("point_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    best = spatial.nearest_join(p, q, 1.0).where("distance < 0.8")
    return best.groupBy("scene_id", F.col("right_id").alias("gt_inst")).agg(F.count("*").alias("n"))


_PAIR = """
b AS (SELECT model, clustering, scene_id, plant_id, avg(metric) AS m FROM results WHERE refinement = 'base' GROUP BY ALL),
f AS (SELECT model, clustering, scene_id, plant_id, avg(metric) AS m FROM results WHERE refinement = 'refined' GROUP BY ALL)"""


def paired(spark, d, *keys):
    r = view(spark, d, "results")
    side = lambda name: r.where(F.col("refinement") == name).groupBy(*keys).agg(F.avg("metric").alias(name))
    return side("base"), side("refined")


@query("jn16_paired_self_join", f"WITH {_PAIR.strip()} SELECT model, clustering, scene_id, plant_id, round(f.m - b.m, 4) AS delta FROM b JOIN f USING (model, clustering, scene_id, plant_id)")
def jn16(spark, d):
    keys = ["model", "clustering", "scene_id", "plant_id"]
    base, refined = paired(spark, d, *keys)
    return rounded(base.join(refined, keys).withColumn("delta", F.col("refined") - F.col("base")).select(*keys, "delta"), 4)


@query("jn17_registry_left_join", """
WITH reg AS (SELECT scene_id, gt_inst, count(*) AS gt_points FROM points WHERE gt_inst > 0 GROUP BY ALL),
m AS (SELECT scene_id, gt_inst, count(*) AS n FROM points WHERE gt_inst > 0 AND base_inst = gt_inst AND base_inst > 3 GROUP BY ALL)
SELECT reg.scene_id, reg.gt_inst, gt_points, coalesce(n, 0) AS matched, m.gt_inst AS pred FROM reg LEFT JOIN m ON reg.scene_id = m.scene_id AND reg.gt_inst = m.gt_inst""")
def jn17(spark, d):
    p = view(spark, d, "points").where("gt_inst > 0")
    reg = p.groupBy("scene_id", "gt_inst").agg(F.count("*").alias("gt_points"))
    m = p.where("base_inst = gt_inst AND base_inst > 3").groupBy("scene_id", "gt_inst").agg(F.count("*").alias("n")).withColumn("pred", F.col("gt_inst"))
    return reg.join(m, ["scene_id", "gt_inst"], "left").select("scene_id", "gt_inst", "gt_points", F.coalesce("n", F.lit(0)).alias("matched"), "pred")


@query("jn18_coverage_anti_join", "SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def jn18(spark, d):
    orders, lines = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left_anti").select(F.col("o_orderkey").alias("run_id"))


@query("jn19_scene_allow_list", "SELECT scene_id, count(*) AS n FROM results WHERE scene_id IN (SELECT DISTINCT CAST(l_suppkey % 6 AS INT) FROM lineitem) GROUP BY ALL")
def jn19(spark, d):
    allowed = view(spark, d, "points").select(F.col("scene_id").cast("int").alias("scene_id")).distinct()
    return view(spark, d, "results").join(allowed, "scene_id", "left_semi").groupBy("scene_id").agg(F.count("*").alias("n"))


@query("jn20_label_repair", f"""
WITH {_NEAR.format(d=_D3, on="AND b.inst >= 3 AND a.inst < 3").strip()}
SELECT e.scene_id, coalesce(s.inst, e.inst) AS inst, count(*) AS n FROM event_points e LEFT JOIN (SELECT left_id, right_id FROM n WHERE rank = 1) k ON k.left_id = e.point_id
LEFT JOIN event_points s ON s.point_id = k.right_id GROUP BY ALL""")
def jn20(spark, d):
    e = view(spark, d, "event_points")
    near = spatial.nearest_join(e.where("inst < 3"), e.where("inst >= 3").withColumn("to", F.col("inst")), 0.4, extra=("to",))
    fixed = e.join(near.select("scene_id", F.col("left_id").alias("point_id"), "to"), ["scene_id", "point_id"], "left")
    return fixed.groupBy("scene_id", F.coalesce("to", "inst").alias("inst")).agg(F.count("*").alias("n"))


@query("jn21_sweep_grid", """
SELECT s.scene_id, g.t / 10.0 :: DOUBLE AS threshold, count(*) FILTER (p.r > g.t / 100.0) AS kept FROM points p JOIN (SELECT DISTINCT scene_id FROM points) s ON p.scene_id = s.scene_id, range(0, 9) g(t) GROUP BY ALL""")
def jn21(spark, d):
    p = view(spark, d, "points").groupBy("scene_id", "r").agg(F.count("*").alias("n"))  # the sweep needs counts of values only
    grid = spark.range(9).select((F.col("id") / 10.0).alias("threshold"), (F.col("id") / 100.0).alias("_t"))
    swept = p.join(F.broadcast(grid))  # nine rows
    return swept.groupBy("scene_id", "threshold").agg(F.coalesce(F.sum(F.when(F.col("r") > F.col("_t"), F.col("n"))), F.lit(0)).alias("kept"))


_CC = """
WITH RECURSIVE {head},
e AS (SELECT scene_id, a AS u, b AS v FROM i WHERE {test} UNION ALL SELECT scene_id, b, a FROM i WHERE {test}),
cc(scene_id, node, component) USING KEY (scene_id, node) AS (
  SELECT scene_id, proposal_id, proposal_id FROM s
  UNION
  SELECT e.scene_id, e.u, min(c.component) FROM e JOIN cc c ON c.scene_id = e.scene_id AND c.node = e.v
  JOIN recurring.cc o ON o.scene_id = e.scene_id AND o.node = e.u WHERE c.component < o.component GROUP BY e.scene_id, e.u)"""


@query("gp1_components", _CC.format(head=_OVER.strip(), test="iou >= 0.12").strip() + " SELECT scene_id, node, component FROM cc")
def gp1(spark, d):
    p = view(spark, d, "proposals")
    pairs = graph.overlaps(p).where("iou >= 0.12").select("scene_id", F.col("a").alias("u"), F.col("b").alias("v"))
    alone = p.select("scene_id", F.col("proposal_id").alias("u"), F.col("proposal_id").alias("v")).distinct()
    return graph.components(pairs.unionByName(alone))


@query("gp3_greedy_nms")
def gp3(spark, d):
    return graph.suppressed(view(spark, d, "proposals"), view(spark, d, "scores").where("score > 0.1"), 0.12)


@query("gp3_highest_score_points", """
SELECT p.scene_id, p.point_id, p.proposal_id FROM proposals p JOIN scores s ON p.scene_id = s.scene_id AND p.proposal_id = s.proposal_id
QUALIFY row_number() OVER (PARTITION BY p.scene_id, p.point_id ORDER BY score DESC, p.proposal_id) = 1""")
def gp3b(spark, d):
    return graph.assigned_by_score(view(spark, d, "proposals"), view(spark, d, "scores"))


@query("gp4_greedy_cover")
def gp4(spark, d):
    return graph.greedy_cover(view(spark, d, "proposals"), view(spark, d, "scores")).groupBy("scene_id", "proposal_id").agg(F.count("*").alias("points"))


@query("gp5_cross_block_union", _CC.format(head=_OVER.strip(), test="iou >= 0.14 OR of_smaller >= 0.3").strip() + """
SELECT cc.scene_id, component AS proposal_id, count(DISTINCT p.point_id) AS points, max(score) AS score FROM cc JOIN proposals p ON p.scene_id = cc.scene_id AND p.proposal_id = cc.node
JOIN scores q ON q.scene_id = cc.scene_id AND q.proposal_id = cc.node GROUP BY ALL""")
def gp5(spark, d):
    points, best = graph.merged(view(spark, d, "proposals"), view(spark, d, "scores"), 0.14, 0.3)
    return points.groupBy("scene_id", "proposal_id").agg(F.count("*").alias("points")).join(best, ["scene_id", "proposal_id"])


@query("gp5_union_then_nms")
def gp5b(spark, d):
    points, best = graph.merged(view(spark, d, "proposals"), view(spark, d, "scores"), 0.14, 0.3)
    kept = graph.suppressed(points, best, 0.3)
    won = graph.assigned_by_score(points.join(kept.select("scene_id", "proposal_id"), ["scene_id", "proposal_id"], "left_semi"), kept)
    return won.groupBy("scene_id", "proposal_id").agg(F.count("*").alias("points"))


@query("gp6_union_by_appearance", _CC.format(head=_OVER.strip(), test="iou >= 0.14").strip() + """
SELECT DISTINCT scene_id, component, CAST(dense_rank() OVER (PARTITION BY scene_id ORDER BY component) AS INT) AS instance FROM cc""")
def gp6(spark, d):
    from pointloom.operators.labels import renumbered

    points, _ = graph.merged(view(spark, d, "proposals"), view(spark, d, "scores"), 0.14)
    found = points.select("scene_id", F.col("proposal_id").alias("component")).distinct()
    return renumbered(found.withColumn("instance", F.col("component")), "instance", 1)


@query("gp7_proposal_gt_iou", """
WITH g AS (SELECT DISTINCT scene_id, point_id, point_id % 9 AS gt FROM proposals), s AS (SELECT scene_id, proposal_id, count(*) AS n FROM proposals GROUP BY ALL),
t AS (SELECT scene_id, gt, count(*) AS n FROM g GROUP BY ALL)
SELECT p.scene_id, p.proposal_id, g.gt, round(count(*) / (s.n + t.n - count(*) + 1e-5), 6) AS iou FROM proposals p JOIN g ON p.scene_id = g.scene_id AND p.point_id = g.point_id
JOIN s ON s.scene_id = p.scene_id AND s.proposal_id = p.proposal_id JOIN t ON t.scene_id = g.scene_id AND t.gt = g.gt GROUP BY p.scene_id, p.proposal_id, g.gt, s.n, t.n""")
def gp7(spark, d):
    return rounded(_proposal_iou(spark, d).select("scene_id", "proposal_id", "gt", "iou"))


def _proposal_iou(spark, d):
    p = view(spark, d, "proposals")
    g = p.select("scene_id", "point_id").distinct().withColumn("gt", F.col("point_id") % 9)
    both = p.join(g, ["scene_id", "point_id"]).groupBy("scene_id", "proposal_id", "gt").agg(F.count("*").alias("n"))
    sizes = p.groupBy("scene_id", "proposal_id").agg(F.count("*").alias("_p"))
    truth = g.groupBy("scene_id", "gt").agg(F.count("*").alias("_g"))
    out = both.join(sizes, ["scene_id", "proposal_id"]).join(truth, ["scene_id", "gt"])
    return out.withColumn("iou", F.col("n") / (F.col("_p") + F.col("_g") - F.col("n") + 1e-5))


@query("gp8_mask_labels", """
WITH g AS (SELECT DISTINCT scene_id, point_id, point_id % 9 AS gt FROM proposals), s AS (SELECT scene_id, proposal_id, count(*) AS n FROM proposals GROUP BY ALL),
t AS (SELECT scene_id, gt, count(*) AS n FROM g GROUP BY ALL),
i AS (SELECT p.scene_id, p.proposal_id, g.gt, count(*) / (s.n + t.n - count(*) + 1e-5) AS iou FROM proposals p JOIN g ON p.scene_id = g.scene_id AND p.point_id = g.point_id
JOIN s ON s.scene_id = p.scene_id AND s.proposal_id = p.proposal_id JOIN t ON t.scene_id = g.scene_id AND t.gt = g.gt GROUP BY p.scene_id, p.proposal_id, g.gt, s.n, t.n),
b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY scene_id, proposal_id ORDER BY iou DESC, gt) = 1)
SELECT p.scene_id, p.proposal_id, CAST(sum(CASE WHEN b.iou < 0.11 THEN -1 WHEN g.gt = b.gt THEN 1 ELSE 0 END) AS BIGINT) AS mask_sum
FROM proposals p JOIN g ON p.scene_id = g.scene_id AND p.point_id = g.point_id JOIN b ON b.scene_id = p.scene_id AND b.proposal_id = p.proposal_id GROUP BY ALL""")
def gp8(spark, d):
    best = _proposal_iou(spark, d).groupBy("scene_id", "proposal_id").agg(F.min(F.struct((-F.col("iou")).alias("i"), "gt")).alias("b"))
    best = best.select("scene_id", "proposal_id", (-F.col("b.i")).alias("iou"), F.col("b.gt").alias("best"))
    masks = view(spark, d, "proposals").withColumn("gt", F.col("point_id") % 9).join(best, ["scene_id", "proposal_id"])
    mask = F.when(F.col("iou") < 0.11, -1).when(F.col("gt") == F.col("best"), 1).otherwise(0)
    return masks.groupBy("scene_id", "proposal_id").agg(F.sum(mask).alias("mask_sum"))


@query("gp9_proposal_assignment", """
WITH g AS (SELECT DISTINCT scene_id, point_id, point_id % 9 AS gt FROM proposals), s AS (SELECT scene_id, proposal_id, count(*) AS n FROM proposals GROUP BY ALL),
t AS (SELECT scene_id, gt, count(*) AS n FROM g GROUP BY ALL),
i AS (SELECT p.scene_id, p.proposal_id, g.gt, count(*) / (s.n + t.n - count(*) + CAST('1e-5' AS DOUBLE)) AS iou FROM proposals p JOIN g ON p.scene_id = g.scene_id AND p.point_id = g.point_id
  JOIN s ON s.scene_id = p.scene_id AND s.proposal_id = p.proposal_id JOIN t ON t.scene_id = g.scene_id AND t.gt = g.gt GROUP BY p.scene_id, p.proposal_id, g.gt, s.n, t.n),
b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY scene_id, proposal_id ORDER BY iou DESC, gt) = 1),
l AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY scene_id, gt ORDER BY iou DESC, proposal_id) = 1),
m AS (SELECT scene_id, proposal_id, max(gt) AS low FROM l GROUP BY ALL)
SELECT b.scene_id, b.proposal_id, coalesce(low, CASE WHEN iou >= 0.11 THEN gt END) AS gt FROM b LEFT JOIN m ON m.scene_id = b.scene_id AND m.proposal_id = b.proposal_id""")
def gp9(spark, d):
    """The best true instance of each proposal at or above 0.11, and for every instance its best proposal whatever the IoU."""
    i = _proposal_iou(spark, d)
    best = i.groupBy("scene_id", "proposal_id").agg(F.min(F.struct((-F.col("iou")).alias("i"), "gt")).alias("b"))
    best = best.select("scene_id", "proposal_id", F.when(-F.col("b.i") >= 0.11, F.col("b.gt")).alias("gt"))
    low = i.groupBy("scene_id", "gt").agg(F.min(F.struct((-F.col("iou")).alias("i"), "proposal_id")).alias("b")).select("scene_id", F.col("b.proposal_id").alias("proposal_id"), F.col("gt").alias("low"))
    low = low.groupBy("scene_id", "proposal_id").agg(F.max("low").alias("low"))
    return best.join(low, ["scene_id", "proposal_id"], "left").select("scene_id", "proposal_id", F.coalesce("low", "gt").alias("gt"))


@query("gp10_instances_from_scores", """
WITH s AS (SELECT scene_id, proposal_id, count(*) AS n FROM proposals GROUP BY ALL)
SELECT s.scene_id, s.proposal_id, n, round(score * least(1.0, greatest(0.0, n / 100.0)), 6) AS confidence FROM s JOIN scores q ON s.scene_id = q.scene_id AND s.proposal_id = q.proposal_id WHERE n >= 30 AND score > 0.1""")
def gp10(spark, d):
    s = view(spark, d, "proposals").groupBy("scene_id", "proposal_id").agg(F.count("*").alias("n"))
    out = s.join(view(spark, d, "scores"), ["scene_id", "proposal_id"]).where("n >= 30 AND score > 0.1")
    return rounded(out.select("scene_id", "proposal_id", "n", (F.col("score") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("n") / 100.0))).alias("confidence")))


@query("gp11_panoptic_fusion")
def gp11(spark, d):
    """From the best score down, a proposal whose taken share is small pastes its free points."""
    return graph.greedy_cover(view(spark, d, "proposals"), view(spark, d, "scores"), 0.3).groupBy("scene_id").agg(F.count_distinct("proposal_id").alias("segments"), F.count("*").alias("points"))


@query("gp12_proposal_voxelisation", """
WITH p AS (SELECT p.scene_id, p.gt_inst, x, y, z FROM points p), b AS (SELECT scene_id, gt_inst, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM p GROUP BY ALL),
k AS (SELECT *, least(50.0, 1.0 / greatest(greatest(x1 - x0, y1 - y0, z1 - z0) / 14.0, 1e-9) - 0.01) AS scale FROM b)
SELECT scene_id, gt_inst, count(DISTINCT (floor((x - x0) * scale), floor((y - y0) * scale), floor((z - z0) * scale))) AS cells, round(max(scale), 6) AS scale
FROM p JOIN k USING (scene_id, gt_inst) GROUP BY ALL""")
def gp12(spark, d):
    p = view(spark, d, "points")
    b = p.groupBy("scene_id", "gt_inst").agg(*[f(c).alias(f"{c}{k}") for c in "xyz" for f, k in ((F.min, 0), (F.max, 1))])
    extent = F.greatest(*[F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"])
    b = b.withColumn("scale", F.least(F.lit(50.0), 1.0 / F.greatest(extent / 14.0, F.lit(1e-9)) - 0.01))
    placed = p.join(b, ["scene_id", "gt_inst"]).withColumns({f"i{c}": F.floor((F.col(c) - F.col(f"{c}0")) * F.col("scale")) for c in "xyz"})
    return rounded(placed.groupBy("scene_id", "gt_inst").agg(F.count_distinct("ix", "iy", "iz").alias("cells"), F.max("scale").alias("scale")))
