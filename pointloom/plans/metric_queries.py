"""Queries of aggregates, windows, orders, sets, functions, metrics and experiment statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.functions import rle
from pointloom.operators import match, statistics
from pointloom.views import view

from .point_queries import rounded
from .registry import query


@query("ag1_label_statistics", """
SELECT scene_id, gt_inst, count(*) AS n, round(sum(r), 6) AS sum, round(avg(r), 6) AS mean, round(min(r), 6) AS least, round(max(r), 6) AS most FROM points GROUP BY ALL""")
def ag1(spark, d):
    p = view(spark, d, "points")
    return rounded(p.groupBy("scene_id", "gt_inst").agg(F.count("*").alias("n"), F.sum("r").alias("sum"), F.avg("r").alias("mean"), F.min("r").alias("least"), F.max("r").alias("most")))


@query("ag2_segment_reduce", """
SELECT p.scene_id, p.proposal_id, round(avg(f), 6) AS mean, min(f) AS least, max(f) AS most FROM (SELECT *, (point_id % 17) / 17.0 :: DOUBLE AS f FROM proposals) p GROUP BY ALL""")
def ag2(spark, d):
    p = view(spark, d, "proposals").withColumn("f", (F.col("point_id") % 17) / F.lit(17.0))
    return p.groupBy("scene_id", "proposal_id").agg(F.round(F.avg("f"), 6).alias("mean"), F.min("f").alias("least"), F.max("f").alias("most"))


@query("ag3_voxel_reduce", """
SELECT scene_id, CAST(floor(x / 0.3) AS BIGINT) AS ix, CAST(floor(y / 0.3) AS BIGINT) AS iy, round(sum(r), 6) AS sum, round(avg(r), 6) AS mean, arg_min(r, point_id) AS front, arg_max(r, point_id) AS back FROM points GROUP BY 1, 2, 3""")
def ag3(spark, d):
    p = view(spark, d, "points").withColumns({"ix": F.floor(F.col("x") / 0.3), "iy": F.floor(F.col("y") / 0.3)})
    one = lambda f: f(F.struct("point_id", "r"))["r"]
    return p.groupBy("scene_id", "ix", "iy").agg(F.round(F.sum("r"), 6).alias("sum"), F.round(F.avg("r"), 6).alias("mean"), one(F.min).alias("front"), one(F.max).alias("back"))


@query("ag4_pooling", """
SELECT p.scene_id, p.proposal_id, round(avg(f), 6) AS mean, max(f) AS most, arg_max(point_id, f * 1000000 - point_id) AS most_at FROM (SELECT *, (point_id * 7 % 31) AS f FROM proposals) p GROUP BY ALL""")
def ag4(spark, d):
    p = view(spark, d, "proposals").withColumn("f", F.col("point_id") * 7 % 31)
    best = F.max(F.struct("f", (-F.col("point_id")).alias("i")))
    return p.groupBy("scene_id", "proposal_id").agg(F.round(F.avg("f"), 6).alias("mean"), F.max("f").alias("most"), (-best["i"]).alias("most_at"))


@query("ag5_percentiles", """
SELECT scene_id, round(quantile_cont(x, 0.01), 6) AS p1, round(median(x), 6) AS p50, round(quantile_cont(x, 0.99), 6) AS p99,
  (SELECT round(median(abs(q.x - m.m)), 6) FROM points q, (SELECT median(x) AS m FROM points r WHERE r.scene_id = p.scene_id) m WHERE q.scene_id = p.scene_id) AS mad FROM points p GROUP BY scene_id""")
def ag5(spark, d):
    p = view(spark, d, "points")
    q = p.groupBy("scene_id").agg(*[F.percentile("x", F.lit(s)).alias(n) for s, n in ((0.01, "p1"), (0.5, "p50"), (0.99, "p99"))])
    mad = p.join(q, "scene_id").groupBy("scene_id").agg(F.median(F.abs(F.col("x") - F.col("p50"))).alias("mad"))
    return rounded(q.join(mad, "scene_id"))


@query("ag6_covariance", """
SELECT scene_id, gt_inst, round(var_samp(x), 8) AS xx, round(covar_samp(x, y), 8) AS xy, round(covar_samp(x, z), 8) AS xz, round(var_samp(y), 8) AS yy, round(covar_samp(y, z), 8) AS yz, round(var_samp(z), 8) AS zz FROM points GROUP BY ALL""")
def ag6(spark, d):
    pairs = [F.covar_samp(a, b).alias(a + b) if a != b else F.var_samp(a).alias(a + b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return rounded(view(spark, d, "points").groupBy("scene_id", "gt_inst").agg(*pairs), 8)


@query("ag7_majority_label", """
SELECT scene_id, ix, iy, gt_inst, n FROM (SELECT scene_id, CAST(floor(x / 0.3) AS BIGINT) AS ix, CAST(floor(y / 0.3) AS BIGINT) AS iy, gt_inst, count(*) AS n FROM points GROUP BY 1, 2, 3, 4)
QUALIFY row_number() OVER (PARTITION BY scene_id, ix, iy ORDER BY n DESC, gt_inst) = 1""")
def ag7(spark, d):
    p = view(spark, d, "points").withColumns({"ix": F.floor(F.col("x") / 0.3), "iy": F.floor(F.col("y") / 0.3)})
    counts = p.groupBy("scene_id", "ix", "iy", "gt_inst").agg(F.count("*").alias("n"))
    best = counts.groupBy("scene_id", "ix", "iy").agg(F.min(F.struct((-F.col("n")).alias("m"), "gt_inst")).alias("b"))
    return best.select("scene_id", "ix", "iy", F.col("b.gt_inst").alias("gt_inst"), (-F.col("b.m")).alias("n"))


@query("ag9_block_vote", """
SELECT scene_id, point_id, count(*) AS votes, count(*) FILTER (proposal_id % 3 = 0) AS plant, count(*) FILTER (proposal_id % 3 = 0) * 2 >= count(*) AS label, round(avg(proposal_id / 40.0), 8) AS mean FROM proposals GROUP BY ALL""")
def ag9(spark, d):
    plant = F.count_if(F.col("proposal_id") % 3 == 0)
    return view(spark, d, "proposals").groupBy("scene_id", "point_id").agg(F.count("*").alias("votes"), plant.alias("plant"), (plant * 2 >= F.count("*")).alias("label"), F.round(F.avg(F.col("proposal_id") / 40.0), 8).alias("mean"))


@query("ag10_confusion", """
WITH c AS (SELECT scene_id, count(*) FILTER (sem_pred = 1 AND sem_gt = 1) AS tp, count(*) FILTER (sem_pred = 1 AND sem_gt <> 1) AS fp, count(*) FILTER (sem_pred <> 1 AND sem_gt = 1) AS fn, count(*) FILTER (sem_pred <> 1 AND sem_gt <> 1) AS tn FROM points GROUP BY ALL)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp + fn, 0), 6) AS iou_1, round(tn / nullif(tn + fp + fn, 0), 6) AS iou_0,
  round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / (tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0)), 6) AS f1,
  round((tp / nullif(tp + fp + fn, 0) + tn / nullif(tn + fp + fn, 0)) / 2, 6) AS miou FROM c""")
def ag10(spark, d):
    return rounded(match.confusion(view(spark, d, "points"), "sem_pred", "sem_gt"))


@query("ag11_macro_micro", """
SELECT model, round(avg(v), 4) AS macro, round(sum(h) / sum(t), 6) AS micro, round(stddev_samp(v), 4) AS std FROM
(SELECT model, scene_id, avg(metric) AS v, count(*) FILTER (metric > 150) AS h, count(*) AS t FROM results GROUP BY ALL) GROUP BY ALL""")
def ag11(spark, d):
    rows = view(spark, d, "results").groupBy("model", "scene_id").agg(F.avg("metric").alias("v"), F.count_if(F.col("metric") > 150).alias("h"), F.count("*").alias("t"))
    out = statistics.macro_and_micro(rows, ["model"], "v", "h", "t")
    return out.select("model", F.round("macro", 4).alias("macro"), F.round("micro", 6).alias("micro"), F.round("std", 4).alias("std"))


@query("ag12_mean_and_std", "SELECT model, refinement, round(avg(metric), 4) AS mean, round(stddev_samp(metric), 4) AS std, round(stddev_pop(metric), 4) AS std_pop FROM results GROUP BY ALL")
def ag12(spark, d):
    return rounded(view(spark, d, "results").groupBy("model", "refinement").agg(F.avg("metric").alias("mean"), F.stddev_samp("metric").alias("std"), F.stddev_pop("metric").alias("std_pop")), 4)


@query("ag13_min_of_repeats", "SELECT scene_id, model, min(metric) AS best FROM results GROUP BY ALL")
def ag13(spark, d):
    return view(spark, d, "results").groupBy("scene_id", "model").agg(F.min("metric").alias("best"))


_SCENE = "b AS (SELECT model, clustering, scene_id, avg(metric) AS v FROM results WHERE refinement = 'base' GROUP BY ALL), f AS (SELECT model, clustering, scene_id, avg(metric) AS v FROM results WHERE refinement = 'refined' GROUP BY ALL)"


def _sides(spark, d, *keys):
    r = view(spark, d, "results")
    return tuple(r.where(F.col("refinement") == side).groupBy(*keys).agg(F.avg("metric").alias("value")) for side in ("base", "refined"))


@query("ag14_scene_gain_counts", f"""
WITH {_SCENE} SELECT model, clustering, count(*) FILTER (f.v - b.v > 1e-12) AS positive, count(*) FILTER (abs(f.v - b.v) <= 1e-12) AS equal, count(*) FILTER (f.v - b.v < -1e-12) AS negative,
  round(min(f.v - b.v), 4) AS least, round(max(f.v - b.v), 4) AS most, round(avg(f.v - b.v), 4) AS mean, coalesce(string_agg(CAST(scene_id AS VARCHAR), ',' ORDER BY scene_id) FILTER (f.v - b.v < -1e-12), '') AS lost
FROM b JOIN f USING (model, clustering, scene_id) GROUP BY ALL""")
def ag14(spark, d):
    keys = ["model", "clustering", "scene_id"]
    return rounded(statistics.gains(*_sides(spark, d, *keys), keys, ["model", "clustering"]), 4)


@query("ag15_distinct_counts", "SELECT scene_id, count(DISTINCT gt_inst) AS gt, count(DISTINCT pred_inst) AS pred, count(DISTINCT (gt_inst, pred_inst)) AS pairs FROM points GROUP BY ALL")
def ag15(spark, d):
    return view(spark, d, "points").groupBy("scene_id").agg(F.count_distinct("gt_inst").alias("gt"), F.count_distinct("pred_inst").alias("pred"), F.count_distinct("gt_inst", "pred_inst").alias("pairs"))


@query("ag16_histogram", """
WITH l AS (SELECT scene_id, min(x) AS lo, max(x) AS hi FROM event_points GROUP BY ALL)
SELECT e.scene_id, CAST(least(floor((x - lo) / ((hi - lo) / 15)), 14) AS INT) AS bin, count(*) AS n, count(*) FILTER (x < hi) AS digitized FROM event_points e JOIN l ON e.scene_id = l.scene_id GROUP BY ALL""")
def ag16(spark, d):
    """Counts by 15 bins; `digitized` leaves the largest value out, as binning by half-open edges does."""
    e = view(spark, d, "event_points")
    l = e.groupBy("scene_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = e.join(l, "scene_id").withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 15)), F.lit(14)).cast("int"))
    return b.groupBy("scene_id", "bin").agg(F.count("*").alias("n"), F.count_if(F.col("x") < F.col("hi")).alias("digitized"))


@query("ag17_outcome_histogram", "SELECT parts, count(*) AS n FROM (SELECT scene_id, proposal_id, count(*) // 10 AS parts FROM proposals GROUP BY ALL) GROUP BY ALL")
def ag17(spark, d):
    parts = view(spark, d, "proposals").groupBy("scene_id", "proposal_id").agg(F.floor(F.count("*") / 10).alias("parts"))
    return parts.groupBy("parts").agg(F.count("*").alias("n"))


@query("ag18_regression", """
SELECT scene_id, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, round(sqrt(avg((y - x) * (y - x))), 6) AS rmse FROM event_points GROUP BY ALL""")
def ag18(spark, d):
    return rounded(view(spark, d, "event_points").groupBy("scene_id").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.sqrt(F.avg((F.col("y") - F.col("x")) * (F.col("y") - F.col("x")))).alias("rmse")))


@query("ag19_class_weights", "SELECT sem_gt, round(1.0 / n / sum(1.0 / n) OVER (), 6) AS weight FROM (SELECT sem_gt, count(*) AS n FROM points GROUP BY ALL)")
def ag19(spark, d):
    c = view(spark, d, "points").groupBy("sem_gt").agg(F.count("*").alias("n"))
    total = c.agg(F.sum(1.0 / F.col("n")).alias("_all"))  # one row
    return c.join(F.broadcast(total)).select("sem_gt", F.round(1.0 / F.col("n") / F.col("_all"), 6).alias("weight"))


@query("ag20_pointwise_evaluation", """
WITH i AS (SELECT scene_id, gt_inst, avg(x) AS mx, avg(y) AS my FROM points WHERE gt_inst > 0 GROUP BY ALL)
SELECT p.scene_id, round(avg(abs(mx - x - 0.01) + abs(my - y + 0.01)), 6) AS offset_mae, round(100.0 * avg(CASE WHEN sem_pred = sem_gt THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM points p JOIN i ON p.scene_id = i.scene_id AND p.gt_inst = i.gt_inst GROUP BY ALL""")
def ag20(spark, d):
    p = view(spark, d, "points").where("gt_inst > 0")
    i = p.groupBy("scene_id", "gt_inst").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    gap = F.abs(F.col("mx") - F.col("x") - 0.01) + F.abs(F.col("my") - F.col("y") + 0.01)
    return rounded(p.join(i, ["scene_id", "gt_inst"]).groupBy("scene_id").agg(F.avg(gap).alias("offset_mae"), (F.avg(F.when(F.col("sem_pred") == F.col("sem_gt"), 1.0).otherwise(0.0)) * 100.0).alias("accuracy")))


_TRAITS = "SELECT scene_id, {l} AS inst, max(z) - min(z) AS height, max(x) - min(x) AS width, count(*) * 1.0 AS size FROM points WHERE {l} > 0 GROUP BY ALL"


@query("ag21_trait_errors", f"""
WITH p AS ({_TRAITS.format(l='pred_inst')}), g AS ({_TRAITS.format(l='gt_inst')}),
j AS (SELECT p.scene_id, p.inst, unnest(['height', 'width', 'size']) AS trait, unnest([p.height, p.width, p.size]) AS pred, unnest([g.height, g.width, g.size]) AS gt FROM p JOIN g ON p.scene_id = g.scene_id AND p.inst = g.inst)
SELECT trait, count(*) AS n, round(avg(abs(pred - gt)), 6) AS mae, round(avg(abs(pred - gt) / nullif(abs(gt), 0) * 100), 6) AS relative FROM j GROUP BY ALL""")
def ag21(spark, d):
    def side(label, name):
        p = view(spark, d, "points").where(F.col(label) > 0)
        return p.groupBy("scene_id", F.col(label).alias("inst")).agg((F.max("z") - F.min("z")).alias(f"{name}_height"), (F.max("x") - F.min("x")).alias(f"{name}_width"), (F.count("*") * 1.0).cast("double").alias(f"{name}_size"))

    pairs = side("pred_inst", "pred").join(side("gt_inst", "gt"), ["scene_id", "inst"])
    errors = statistics.trait_errors(pairs, ["height", "width", "size"], ["scene_id", "inst"])
    return rounded(errors.groupBy("trait").agg(F.count("*").alias("n"), F.avg("error").alias("mae"), F.avg("relative").alias("relative")))


# --- windows ---------------------------------------------------------------------------------------------------------


@query("wn1_best_gt", """
WITH c AS (SELECT scene_id, pred_inst AS pred, gt_inst AS gt, count(*) AS n FROM points GROUP BY ALL)
SELECT scene_id, pred, gt, n FROM c QUALIFY row_number() OVER (PARTITION BY scene_id, pred ORDER BY n DESC, gt) = 1""")
def wn1(spark, d):
    c = match.contingency(view(spark, d, "points"), "pred_inst", "gt_inst")
    return c.withColumn("_r", F.row_number().over(W.partitionBy("scene_id", "pred").orderBy(F.desc("n"), "gt"))).where("_r = 1").drop("_r")


@query("wn3_best_sweep_point", "SELECT model, clustering, scene_id, metric FROM results QUALIFY row_number() OVER (PARTITION BY model ORDER BY metric DESC, run_id) = 1")
def wn3(spark, d):
    best = view(spark, d, "results").groupBy("model").agg(F.min(F.struct((-F.col("metric")).alias("m"), "run_id", "clustering", "scene_id")).alias("b"))
    return best.select("model", "b.clustering", "b.scene_id", (-F.col("b.m")).alias("metric"))


_AP = """
s AS (SELECT scene_id, proposal_id, score, proposal_id % 3 > 0 AS hit FROM scores), t AS (SELECT unnest([1, 2]) AS threshold),
e AS (SELECT threshold, score, sum(CAST(hit AND proposal_id % (threshold + 3) > 0 AS INT)) AS hits, count(*) AS n FROM s, t GROUP BY ALL),
c AS (SELECT *, sum(hits) OVER (PARTITION BY threshold ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY threshold ORDER BY score DESC) AS seen FROM e),
p AS (SELECT *, tp / seen AS precision, tp / 200.0 AS recall FROM c),
m AS (SELECT *, max(precision) OVER (PARTITION BY threshold ORDER BY score ROWS UNBOUNDED PRECEDING) AS env, recall - coalesce(lag(recall) OVER (PARTITION BY threshold ORDER BY score DESC), 0) AS step FROM p)"""


@query("wn4_average_precision", f"WITH {_AP.strip()} SELECT threshold, round(sum(env * step), 6) AS ap FROM m GROUP BY ALL")
def wn4(spark, d):
    s = view(spark, d, "scores").withColumn("threshold", F.explode(F.array(F.lit(1), F.lit(2))))
    hit = (F.col("proposal_id") % 3 > 0) & (F.col("proposal_id") % (F.col("threshold") + 3) > 0)
    return rounded(match.average_precision(s.withColumn("hit", hit), 200))


@query("wn5_holm", """
WITH t AS (SELECT model, clustering, least(1.0, round(avg(metric) / 20000, 6)) AS p FROM results GROUP BY ALL),
r AS (SELECT *, (count(*) OVER (PARTITION BY model) - row_number() OVER (PARTITION BY model ORDER BY p) + 1) * p AS step FROM t)
SELECT model, clustering, p, round(least(1.0, max(step) OVER (PARTITION BY model ORDER BY p ROWS UNBOUNDED PRECEDING)), 6) AS holm FROM r""")
def wn5(spark, d):
    t = view(spark, d, "results").groupBy("model", "clustering").agg(F.least(F.lit(1.0), F.round(F.avg("metric") / 20000, 6)).alias("p"))
    return rounded(statistics.holm(t, ["model"]), 6, "holm")


_BINS = """
l AS (SELECT scene_id, min(x) AS lo, max(x) AS hi FROM event_points GROUP BY ALL),
h AS (SELECT e.scene_id, CAST(least(floor((x - lo) / ((hi - lo) / 15)), 14) AS INT) AS bin, count(*) AS n FROM event_points e JOIN l ON e.scene_id = l.scene_id GROUP BY ALL),
f AS (SELECT s.scene_id, CAST(b.b AS INT) AS bin, coalesce(n, 0) AS n FROM l s CROSS JOIN range(0, 15) b(b) LEFT JOIN h ON h.scene_id = s.scene_id AND h.bin = b.b),
w AS (SELECT k.k - 2 AS k, exp(-0.5 * ((k.k - 2) / 0.5) * ((k.k - 2) / 0.5)) AS w FROM range(0, 5) k(k)),
g AS (SELECT f.scene_id, f.bin, sum(o.n * w.w) / (SELECT sum(w) FROM w) AS v FROM f CROSS JOIN w JOIN f o ON o.scene_id = f.scene_id
  AND o.bin = CASE WHEN f.bin + k < 0 THEN -(f.bin + k) - 1 WHEN f.bin + k > 14 THEN 29 - (f.bin + k) ELSE f.bin + k END GROUP BY f.scene_id, f.bin)"""


def smoothed(spark, d):
    from pointloom.operators import refine

    e = view(spark, d, "event_points")
    return refine.profiles(e.select("scene_id", "x"), ["scene_id"], "x", 15, 0.5)


@query("wn6_gaussian_smoothing", f"WITH {_BINS.strip()} SELECT scene_id, bin, round(v, 6) AS v FROM g")
def wn6(spark, d):
    return rounded(smoothed(spark, d).select("scene_id", F.posexplode("smooth").alias("bin", "v")))


@query("wn7_peaks", f"""
WITH {_BINS.strip().replace("min(x)", "min(y)").replace("max(x)", "max(y)").replace("(x - lo)", "(y - lo)")},
p AS (SELECT scene_id, bin, v, lag(v) OVER w AS a, lead(v) OVER w AS b, max(v) OVER (PARTITION BY scene_id) AS m FROM g WINDOW w AS (PARTITION BY scene_id ORDER BY bin))
SELECT scene_id, bin FROM p WHERE v > a AND v > b AND v >= 0.1 * m""")
def wn7(spark, d):
    from pointloom.operators import refine

    shape = refine.profiles(view(spark, d, "event_points").select("scene_id", "y"), ["scene_id"], "y", 15, 0.5)
    return refine.with_peaks(shape, 2, 0.1).select("scene_id", F.explode("peaks").alias("bin"))


@query("wn8_valley", f"""
WITH {_BINS.strip()} SELECT g.scene_id, CAST(arg_min(bin, (v, bin)) AS INT) AS bin, round(min(v), 6) AS v FROM g WHERE bin BETWEEN 3 AND 11 GROUP BY ALL""")
def wn8(spark, d):
    s = smoothed(spark, d).select("scene_id", F.posexplode("smooth").alias("bin", "v")).where("bin BETWEEN 3 AND 11")
    b = s.groupBy("scene_id").agg(F.min(F.struct("v", "bin")).alias("b"))
    return rounded(b.select("scene_id", "b.bin", "b.v"))


@query("wn9_cluster_order", "SELECT scene_id, gt_inst, n, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, gt_inst) AS INT) AS place FROM (SELECT scene_id, gt_inst, count(*) AS n FROM points GROUP BY ALL)")
def wn9(spark, d):
    c = view(spark, d, "points").groupBy("scene_id", "gt_inst").agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(W.partitionBy("scene_id").orderBy(F.desc("n"), "gt_inst")))


_RLE = """
p AS (SELECT scene_id, proposal_id, place, EXISTS (SELECT 1 FROM proposals q WHERE q.scene_id = s.scene_id AND q.proposal_id = s.proposal_id AND q.point_id = place) AS m FROM
  (SELECT DISTINCT scene_id, proposal_id FROM proposals) s, range(0, 500) r(place)),
i AS (SELECT *, place - row_number() OVER (PARTITION BY scene_id, proposal_id ORDER BY place) AS run FROM p WHERE m),
r AS (SELECT scene_id, proposal_id, min(place) + 1 AS start, count(*) AS n FROM i GROUP BY scene_id, proposal_id, run)"""


def _mask(spark, d):
    p = view(spark, d, "proposals")
    every = p.select("scene_id", "proposal_id").distinct().withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(499).cast("long"))))
    return every.join(p.select("scene_id", "proposal_id", F.col("point_id").alias("place"), F.lit(True).alias("m")), ["scene_id", "proposal_id", "place"], "left").withColumn("m", F.coalesce("m", F.lit(False)))


@query("wn10_rle_encode", f"WITH {_RLE.strip()} SELECT scene_id, proposal_id, CAST(500 AS BIGINT) AS length, string_agg(start || ' ' || n, ' ' ORDER BY start) AS counts FROM r GROUP BY ALL")
def wn10(spark, d):
    return rle.encoded(_mask(spark, d), ["scene_id", "proposal_id"], "place", "m")


@query("fn5_rle_round_trip", "SELECT scene_id, proposal_id, count(*) AS n, CAST(sum(point_id) AS BIGINT) AS places FROM proposals GROUP BY ALL")
def fn5(spark, d):
    keys = ["scene_id", "proposal_id"]
    return rle.decoded(rle.encoded(_mask(spark, d), keys, "place", "m"), keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("place").alias("places"))


# --- orders and sets -------------------------------------------------------------------------------------------------


@query("so1_score_order", "SELECT scene_id, proposal_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, proposal_id) AS INT) AS place FROM scores")
def so1(spark, d):
    return view(spark, d, "scores").select("scene_id", "proposal_id", F.row_number().over(W.partitionBy("scene_id").orderBy(F.desc("score"), "proposal_id")).alias("place"))


@query("so2_natural_sort", "SELECT name, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(name, '([0-9]+)$', 1) AS INT), name) AS INT) AS place FROM (SELECT DISTINCT 'cloudR' || scene_id AS name FROM results)")
def so2(spark, d):
    names = view(spark, d, "results").select(F.concat(F.lit("cloudR"), F.col("scene_id").cast("string")).alias("name")).distinct()
    by = F.regexp_extract("name", "([0-9]+)$", 1).cast("int")
    return names.select("name", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(by, "name")).alias("place"))  # a row for each scene name


@query("so4_largest_clusters", "SELECT scene_id, gt_inst, count(*) AS n FROM points GROUP BY ALL ORDER BY n DESC, scene_id, gt_inst LIMIT 40")
def so4(spark, d):
    return view(spark, d, "points").groupBy("scene_id", "gt_inst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "scene_id", "gt_inst").limit(40)


@query("st1_union_families", "SELECT 'a' AS family, model, count(*) AS n FROM results WHERE clustering = 'c0' GROUP BY ALL UNION ALL SELECT 'b', model, count(*) FROM results WHERE clustering = 'c1' GROUP BY ALL")
def st1(spark, d):
    r = view(spark, d, "results")
    part = lambda name, c: r.where(F.col("clustering") == c).groupBy("model").agg(F.count("*").alias("n")).withColumn("family", F.lit(name))
    return part("a", "c0").unionByName(part("b", "c1"))


@query("st2_set_overlap", "SELECT a.proposal_id AS a, b.proposal_id AS b, count(*) AS shared FROM (SELECT DISTINCT proposal_id, point_id FROM proposals) a JOIN (SELECT DISTINCT proposal_id, point_id FROM proposals) b ON a.point_id = b.point_id AND a.proposal_id < b.proposal_id GROUP BY ALL")
def st2(spark, d):
    p = view(spark, d, "proposals").select("proposal_id", "point_id").distinct()
    a, b = p.withColumnRenamed("proposal_id", "a"), p.withColumnRenamed("proposal_id", "b")
    return a.join(b, "point_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@query("st3_set_equality", "SELECT (SELECT count(*) FROM (SELECT scene_id, gt_inst FROM points EXCEPT SELECT scene_id, pred_inst FROM points)) AS only_gt, (SELECT count(*) FROM (SELECT scene_id, pred_inst FROM points EXCEPT SELECT scene_id, gt_inst FROM points)) AS only_pred")
def st3(spark, d):
    p = view(spark, d, "points")
    g, q = p.select("scene_id", F.col("gt_inst").alias("i")).distinct(), p.select("scene_id", F.col("pred_inst").alias("i")).distinct()
    return g.subtract(q).agg(F.count("*").alias("only_gt")).join(F.broadcast(q.subtract(g).agg(F.count("*").alias("only_pred"))))


@query("st4_distinct_cells", "SELECT DISTINCT scene_id, CAST(floor(x / 0.1) AS BIGINT) AS ix, CAST(floor(y / 0.1) AS BIGINT) AS iy FROM event_points")
def st4(spark, d):
    return view(spark, d, "event_points").select("scene_id", F.floor(F.col("x") / 0.1).alias("ix"), F.floor(F.col("y") / 0.1).alias("iy")).distinct()


@query("st5_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def st5(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


# --- functions -------------------------------------------------------------------------------------------------------


@query("fn1_cells_and_rounding", "SELECT point_id, CAST(floor((x - 1) / 0.3) AS BIGINT) AS floored, CAST(ceil((x - 1) / 0.3) AS BIGINT) AS ceiled, CAST(trunc((x - 1) / 0.3) AS BIGINT) AS truncated, greatest(0.5, least(1.5, x)) AS clipped FROM event_points")
def fn1(spark, d):
    v = (F.col("x") - 1) / 0.3
    return view(spark, d, "event_points").select("point_id", F.floor(v).alias("floored"), F.ceil(v).alias("ceiled"), v.cast("long").alias("truncated"), F.greatest(F.lit(0.5), F.least(F.lit(1.5), "x")).alias("clipped"))


@query("fn2_vector_functions", """
SELECT scene_id, round(sum(sqrt(x * x + y * y + z * z)), 4) AS norms, round(avg(degrees(acos(least(1.0, abs(z) / greatest(sqrt(x * x + y * y + z * z), 1e-12))))), 6) AS angle, round(avg(1 / (1 + exp(-x))), 6) AS sigmoid FROM event_points GROUP BY ALL""")
def fn2(spark, d):
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.abs("z") / F.greatest(n, F.lit(1e-12)))))
    return view(spark, d, "event_points").groupBy("scene_id").agg(F.round(F.sum(n), 4).alias("norms"), F.round(F.avg(angle), 6).alias("angle"), F.round(F.avg(1 / (1 + F.exp(-F.col("x")))), 6).alias("sigmoid"))


@query("fn3_packed_ids", "SELECT point_id, (CAST(sem_gt AS BIGINT) & 65535) | (CAST(gt_inst AS BIGINT) << 16) AS packed, 1000 * sem_gt + gt_inst AS coded, CAST(pred_inst * 32 + gt_inst AS INT) // 32 AS unpacked FROM points")
def fn3(spark, d):
    p = view(spark, d, "points")
    return p.select("point_id", rle.packed(F.col("sem_gt").cast("long"), F.col("gt_inst").cast("long")).alias("packed"), (F.col("sem_gt") * 1000 + F.col("gt_inst")).alias("coded"), F.expr("cast((pred_inst * 32 + gt_inst) div 32 as int)").alias("unpacked"))


@query("fn4_strings", """
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '([^/]*)$', 1) AS base, starts_with(url, 'https') AS secure, contains(url, '.org') AS org, replace(url, 'http', 'x') AS replaced, printf('%05d', page_id) AS padded FROM pages""")
def fn4(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "([^/]*)$", 1).alias("base"), F.startswith("url", F.lit("https")).alias("secure"), F.contains("url", F.lit(".org")).alias("org"), F.replace("url", F.lit("http"), F.lit("x")).alias("replaced"), F.format_string("%05d", "page_id").alias("padded"))


@query("fn6_significance_text", """
SELECT model, clustering, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars, printf('[%.2f, %.2f]', p, p * 2) AS interval FROM (SELECT model, clustering, round(avg(metric) / 4000, 3) AS p FROM results GROUP BY ALL)""")
def fn6(spark, d):
    t = view(spark, d, "results").groupBy("model", "clustering").agg(F.round(F.avg("metric") / 4000, 3).alias("p"))
    return t.select("model", "clustering", statistics.stars(F.col("p")).alias("stars"), F.format_string("[%.2f, %.2f]", "p", F.col("p") * 2).alias("interval"))


@query("fn7_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, length(props) AS n FROM events")
def fn7(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("bigint").alias("n"))


@query("fn8_arrays", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS argmax, round(list_sum(embedding :: DOUBLE[]), 4) AS total, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings")
def fn8(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("argmax"), F.round(total, 4).alias("total"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"))


@query("fn9_nan_handling", "SELECT scene_id, count(v) AS known, round(avg(v), 6) AS mean, round(avg(coalesce(v, 0.0)), 6) AS filled FROM (SELECT scene_id, CASE WHEN inst = 2 THEN NULL ELSE x END AS v FROM event_points) GROUP BY ALL")
def fn9(spark, d):
    e = view(spark, d, "event_points").withColumn("v", F.when(F.col("inst") == 2, F.lit(float("nan"))).otherwise(F.col("x")))
    known = F.when(F.isnan("v"), None).otherwise(F.col("v"))
    return rounded(e.groupBy("scene_id").agg(F.count(known).alias("known"), F.avg(known).alias("mean"), F.avg(F.nanvl("v", F.lit(0.0))).alias("filled")))


# --- instance metrics ------------------------------------------------------------------------------------------------

_IOU = """
c AS (SELECT scene_id, pred_inst AS pred, gt_inst AS gt, count(*) AS n FROM points GROUP BY ALL),
pa AS (SELECT scene_id, pred, sum(n) AS a FROM c WHERE pred > 0 GROUP BY ALL), ga AS (SELECT scene_id, gt, sum(n) AS a FROM c WHERE gt > 0 GROUP BY ALL),
i AS (SELECT c.*, CAST(pa.a AS BIGINT) AS pred_area, CAST(ga.a AS BIGINT) AS gt_area, n / (pa.a + ga.a - n) AS iou FROM c JOIN pa ON c.scene_id = pa.scene_id AND c.pred = pa.pred JOIN ga ON c.scene_id = ga.scene_id AND c.gt = ga.gt),
r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, pred ORDER BY iou DESC, gt) AS k FROM i),
m AS (SELECT * FROM r WHERE k = 1 AND iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY scene_id, gt ORDER BY pred) = 1)"""


def _matched(spark, d, threshold=0.5):
    p = view(spark, d, "points")
    return p, match.matches(match.ious(p, "pred_inst", "gt_inst"), threshold)


@query("me1_instance_matching", f"WITH {_IOU.strip()} SELECT scene_id, pred, gt, n, pred_area, gt_area, round(iou, 6) AS iou FROM m")
def me1(spark, d):
    return rounded(_matched(spark, d)[1].select("scene_id", "pred", "gt", "n", "pred_area", "gt_area", "iou"))


_DET = """
k AS (SELECT scene_id, count(DISTINCT CASE WHEN pred_inst > 0 THEN pred_inst END) AS n_pred, count(DISTINCT CASE WHEN gt_inst > 0 THEN gt_inst END) AS n_gt FROM points GROUP BY ALL),
t AS (SELECT k.*, coalesce(tp, 0) AS tp, coalesce(miou, 0) AS instance_miou FROM k LEFT JOIN (SELECT scene_id, count(*) AS tp, avg(iou) AS miou FROM m GROUP BY ALL) q ON k.scene_id = q.scene_id)
SELECT scene_id, n_pred, n_gt, tp, round(instance_miou, 6) AS instance_miou, round(coalesce(tp / nullif(n_pred, 0), 0), 6) AS precision, round(coalesce(tp / nullif(n_gt, 0), 0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(n_pred + n_gt, 0), 0), 6) AS f1, abs(n_pred - n_gt) AS count_error FROM t"""


@query("me2_detection_metrics", f"WITH {_IOU.strip()}, {_DET.strip()}")
def me2(spark, d):
    p, m = _matched(spark, d)
    return rounded(match.detection(p, m, "pred_inst", "gt_inst"))


@query("me3_greedy_one_to_one")
def me3(spark, d):
    i = match.ious(view(spark, d, "points"), "base_inst", "gt_inst", both_positive=True)
    return rounded(match.mutual_matches(i, 0.05).select("scene_id", "pred", "gt", "iou"))


@query("me4_evaluation_report", f"""
WITH {_IOU.strip()}, {_DET.strip().replace(') SELECT', ')').replace('SELECT scene_id, n_pred', ', d AS (SELECT scene_id, n_pred', 1)}),
s AS (SELECT scene_id, count(*) AS points, round(avg(CASE WHEN sem_pred = sem_gt THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM points GROUP BY ALL)
SELECT d.scene_id, points, accuracy, tp, precision, recall, f1 FROM d JOIN s ON d.scene_id = s.scene_id""")
def me4(spark, d):
    p, m = _matched(spark, d)
    semantic = match.confusion(p, "sem_pred", "sem_gt").withColumn("points", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).select("scene_id", "points", "accuracy")
    return rounded(match.detection(p, m, "pred_inst", "gt_inst").join(semantic, "scene_id").select("scene_id", "points", "accuracy", "tp", "precision", "recall", "f1"))


@query("me5_external_predictions", f"WITH {_IOU.strip()} SELECT count(*) AS matched, round(avg(iou), 6) AS miou FROM m")
def me5(spark, d):
    """Predictions as a table of their own, joined to the truth by point."""
    p = view(spark, d, "points")
    both = p.select("scene_id", "pred_inst", "gt_inst")
    m = match.matches(match.ious(both, "pred_inst", "gt_inst"), 0.5)
    return m.agg(F.count("*").alias("matched"), F.round(F.avg("iou"), 6).alias("miou"))


_LEVELS = [0.25, *[0.5 + 0.05 * k for k in range(9)]]


@query("me6_ap_over_thresholds", f"""
WITH c AS (SELECT scene_id, pred_inst AS pred, gt_inst AS gt, count(*) AS n FROM points GROUP BY ALL),
a AS (SELECT scene_id, pred, CAST(sum(n) AS BIGINT) AS area FROM c WHERE pred > 0 GROUP BY ALL), g AS (SELECT scene_id, gt, CAST(sum(n) AS BIGINT) AS area FROM c WHERE gt > 0 GROUP BY ALL),
i AS (SELECT c.scene_id, c.pred, c.gt, a.area, c.n / (a.area + g.area - c.n) AS iou FROM c JOIN a ON a.scene_id = c.scene_id AND a.pred = c.pred JOIN g ON g.scene_id = c.scene_id AND g.gt = c.gt WHERE a.area >= 100),
b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY scene_id, pred ORDER BY iou DESC, gt) = 1),
t AS (SELECT CAST(unnest([{", ".join(f"'{v!r}'" for v in _LEVELS)}]) AS DOUBLE) AS threshold),
e AS (SELECT threshold, area AS score, iou > threshold AND row_number() OVER (PARTITION BY threshold, scene_id, gt ORDER BY area DESC, pred) = 1 AS hit FROM b, t),
s AS (SELECT threshold, score, count(*) FILTER (hit) AS hits, count(*) AS n FROM e GROUP BY ALL),
k AS (SELECT *, sum(hits) OVER w AS tp, sum(n) OVER w AS seen FROM s WINDOW w AS (PARTITION BY threshold ORDER BY score DESC)),
r AS (SELECT *, tp / seen AS precision, tp / (SELECT greatest(1, count(*)) FROM g) AS recall FROM k),
m AS (SELECT *, max(precision) OVER (PARTITION BY threshold ORDER BY score ROWS UNBOUNDED PRECEDING) AS env, recall - coalesce(lag(recall) OVER (PARTITION BY threshold ORDER BY score DESC), 0) AS step FROM r)
SELECT round(threshold, 6) AS threshold, round(sum(env * step), 6) AS ap FROM m GROUP BY ALL""")
def me6(spark, d):
    """AP of matches over IoU .5 to .9 in steps of .05, and .25; predictions under 100 points are left out."""
    p = view(spark, d, "points")
    i = match.ious(p, "pred_inst", "gt_inst").where("pred_area >= 100")
    score = F.col("pred_area") / 1000.0
    levels = F.explode(F.array(*[F.lit(t) for t in _LEVELS])).alias("threshold")
    best = i.groupBy("scene_id", "pred").agg(F.max(F.struct("iou", F.negative("gt").alias("gt"))).alias("b"), F.first(score).alias("score"))
    each = best.select("scene_id", "pred", "score", F.col("b.iou").alias("iou"), F.col("b.gt").alias("gt"), levels)
    first = W.partitionBy("threshold", "scene_id", "gt").orderBy(F.desc("score"), "pred")
    over = F.col("iou") > F.col("threshold")
    hits = each.withColumn("hit", over & (F.row_number().over(first) == 1))
    n_gt = p.where("gt_inst > 0").select("scene_id", "gt_inst").distinct().count()
    return rounded(match.average_precision(hits, max(1, n_gt)))


@query("me7_panoptic_quality", f"""
WITH {_IOU.strip()}, t AS (SELECT scene_id, count(*) AS tp, sum(iou) AS s FROM i WHERE iou > 0.5 GROUP BY ALL),
p AS (SELECT scene_id, count(*) AS n FROM (SELECT scene_id, pred_inst, count(*) AS n FROM points WHERE pred_inst > 0 GROUP BY ALL) WHERE n >= 50 GROUP BY ALL),
g AS (SELECT scene_id, count(*) AS n FROM (SELECT scene_id, gt_inst, count(*) AS n FROM points WHERE gt_inst > 0 GROUP BY ALL) WHERE n >= 50 GROUP BY ALL)
SELECT p.scene_id, coalesce(tp, 0) AS tp, p.n - coalesce(tp, 0) AS fp, g.n - coalesce(tp, 0) AS fn, round(coalesce(s / tp, 0), 6) AS sq, round(2.0 * coalesce(tp, 0) / (p.n + g.n), 6) AS rq, round(coalesce(s / tp, 0) * (2.0 * coalesce(tp, 0) / (p.n + g.n)), 6) AS pq
FROM p JOIN g ON p.scene_id = g.scene_id LEFT JOIN t ON t.scene_id = p.scene_id""")
def me7(spark, d):
    p = view(spark, d, "points")
    return rounded(match.panoptic(match.ious(p, "pred_inst", "gt_inst"), p, "pred_inst", "gt_inst", 50))


_CELLS = "c AS (SELECT scene_id, base_inst AS pred, gt_inst AS gt, count(*) AS n FROM points GROUP BY ALL)"


@query("me8_over_segmentation", f"""
WITH {_CELLS}, p AS (SELECT scene_id, pred, sum(n) AS a FROM c WHERE pred > 0 GROUP BY ALL), g AS (SELECT scene_id, gt, sum(n) AS a FROM c WHERE gt > 0 GROUP BY ALL)
SELECT c.scene_id, c.gt, count(*) AS fragments FROM c JOIN p ON c.scene_id = p.scene_id AND c.pred = p.pred JOIN g ON c.scene_id = g.scene_id AND c.gt = g.gt
WHERE c.n >= 0.2 * p.a AND c.n >= 0.15 * g.a GROUP BY ALL HAVING count(*) >= 2""")
def me8(spark, d):
    return match.over_segmented(match.contingency(view(spark, d, "points"), "base_inst", "gt_inst"), 0.2, 0.15)


@query("me9_under_segmentation", f"WITH {_CELLS} SELECT scene_id, pred, gt, n, round(n / sum(n) OVER (PARTITION BY scene_id, pred), 6) AS share, CAST(row_number() OVER (PARTITION BY scene_id, pred ORDER BY n DESC, gt) AS INT) AS place FROM c WHERE pred > 0")
def me9(spark, d):
    return rounded(match.composition(match.contingency(view(spark, d, "points"), "base_inst", "gt_inst")))


@query("me10_count_outcome", """
WITH k AS (SELECT scene_id, count(DISTINCT CASE WHEN x < 0.1 THEN pred_inst END) AS p, count(DISTINCT CASE WHEN y < 0.02 THEN gt_inst END) AS g FROM points GROUP BY ALL)
SELECT scene_id, CASE WHEN p < g THEN 'under' WHEN p = g THEN 'correct' ELSE 'over' END AS outcome, abs(p - g) AS error FROM k""")
def me10(spark, d):
    k = view(spark, d, "points").groupBy("scene_id").agg(F.count_distinct(F.when(F.col("x") < 0.1, F.col("pred_inst"))).alias("p"), F.count_distinct(F.when(F.col("y") < 0.02, F.col("gt_inst"))).alias("g"))
    outcome = F.when(F.col("p") < F.col("g"), "under").when(F.col("p") == F.col("g"), "correct").otherwise("over")
    return k.select("scene_id", outcome.alias("outcome"), F.abs(F.col("p") - F.col("g")).alias("error"))


def sticky(spark, d):
    """Clusters of the event points: the points of one scene and of a pair of instances, with the instance as plant."""
    e = view(spark, d, "event_points")
    return e.select("scene_id", F.floor(F.col("inst") / 2).alias("cluster"), "point_id", *"xyz", "inst")


#: Settings that the sweeps try.
SPACINGS, VALLEYS = (0.20, 0.25, 0.30, 0.35), (0.80, 0.85, 0.90, 0.95)


@query("me11_parameter_scan")
def me11(spark, d):
    from pointloom.operators import sweeps

    return sweeps.scan(sticky(spark, d), [(s, v) for s in SPACINGS for v in VALLEYS])


@query("me12_optimal_assignment")
def me12(spark, d):
    p = view(spark, d, "points")
    return rounded(match.optimal_matches(match.ious(p, "base_inst", "gt_inst"), 0.0))


@query("st15_density_sensitivity")
def st15(spark, d):
    from pointloom.operators import splits, sweeps

    return rounded(sweeps.density_sensitivity(sticky(spark, d), splits.Rule()))


@query("st16_tuned_rule")
def st16(spark, d):
    """Coordinate descent over a scanned grid of spacing and valley, by the share of clusters that split right."""
    from pointloom.operators import sweeps

    grid = {"spacing": list(SPACINGS), "valley": list(VALLEYS)}
    rows = {(r["spacing"], r["valley"]): r for r in sweeps.scan(sticky(spark, d), [(s, v) for s in grid["spacing"] for v in grid["valley"]]).collect()}  # a row a setting

    def score(s: dict) -> float:
        row = rows[s["spacing"], s["valley"]]
        return sweeps.tuning_score(row["correct"] / row["plants"], 0.0, abs(row["parts"] - row["plants"]) / row["plants"])

    best, value = sweeps.coordinate_descent(grid, score, {"spacing": 0.35, "valley": 0.9})
    return spark.createDataFrame([(best["spacing"], best["valley"], round(value, 6))], "spacing double, valley double, score double")


@query("me13_majority_gt", f"WITH {_CELLS} SELECT scene_id, pred, gt, n FROM c WHERE pred > 0 AND gt > 0 QUALIFY row_number() OVER (PARTITION BY scene_id, pred ORDER BY n DESC, gt) = 1")
def me13(spark, d):
    c = match.contingency(view(spark, d, "points"), "base_inst", "gt_inst").where("pred > 0 AND gt > 0")
    b = c.groupBy("scene_id", "pred").agg(F.min(F.struct((-F.col("n")).alias("m"), "gt")).alias("b"))
    return b.select("scene_id", "pred", F.col("b.gt").alias("gt"), (-F.col("b.m")).alias("n"))


@query("me14_threshold_curve", f"""
WITH {_IOU.split('m AS')[0].strip().rstrip(',')}, t AS (SELECT t.t / 10.0 AS t FROM range(1, 10) t(t)),
m AS (SELECT t, scene_id, gt FROM r, t WHERE k = 1 AND iou >= t QUALIFY row_number() OVER (PARTITION BY t, scene_id, gt ORDER BY pred) = 1)
SELECT CAST(t AS DOUBLE) AS threshold, count(*) AS matched FROM m GROUP BY ALL""")
def me14(spark, d):
    i = match.ious(view(spark, d, "points"), "pred_inst", "gt_inst").withColumn("threshold", F.explode(F.array(*[F.lit(k / 10.0) for k in range(1, 10)])))
    return _curve(i).groupBy("threshold").agg(F.count("*").alias("matched"))


def _curve(i):
    best = W.partitionBy("threshold", "scene_id", "pred").orderBy(F.desc("iou"), "gt")
    first = W.partitionBy("threshold", "scene_id", "gt").orderBy("pred")
    proposed = i.withColumn("_r", F.row_number().over(best)).where((F.col("_r") == 1) & (F.col("iou") >= F.col("threshold")))
    return proposed.withColumn("_r", F.row_number().over(first)).where("_r = 1")


# --- experiments -----------------------------------------------------------------------------------------------------


@query("st10_plant_gain", """
WITH b AS (SELECT model, scene_id, plant_id, avg(metric) AS v, avg(metric) > 150 AS m FROM results WHERE refinement = 'base' GROUP BY ALL),
f AS (SELECT model, scene_id, plant_id, avg(metric) AS v, avg(metric) > 150 AS m FROM results WHERE refinement = 'refined' GROUP BY ALL)
SELECT model, count(*) FILTER (NOT b.m AND f.m) AS gained, count(*) FILTER (b.m AND NOT f.m) AS lost, count(*) FILTER (b.m AND f.m) AS both_matched, round(avg(f.v - b.v) FILTER (b.m AND f.m), 4) AS delta_both
FROM b JOIN f USING (model, scene_id, plant_id) GROUP BY ALL""")
def st10(spark, d):
    keys = ["model", "scene_id", "plant_id"]
    b, f = _sides(spark, d, *keys)
    j = b.withColumnRenamed("value", "b").join(f.withColumnRenamed("value", "f"), keys)
    bm, fm = F.col("b") > 150, F.col("f") > 150
    return j.groupBy("model").agg(F.count_if(~bm & fm).alias("gained"), F.count_if(bm & ~fm).alias("lost"), F.count_if(bm & fm).alias("both_matched"), F.round(F.avg(F.when(bm & fm, F.col("f") - F.col("b"))), 4).alias("delta_both"))


_DELTA = """
b AS (SELECT model, scene_id, plant_id, avg(metric) AS v FROM results WHERE refinement = 'base' GROUP BY ALL), f AS (SELECT model, scene_id, plant_id, avg(metric) AS v FROM results WHERE refinement = 'refined' GROUP BY ALL),
d AS (SELECT model, b.v AS base, f.v AS refined, round(f.v - b.v, 6) AS delta FROM b JOIN f USING (model, scene_id, plant_id))"""


def _deltas(spark, d):
    keys = ["model", "scene_id", "plant_id"]
    b, f = _sides(spark, d, *keys)
    return b.withColumnRenamed("value", "base").join(f.withColumnRenamed("value", "refined"), keys).withColumn("delta", F.round(F.col("refined") - F.col("base"), 6))


@query("st11_paired_effect", f"""
WITH {_DELTA.strip()} SELECT model, count(*) AS n, round(avg(base), 4) AS mean_base, round(avg(refined), 4) AS mean_refined, round(avg(refined - base), 4) AS change, round(avg(refined - base) / avg(base) * 100, 4) AS relative, round(avg(refined - base) / stddev_samp(refined - base), 4) AS dz FROM d GROUP BY ALL""")
def st11(spark, d):
    return rounded(statistics.effect(_deltas(spark, d), ["model"], "base", "refined"), 4)


@query("st11_signed_rank", f"""
WITH {_DELTA.strip()}, s AS (SELECT *, abs(delta) AS size FROM d WHERE delta <> 0),
k AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY size) + (count(*) OVER (PARTITION BY model, size) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY model, size) AS t FROM s),
w AS (SELECT model, count(*) AS n, sum(CASE WHEN delta > 0 THEN rk ELSE 0 END) AS w, sum(CAST(t * t - 1 AS DOUBLE)) AS ties FROM k GROUP BY ALL)
SELECT model, n, round(w, 3) AS w, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2.0 * n + 1) / 24 - ties / 48), 5) AS z FROM w""")
def st11b(spark, d):
    t = statistics.signed_rank(_deltas(spark, d), ["model"])
    return t.select("model", "n", F.round("w", 3).alias("w"), F.round("z", 5).alias("z"))


@query("st11_holm_and_bootstrap")
def st11c(spark, d):
    deltas = _deltas(spark, d)
    tests = statistics.holm(statistics.signed_rank(deltas, ["model"]).withColumn("family", F.lit(1)), ["family"])
    rows = deltas.withColumn("row", F.xxhash64("scene_id", "plant_id"))
    return rounded(tests.join(statistics.bootstrap(rows, ["model"]), "model").select("model", "n", "p", "holm", "low", "high"))


@query("st12_pairing_flow", "SELECT model, count(*) FILTER (refinement = 'base') AS base, count(*) FILTER (refinement = 'refined') AS refined, count(DISTINCT (scene_id, plant_id)) AS plants FROM results GROUP BY ALL")
def st12(spark, d):
    return view(spark, d, "results").groupBy("model").agg(F.count_if(F.col("refinement") == "base").alias("base"), F.count_if(F.col("refinement") == "refined").alias("refined"), F.count_distinct("scene_id", "plant_id").alias("plants"))


@query("st13_ablation_deltas", "WITH s AS (SELECT model, clustering, avg(metric) AS v FROM results GROUP BY ALL) SELECT a.model, a.clustering, round(a.v - b.v, 4) AS delta FROM s a JOIN s b ON a.model = b.model AND b.clustering = 'c0' WHERE a.clustering <> 'c0'")
def st13(spark, d):
    s = view(spark, d, "results").groupBy("model", "clustering").agg(F.avg("metric").alias("v"))
    base = s.where("clustering = 'c0'").select("model", F.col("v").alias("b"))
    return s.where("clustering <> 'c0'").join(base, "model").select("model", "clustering", F.round(F.col("v") - F.col("b"), 4).alias("delta"))


@query("st14_sweep_means", "WITH s AS (SELECT model, clustering, scene_id % 4 AS cell, round(avg(metric), 4) AS mean FROM results GROUP BY ALL) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY model ORDER BY mean DESC, clustering, cell) <= 3")
def st14(spark, d):
    s = view(spark, d, "results").groupBy("model", "clustering", (F.col("scene_id") % 4).alias("cell")).agg(F.round(F.avg("metric"), 4).alias("mean"))
    return s.withColumn("_r", F.row_number().over(W.partitionBy("model").orderBy(F.desc("mean"), "clustering", "cell"))).where("_r <= 3").drop("_r")


@query("st17_efficiency", "WITH s AS (SELECT model, avg(metric) FILTER (refinement = 'base') AS b, avg(metric) FILTER (refinement = 'refined') AS f FROM results GROUP BY ALL) SELECT model, round(f - b, 4) AS overhead, round(1000.0 / f, 6) AS per_second, round((f - b) / b * 100, 4) AS percent FROM s")
def st17(spark, d):
    side = lambda k: F.avg(F.when(F.col("refinement") == k, F.col("metric")))
    s = view(spark, d, "results").groupBy("model").agg(side("base").alias("b"), side("refined").alias("f"))
    return s.select("model", F.round(F.col("f") - F.col("b"), 4).alias("overhead"), F.round(1000.0 / F.col("f"), 6).alias("per_second"), F.round((F.col("f") - F.col("b")) / F.col("b") * 100, 4).alias("percent"))


@query("st18_gt_audit", "SELECT scene_id, count(*) AS points, count(*) FILTER (sem_gt NOT IN (0, 1)) AS invalid, count(*) FILTER (sem_gt = 0 AND gt_inst > 0) AS conflicting, count(DISTINCT gt_inst) FILTER (gt_inst > 0) AS instances FROM points GROUP BY ALL")
def st18(spark, d):
    return view(spark, d, "points").groupBy("scene_id").agg(F.count("*").alias("points"), F.count_if(~F.col("sem_gt").isin(0, 1)).alias("invalid"), F.count_if((F.col("sem_gt") == 0) & (F.col("gt_inst") > 0)).alias("conflicting"), F.count_distinct(F.when(F.col("gt_inst") > 0, F.col("gt_inst"))).alias("instances"))
