"""Comparison of predicted and true instances: contingency, matching, detection and segmentation metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ious(points: DataFrame, pred: str, gt: str, keys: tuple[str, ...] = ("scene_id",), both_positive: bool = False) -> DataFrame:
    """keys, pred, gt, n, areas and iou of labels above 0 that share points. Areas count every positive point of a side,
    or with both_positive only predicted points on true instances.

    One aggregation of the points to label pairs; all else follows from that small table."""
    cells = points.select(*keys, F.col(pred).alias("pred"), F.col(gt).alias("gt")).groupBy(*keys, "pred", "gt").agg(F.count("*").alias("n"))
    base = cells.where("gt > 0") if both_positive else cells
    pred_area = base.where("pred > 0").groupBy(*keys, "pred").agg(F.sum("n").alias("pred_area"))
    gt_area = cells.where("gt > 0").groupBy(*keys, "gt").agg(F.sum("n").alias("gt_area"))
    out = cells.where("pred > 0 AND gt > 0").join(pred_area, [*keys, "pred"]).join(gt_area, [*keys, "gt"])
    return out.withColumn("iou", F.col("n") / (F.col("pred_area") + F.col("gt_area") - F.col("n")))


def matches(overlap: DataFrame, threshold: float, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Each prediction proposes its best true instance; the smallest prediction at or above the threshold gets it."""
    best = W.partitionBy(*keys, "pred").orderBy(F.desc("iou"), "gt")
    first = W.partitionBy(*keys, "gt").orderBy("pred")
    proposed = overlap.withColumn("_r", F.row_number().over(best)).where((F.col("_r") == 1) & (F.col("iou") >= threshold))
    return proposed.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def mutual_matches(overlap: DataFrame, threshold: float, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """One-to-one matching of all pairs from the highest IoU down (then larger pred, larger gt): pairs that are the best
    of both sides are taken, round by round, as long as any is at or above the threshold."""
    from pointloom.lineage import cut

    rest, out = cut(overlap.where(F.col("iou") >= threshold)), None
    order = [F.desc("iou"), F.desc("pred"), F.desc("gt")]
    while not rest.isEmpty():
        ranked = rest.withColumns({"_p": F.row_number().over(W.partitionBy(*keys, "pred").orderBy(*order)), "_g": F.row_number().over(W.partitionBy(*keys, "gt").orderBy(*order))})
        taken = cut(ranked.where("_p = 1 AND _g = 1").drop("_p", "_g"))
        out = taken if out is None else out.unionByName(taken)
        rest = cut(rest.join(taken.select(*keys, "pred"), [*keys, "pred"], "left_anti").join(taken.select(*keys, "gt"), [*keys, "gt"], "left_anti"))
    return out if out is not None else rest


def assignment(value: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns, each once, with the largest total value: shortest augmenting paths over reduced costs."""
    turned = value.shape[0] > value.shape[1]
    cost = -(value.T if turned else value)
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for row in range(n):
        owner[m], at = row, m
        far, via, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            i, open_ = owner[at], ~done[:m]
            reach = np.where(open_, cost[i] - u[i] - v[:m], np.inf)
            nearer = reach < far
            far[nearer], via[nearer] = reach[nearer], at
            to = int(np.argmin(np.where(open_, far, np.inf)))
            step = far[to]
            u[owner[done]] += step
            v[done] -= step
            far[open_] -= step
            at = to
        while at != m:
            owner[at], at = owner[via[at]], via[at]
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((j, i) for i, j in pairs) if turned else sorted(pairs)


def optimal_matches(overlap: DataFrame, threshold: float, largest: int = 4_000_000) -> DataFrame:
    """scene_id, pred, gt, iou of the one-to-one matching with the largest total IoU, then those at or above the threshold.

    Pairs that no other choice can outweigh are taken first. Instances of the rest that overlap, directly or over others, are a
    group; a group of up to `largest` cells (predictions times true instances) is matched by one task, 8 bytes a cell, and
    larger ones by rounds of bids over tables, exact for IoU of six decimals."""
    from pointloom.lineage import cut

    from . import auction, graph

    taken, pairs = auction.peel(overlap)
    sides = [F.concat(F.lit(k), F.lpad(F.col(c).cast("string"), 20, "0")) for k, c in (("p", "pred"), ("g", "gt"))]
    groups = graph.components(pairs.select("scene_id", sides[0].alias("u"), sides[1].alias("v")))
    placed = cut(pairs.withColumn("node", sides[0]).join(groups, ["scene_id", "node"]).select("scene_id", "component", "pred", "gt", "iou"))
    keys = ["scene_id", "component"]
    sizes = [placed.select(*keys, c).distinct().groupBy(*keys).agg(F.count("*").alias(f"_{c}")) for c in ("pred", "gt")]
    large = cut(sizes[0].join(sizes[1], keys).where(F.col("_pred") * F.col("_gt") > largest).select(*keys))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pred", "gt"], kind="stable")
        (p, i), (g, j) = (np.unique(rows[c], return_inverse=True) for c in ("pred", "gt"))
        value = np.zeros((len(p), len(g)))
        value[i, j] = rows["iou"]
        found = [(rows["scene_id"].iloc[0], p[a], g[b], value[a, b]) for a, b in assignment(value) if value[a, b] > 1e-12]
        return pd.DataFrame(found, columns=["scene_id", "pred", "gt", "iou"])

    small = placed.join(large, keys, "left_anti").groupBy(*keys).applyInPandas(run, f"scene_id {kinds['scene_id']}, pred {kinds['pred']}, gt {kinds['gt']}, iou double")
    out = taken.unionByName(small)
    if not large.isEmpty():
        out = out.unionByName(auction.auction(placed.join(large, keys, "left_semi"), keys).drop("component"))
    return out.where(F.col("iou") >= threshold)


def detection(points: DataFrame, matched: DataFrame, pred: str, gt: str, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Precision, recall, F1 and mean IoU of matches for each scene, counts of instances, and the count error."""
    of = lambda c, name: F.count_distinct(F.when(F.col(c) > 0, F.col(c))).alias(name)
    counts = points.groupBy(*keys).agg(of(pred, "n_pred"), of(gt, "n_gt"))
    found = matched.groupBy(*keys).agg(F.count("*").alias("tp"), F.avg("iou").alias("instance_miou"))
    out = counts.join(found, list(keys), "left").withColumns({"tp": F.coalesce("tp", F.lit(0)), "instance_miou": F.coalesce("instance_miou", F.lit(0.0))})
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("n_pred")), "recall": ratio(F.col("tp"), F.col("n_gt"))})
    return out.withColumns({"f1": ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "count_error": F.abs(F.col("n_pred") - F.col("n_gt"))})


def confusion(points: DataFrame, pred: str, gt: str, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Counts, precision, recall, F1, IoU of both classes, their mean (null ones left out) and accuracy."""
    p, g = F.col(pred) == 1, F.col(gt) == 1
    out = points.groupBy(*keys).agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "iou_1": F.try_divide(tp, tp + fp + fn), "iou_0": F.try_divide(tn, tn + fp + fn), "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn)})
    known = F.array_compact(F.array("iou_0", "iou_1"))
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    return out.withColumns({"f1": F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "miou": mean})


def panoptic(overlap: DataFrame, points: DataFrame, pred: str, gt: str, least: int = 0) -> DataFrame:
    """PQ, SQ, RQ by scene: pairs with IoU over 0.5 are matches (they are unique); segments under `least` points don't count."""
    true = overlap.where((F.col("iou") > 0.5)).groupBy("scene_id").agg(F.count("*").alias("tp"), F.sum("iou").alias("_iou"))

    def segments(label: str, name: str) -> DataFrame:
        n = points.where(F.col(label) > 0).groupBy("scene_id", label).agg(F.count("*").alias("n")).where(F.col("n") >= least)
        return n.groupBy("scene_id").agg(F.count("*").alias(name))

    out = segments(pred, "n_pred").join(segments(gt, "n_gt"), "scene_id", "full").join(true, "scene_id", "left").na.fill(0)
    fp, fn = F.col("n_pred") - F.col("tp"), F.col("n_gt") - F.col("tp")
    sq = F.coalesce(F.try_divide(F.col("_iou"), F.col("tp")), F.lit(0.0))
    rq = F.try_divide(F.col("tp").cast("double"), F.col("tp") + 0.5 * fp + 0.5 * fn)
    return out.select("scene_id", "tp", fp.alias("fp"), fn.alias("fn"), sq.alias("sq"), rq.alias("rq"), (sq * rq).alias("pq"))


def average_precision(predictions: DataFrame, n_gt: int | Column) -> DataFrame:
    """Area under the precision envelope of each threshold group; predictions: threshold, score, hit (boolean), id.

    Equal scores enter together, so the rank order among them does not matter."""
    each = predictions.groupBy("threshold", "score").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count("*").alias("n"))
    down = W.partitionBy("threshold").orderBy(F.desc("score"))
    curve = each.withColumns({"tp": F.sum("hits").over(down), "seen": F.sum("n").over(down)})
    total = n_gt if isinstance(n_gt, Column) else F.lit(n_gt)
    curve = curve.withColumns({"precision": F.col("tp") / F.col("seen"), "recall": F.col("tp") / total})
    envelope = F.max("precision").over(W.partitionBy("threshold").orderBy("score").rowsBetween(W.unboundedPreceding, 0))
    step = F.col("recall") - F.coalesce(F.lag("recall").over(down), F.lit(0.0))
    return curve.withColumn("area", envelope * step).groupBy("threshold").agg(F.sum("area").alias("ap"))


def over_segmented(cells: DataFrame, majority: float = 0.5, cover: float = 0.2) -> DataFrame:
    """scene_id, gt and number of fragments of true instances that fall into two fragments or more: predictions whose
    majority lies in the instance and that cover enough of it. cells: scene_id, pred, gt, n."""
    pred = cells.where("pred > 0").groupBy("scene_id", "pred").agg(F.sum("n").alias("_p"))
    gt = cells.where("gt > 0").groupBy("scene_id", "gt").agg(F.sum("n").alias("_g"))
    parts = cells.where("pred > 0 AND gt > 0").join(pred, ["scene_id", "pred"]).join(gt, ["scene_id", "gt"])
    parts = parts.where((F.col("n") >= majority * F.col("_p")) & (F.col("n") >= cover * F.col("_g")))
    return parts.groupBy("scene_id", "gt").agg(F.count("*").alias("fragments")).where("fragments >= 2")


def composition(cells: DataFrame) -> DataFrame:
    """Share of each true label in each prediction, largest first."""
    by = W.partitionBy("scene_id", "pred")
    shares = cells.where("pred > 0").withColumn("share", F.col("n") / F.sum("n").over(by))
    return shares.withColumn("place", F.row_number().over(by.orderBy(F.desc("n"), "gt")))


def contingency(points: DataFrame, pred: str, gt: str) -> DataFrame:
    return points.groupBy("scene_id", F.col(pred).alias("pred"), F.col(gt).alias("gt")).agg(F.count("*").alias("n"))
