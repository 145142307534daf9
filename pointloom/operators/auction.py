"""One-to-one matching of the largest total as rounds over tables, for groups that no task should hold.

`peel` takes pairs that are in some best matching whatever the rest is. `auction` lets every unmatched instance bid for its
best partner, all in one round, until all are placed; prices only rise, and the last bids are small enough for the total to
be the best one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointloom.lineage import cut


def peel(pairs: DataFrame, rounds: int = 20, keys: tuple[str, ...] = ("scene_id",)) -> tuple[DataFrame, DataFrame]:
    """(taken, rest) of pairs (keys, pred, gt, iou): a pair that weighs as much as the best other pairs of its two sides
    together belongs to a best matching, as it replaces them without loss. Taken pairs leave with all pairs of their
    sides, which may free others for the next round. However many rounds are allowed, a best matching of rest and the
    taken pairs are a best matching of all."""
    rest = cut(pairs.select(*keys, "pred", "gt", "iou").where("iou > 0"))
    taken = None
    by = {"pred": W.partitionBy(*keys, "pred").orderBy(F.desc("iou"), "gt"), "gt": W.partitionBy(*keys, "gt").orderBy(F.desc("iou"), "pred")}
    for _ in range(rounds):
        ranked = rest
        for side, order in by.items():
            ranked = ranked.withColumns({f"_r_{side}": F.row_number().over(order), f"_o_{side}": F.coalesce(F.lead("iou").over(order), F.lit(0.0))})
        sure = (F.col("_r_pred") == 1) & (F.col("_r_gt") == 1) & (F.col("iou") >= F.col("_o_pred") + F.col("_o_gt"))
        now = cut(ranked.where(sure).select(*keys, "pred", "gt", "iou"))
        if now.isEmpty():
            break
        taken = now if taken is None else taken.unionByName(now)
        for side in by:
            rest = rest.join(now.select(*keys, side), [*keys, side], "left_anti")
        rest = cut(rest.select(*keys, "pred", "gt", "iou"))
    return (rest.limit(0) if taken is None else taken), rest


def _doubled(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bidder, object and iou of a problem in which all are placed: each side has a mirrored copy, pairs are mirrored too,
    and everyone may take its own copy for nothing. Its best total is twice that of the pairs."""
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    row = lambda bidder, thing, worth: pairs.select(*keys, bidder.alias("bidder"), thing.alias("object"), worth.alias("iou")).distinct()
    pred, gt, pred_copy, gt_copy, none = name("p", "pred"), name("g", "gt"), name("P", "pred"), name("G", "gt"), F.lit(0.0)
    return row(pred, gt, F.col("iou")).unionByName(row(gt_copy, pred_copy, F.col("iou"))).unionByName(row(pred, pred_copy, none)).unionByName(row(gt_copy, gt, none))


def auction(pairs: DataFrame, keys: list[str], decimals: int = 6) -> DataFrame:
    """The pairs (keys, pred, gt, iou) of a matching with the largest total of IoU rounded to so many decimals; each pred and
    each gt once within keys.

    Values are whole numbers, multiples of more than the number of bidders, so that bids that raise prices by 1 in the last
    phase end in the best total. Earlier phases raise by more and only find prices to start from. A round reads the pairs
    of unplaced bidders, joins them with prices and keeps each object's best bid: two joins and two groupings by
    instance, however large a group is. All groups take part in the same rounds.
    """
    pairs = cut(pairs.select(*keys, "pred", "gt", "iou").where("iou > 0"))
    if pairs.isEmpty():
        return pairs
    doubled = cut(_doubled(pairs, keys))
    most = doubled.select(*keys, "bidder").distinct().groupBy(*keys).count().agg(F.max("count")).first()[0]
    edges = cut(doubled.select(*keys, "bidder", "object", (F.round(F.col("iou") * 10**decimals).cast("long") * (most + 1)).alias("worth")))
    bidders = cut(edges.select(*keys, "bidder").distinct())
    highest = edges.agg(F.max("worth")).first()[0]
    state = edges.select(*keys, "object").distinct().withColumns({"price": F.lit(0).cast("long"), "owner": F.lit(None).cast("string")})
    choice = W.partitionBy(*keys, "bidder").orderBy(F.desc("gain"), "object")
    raised = max(1, highest // 4)
    while True:
        state, free = cut(state.withColumn("owner", F.lit(None).cast("string"))), bidders
        while not free.isEmpty():
            offers = edges.join(free, [*keys, "bidder"], "left_semi").join(state.select(*keys, "object", "price"), [*keys, "object"])
            offers = offers.withColumn("gain", F.col("worth") - F.col("price"))
            offers = offers.withColumns({"_r": F.row_number().over(choice), "_next": F.lead("gain").over(choice)}).where("_r = 1")
            bid = F.struct((F.col("worth") - F.col("_next") + raised).alias("bid"), "bidder")
            won = offers.groupBy(*keys, "object").agg(F.max(bid).alias("_won"))
            state = state.join(won, [*keys, "object"], "left").select(*keys, "object", F.coalesce("_won.bid", "price").alias("price"), F.coalesce("_won.bidder", "owner").alias("owner"))
            state = cut(state)
            free = cut(bidders.join(state.where("owner IS NOT NULL").select(*keys, F.col("owner").alias("bidder")), [*keys, "bidder"], "left_anti"))
        if raised == 1:
            break
        raised = max(1, raised // 8)
    placed = state.select(*keys, F.col("owner").alias("_p"), F.col("object").alias("_g"))
    named = pairs.withColumns({"_p": F.concat(F.lit("p"), F.col("pred").cast("string")), "_g": F.concat(F.lit("g"), F.col("gt").cast("string"))})
    return named.join(placed, [*keys, "_p", "_g"], "left_semi").select(*keys, "pred", "gt", "iou")
