"""Pairs of boxes that meet, of clusters by their extents, by cells of the boxes' own sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells are this power of two wide at least.
FINEST = -20


def _level(boxes: DataFrame, axes: str) -> DataFrame:
    """boxes with `level`: cells of 2 ** level are as wide as the longest side or wider, so that a box touches two of them
    along an axis at most."""
    longest = F.least(F.lit(1e300), F.greatest(F.lit(0.0), *[F.col(f"{c}1") - F.col(f"{c}0") for c in axes]))
    level = F.when(longest <= 2.0**FINEST, F.lit(FINEST)).otherwise(F.ceil(F.log2(longest)) + 1)
    return boxes.withColumn("level", level.cast("int"))


def _number(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level))


def box_pairs(boxes: DataFrame, key: str, axes: str = "xyz", keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """keys, a and b (structs of a box's columns, a's key below b's) of every two boxes of a group that share a point; touching
    counts. boxes: keys, key (unique within keys) and, for each axis c, c0 <= c1.

    A box lies in cells of its own size, two along an axis at most, and is looked for in those of every larger size that its
    group has; the number of sizes is that of doublings from the smallest to the largest box, not that of boxes. Each pair
    is told in one cell, that of the low corner of what the two share. So no two boxes that are far apart meet, whatever
    the number of boxes of a scene. Boxes with a null, NaN or infinite bound meet nothing.
    """
    rest = [c for c in boxes.columns if c not in keys]
    bounds = [F.col(f"{c}{k}") for c in axes for k in "01"]
    sound = boxes
    for bound in bounds:
        sound = sound.where(F.abs(bound) < float("inf"))
    sized = _level(sound, axes)
    levels = sized.groupBy(*keys).agg(F.collect_set("level").alias("_levels"))

    def placed(df: DataFrame, side: str, at: Column) -> DataFrame:
        out = df.select(*keys, F.struct(*rest).alias(side), F.col("level").alias(f"_{side}"), at.alias("_at"), *[F.col(f"{c}{k}") for c in axes for k in "01"])
        for c in axes:
            out = out.withColumn(f"_i{c}", F.explode(F.sequence(_number(F.col(f"{c}0"), F.col("_at")), _number(F.col(f"{c}1"), F.col("_at")))))
        return out.drop(*[f"{c}{k}" for c in axes for k in "01"])

    fine = placed(sized.join(levels, list(keys)).withColumn("_to", F.explode(F.filter("_levels", lambda x: x >= F.col("level")))), "p", F.col("_to"))
    coarse = placed(sized, "q", F.col("level"))
    met = fine.join(coarse, [*keys, "_at", *[f"_i{c}" for c in axes]])
    met = met.where((F.col("_p") < F.col("_q")) | (F.col(f"p.{key}") < F.col(f"q.{key}")))
    for c in axes:
        low = F.greatest(f"p.{c}0", f"q.{c}0")
        met = met.where((low <= F.least(f"p.{c}1", f"q.{c}1")) & (F.col(f"_i{c}") == _number(low, F.col("_at"))))
    first = F.col(f"p.{key}") < F.col(f"q.{key}")
    return met.select(*keys, F.when(first, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("b"))
