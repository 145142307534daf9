"""Run-length coding of masks as text "start length start length ...", starts counted from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def encoded(mask: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """keys, length and counts of each mask; place counts from 0, value is boolean.

    Runs are gaps and islands: places minus their rank among the set ones. The window is over one mask."""
    length = mask.groupBy(*keys).agg((F.max(place) + 1).alias("length"))
    inside = mask.where(F.col(value)).withColumn("_run", F.col(place) - F.row_number().over(W.partitionBy(*keys).orderBy(place)))
    runs = inside.groupBy(*keys, "_run").agg((F.min(place) + 1).alias("start"), F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "n"))), lambda r: F.concat_ws(" ", r["start"].cast("string"), r["n"].cast("string"))), " ")
    return length.join(runs.groupBy(*keys).agg(text.alias("counts")), keys, "left").withColumn("counts", F.coalesce("counts", F.lit("")))


def decoded(coded: DataFrame, keys: list[str]) -> DataFrame:
    """keys and place of every set place."""
    parts = F.transform(F.filter(F.split("counts", " "), lambda s: s != ""), lambda s: s.cast("long"))
    out = coded.withColumn("_p", parts).where(F.size("_p") > 0)
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(0), F.expr("size(_p) div 2 - 1").cast("int"))))
    start, n = F.get("_p", F.col("_i") * 2), F.get("_p", F.col("_i") * 2 + 1)
    return out.select(*keys, F.explode(F.sequence(start - 1, start + n - 2)).alias("place"))


def packed(label: Column, instance: Column) -> Column:
    """Class in the low 16 bits, instance above."""
    return label.bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.shiftleft(instance, 16))
