"""Statistics over paired experiments: errors, gains, rank tests, corrections, regressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trait_errors(pairs: DataFrame, traits: list[str], keys: list[str]) -> DataFrame:
    """One row for each pair and trait: absolute error, and relative error in percent (null where the truth is 0)."""
    stack = ", ".join(f"'{t}', pred_{t}, gt_{t}" for t in traits)
    long = pairs.selectExpr(*keys, f"stack({len(traits)}, {stack}) AS (trait, pred, gt)")
    error = F.abs(F.col("pred") - F.col("gt"))
    return long.withColumns({"error": error, "relative": F.try_divide(error, F.abs("gt")) * 100})


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal: a continued fraction beyond 3, the series of erf below."""
    x = F.abs(z) / math.sqrt(2.0)
    series = F.array(*[F.lit((-1.0) ** k / (math.factorial(k) * (2 * k + 1))) for k in range(39, -1, -1)])
    near = F.lit(1.0) - F.aggregate(series, F.lit(0.0), lambda total, c: total * x * x + c) * x * (2 / math.sqrt(math.pi))
    halves = F.array(*[F.lit(k / 2.0) for k in range(40, 0, -1)])
    far = F.exp(-x * x) / (x + F.aggregate(halves, F.lit(0.0), lambda below, c: c / (x + below))) / math.sqrt(math.pi)
    return F.when(x < 2.1, near).otherwise(far)


def signed_rank(pairs: DataFrame, keys: list[str], delta: str = "delta") -> DataFrame:
    """Wilcoxon's signed-rank test of each group: zeros dropped, average ranks, normal approximation with the tie
    correction and no continuity correction. Groups without nonzero deltas are left out.

    Ranks are counted over distinct absolute values, whose number of rows comes from an aggregation."""
    some = pairs.where((F.col(delta) != 0) & F.col(delta).isNotNull()).withColumn("_size", F.abs(delta))
    ties = some.groupBy(*keys, "_size").agg(F.count("*").alias("_t"), F.count_if(F.col(delta) > 0).alias("_up"))
    upto = F.sum("_t").over(W.partitionBy(*keys).orderBy("_size"))
    ranked = ties.withColumn("_rank", upto - (F.col("_t") - 1) / 2.0)
    t = F.col("_t").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum("_t").alias("n"), F.sum(F.col("_rank") * F.col("_up")).alias("w"), F.sum(t * t * t - t).alias("_ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    return sums.withColumn("z", F.try_divide(F.col("w") - n * (n + 1) / 4, spread)).withColumn("p", normal_tail(F.col("z"))).drop("_ties")


def holm(tests: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """Adds Holm's step-down adjusted p within each family (ties by the remaining columns' order are equal anyway)."""
    by = W.partitionBy(*family)
    order = by.orderBy(p)
    ranked = tests.withColumn("_step", (F.count("*").over(by) - F.row_number().over(order) + 1) * F.col(p))
    running = F.max("_step").over(order.rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("holm", F.least(F.lit(1.0), running)).drop("_step")


def bootstrap(pairs: DataFrame, keys: list[str], rounds: int = 10_000, delta: str = "delta") -> DataFrame:
    """Percentile interval of the mean under resampling: every row of a group enters each round a Poisson(1) number of
    times, drawn from a hash of row and round, so that no task needs a whole group."""
    u = F.pmod(F.xxhash64(*keys, "row", "round"), F.lit(1 << 24)) / float(1 << 24)
    limits, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        limits.append(total)
    times = F.lit(0)
    for c in limits:
        times = times + F.when(u >= c, 1).otherwise(0)
    drawn = pairs.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_k", times)
    means = drawn.groupBy(*keys, "round").agg(F.try_divide(F.sum(F.col("_k") * F.col(delta)), F.sum("_k")).alias("_m"))
    return means.groupBy(*keys).agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def effect(pairs: DataFrame, keys: list[str], base: str, refined: str) -> DataFrame:
    """Number, means, mean change, relative change and Cohen's dz of paired values."""
    d = F.col(refined) - F.col(base)
    out = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(base).alias("mean_base"), F.avg(refined).alias("mean_refined"), F.avg(d).alias("change"), F.stddev_samp(d).alias("_s"))
    return out.withColumns({"relative": F.try_divide(F.col("change"), F.col("mean_base")) * 100, "dz": F.try_divide(F.col("change"), F.col("_s"))}).drop("_s")


def gains(base: DataFrame, refined: DataFrame, keys: list[str], by: list[str], value: str = "value", tolerance: float = 1e-12) -> DataFrame:
    """Positive, equal and negative changes over the paired rows of each group, their extremes and mean, and the keys of
    negative ones as ordered text."""
    both = base.join(refined.withColumnRenamed(value, "_new"), keys).withColumn("delta", F.col("_new") - F.col(value))
    rest = [k for k in keys if k not in by]
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in rest])
    lost = F.array_sort(F.collect_list(F.when(F.col("delta") < -tolerance, F.struct(*[F.col(k) for k in rest], name.alias("_name")))))
    return both.groupBy(*by).agg(
        F.count_if(F.col("delta") > tolerance).alias("positive"), F.count_if(F.abs("delta") <= tolerance).alias("equal"), F.count_if(F.col("delta") < -tolerance).alias("negative"),
        F.min("delta").alias("least"), F.max("delta").alias("most"), F.avg("delta").alias("mean"), F.array_join(F.transform(lost, lambda x: x["_name"]), ",").alias("lost"),
    )


def macro_and_micro(rows: DataFrame, keys: list[str], value: str, hits: str, total: str) -> DataFrame:
    """Mean over scenes, and the ratio of sums."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("macro"), F.try_divide(F.sum(hits), F.sum(total)).alias("micro"), F.stddev_samp(value).alias("std"))
