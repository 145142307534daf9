"""Row filters of point clouds: planes, percentiles, neighbourhoods, robust distances, sizes, densities and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.lineage import cut

from . import blocks, spatial


def to_plane(points: DataFrame, planes: DataFrame) -> DataFrame:
    """Adds `distance`, that of each point to the plane (pa, pb, pc, pd) of its scene; planes has a row for each scene."""
    a, b, c, d = (F.col(f"p{k}") for k in "abcd")
    value = F.abs(a * F.col("x") + b * F.col("y") + c * F.col("z") + d)
    return points.join(planes, "scene_id").withColumn("distance", F.try_divide(value, F.sqrt(a * a + b * b + c * c))).drop("pa", "pb", "pc", "pd")


def below_percentile(points: DataFrame, share: float, column: str = "z", keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Rows at or below the exact percentile (linear interpolation) of their group."""
    limit = points.groupBy(*keys).agg(F.percentile(column, F.lit(share)).alias("_limit"))
    return points.join(limit, list(keys)).where(F.col(column) <= F.col("_limit")).drop("_limit")


def statistical_outliers(points: DataFrame, k: int, ratio: float, cell: float) -> DataFrame:
    """Adds `mean_distance` to the k nearest points (the point itself among them) and `keep`: below mean + ratio * std of its scene."""
    near = blocks.neighbour_lists(points, points, k).select("scene_id", "left_id", blocks.mean_distance().alias("mean_distance"))
    limits = near.groupBy("scene_id").agg((F.avg("mean_distance") + F.lit(ratio) * F.stddev_samp("mean_distance")).alias("_limit"))
    return near.join(limits, "scene_id").withColumn("keep", F.col("mean_distance") < F.col("_limit")).drop("_limit").withColumnRenamed("left_id", "point_id")


def radius_outliers(points: DataFrame, radius: float, least: int) -> DataFrame:
    """Points with more than `least` points, themselves included, strictly within the radius."""
    return spatial.neighbour_counts(points, radius).where(F.col("neighbours") > least)


def away_from_median(points: DataFrame, keys: tuple[str, ...], factor: float = 3.5, least: int = 100) -> DataFrame:
    """Rows within median + factor * 1.4826 * MAD of the distances to the per-axis median; groups of fewer than `least`
    rows, or without spread, stay whole."""
    centre = points.groupBy(*keys).agg(*[F.median(c).alias(f"_{c}") for c in "xyz"], F.count("*").alias("_n"))
    far = points.join(centre, list(keys)).withColumn("_d", spatial.length(*[F.col(c) - F.col(f"_{c}") for c in "xyz"]))
    middle = far.groupBy(*keys).agg(F.median("_d").alias("_m"))
    gaps = far.join(middle, list(keys)).withColumn("_gap", F.abs(F.col("_d") - F.col("_m")))
    spread = gaps.groupBy(*keys).agg(F.median("_gap").alias("_mad"))
    out = gaps.join(spread, list(keys))
    return out.where((F.col("_n") < least) | (F.col("_mad") < 1e-9) | (F.col("_d") <= F.col("_m") + F.lit(factor * 1.4826) * F.col("_mad"))).select(*points.columns)


def dense_enough(points: DataFrame, keys: tuple[str, ...], least: int, per_metre: float) -> DataFrame:
    """Groups with enough points, and enough along their longest axis."""
    span = F.greatest(*[F.max(c) - F.min(c) for c in "xyz"])
    sizes = points.groupBy(*keys).agg(F.count("*").alias("n"), span.alias("span"))
    return sizes.where((F.col("n") >= least) & (F.col("span") > 0) & (F.try_divide(F.col("n"), F.col("span")) >= per_metre))


def sized(points: DataFrame, label: str, least: int, most: int, drop_oversized: bool = True) -> DataFrame:
    """Labels of clusters that are too small (or too large) become null; the count is aggregated before it is joined."""
    counts = points.groupBy("scene_id", label).agg(F.count("*").alias("_n")).where(F.col(label).isNotNull())
    fits = (F.col("_n") >= least) & ((F.col("_n") <= most) if drop_oversized else F.lit(True))
    good = counts.where(fits).select("scene_id", label, F.lit(True).alias("_good"))
    out = points.join(good, ["scene_id", label], "left")
    return out.withColumn(label, F.when(F.col("_good"), F.col(label))).drop("_good")


def probability(logit0: str = "logit0", logit1: str = "logit1") -> Column:
    """Softmax probability of class 1 of two."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.col(logit0) - F.col(logit1)))


def adapted_threshold(scores: DataFrame, score: str, threshold: float, low: float, high: float, bounds: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """scene_id and threshold, moved to a quantile where the kept share is outside [low, high]."""
    t = F.lit(threshold)
    share = F.avg(F.when(F.col(score) > t, 1.0).otherwise(0.0))
    stats = scores.groupBy("scene_id").agg(
        share.alias("kept"), F.percentile(score, F.lit(1 - low)).alias("_least"), F.percentile(score, F.lit(1 - high)).alias("_most")
    )
    moved = F.when(F.col("kept") < low, F.col("_least")).when(F.col("kept") > high, F.col("_most")).otherwise(t)
    clipped = F.when((F.col("kept") < low) | (F.col("kept") > high), F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), moved))).otherwise(moved)
    return stats.select("scene_id", "kept", clipped.alias("threshold"))


def in_box(points: DataFrame, centre: tuple[float, float, float], size: tuple[float, float, float]) -> DataFrame:
    tests = [F.col(c).between(m - s / 2, m + s / 2) for c, m, s in zip("xyz", centre, size)]
    return points.where(tests[0] & tests[1] & tests[2])


def above_local_ground(points: DataFrame, k: int, share: float, low: float, high: float, radius: float, cell: float) -> DataFrame:
    """Adds `height` over the local ground (percentile of z over the k nearest in XY) and keeps points above `low`, or
    within the radius of one above `high`."""
    levels = F.array_sort(F.filter("found.z", lambda z: z.isNotNull()))
    near = blocks.neighbour_lists(points, points, k, "xy", ("z",)).select("scene_id", F.col("left_id").alias("point_id"), levels.alias("_z"))
    place = F.lit(share) * (F.size("_z") - 1)
    below, above = (F.get("_z", f(place).cast("int")) for f in (F.floor, F.ceil))
    level = F.when(below == above, below).otherwise((F.ceil(place) - place) * below + (place - F.floor(place)) * above)
    ground = near.select("scene_id", "point_id", level.alias("ground")).where("ground IS NOT NULL")
    heights = cut(points.join(ground, ["scene_id", "point_id"]).withColumn("height", F.col("z") - F.col("ground")).drop("ground"))
    lower, tall = heights.where(~(F.col("height") > low)), heights.where(F.col("height") > high)
    beside = spatial.nearest_within(lower, tall, radius).select("scene_id", F.col("left_id").alias("point_id"))
    return heights.where(F.col("height") > low).unionByName(lower.join(beside, ["scene_id", "point_id"], "left_semi"))
