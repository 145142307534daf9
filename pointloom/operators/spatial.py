"""Range and nearest-neighbour joins over points, keyed by grid cells so that Spark plans them as equi-joins.

A radius join uses cells of the radius' size: each right row goes to its 27 surrounding cells, and the pair is tested
after the equi-join on scene and cell. Distances are strict (< radius). Joins of a table with itself take half of the
cells around and each pair once, over positions instead of points: points that share a position are one row with a count,
so that repeated points make no pairs. Nearest joins and counts of neighbours look for them in tasks that hold a block of a
scene (`blocks`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks


def length(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def cells(points: DataFrame, size: float, axes: str = "xyz") -> DataFrame:
    """Adds the integer cell of each axis as ix, iy, iz."""
    return points.withColumns({f"i{c}": F.floor(F.col(c) / F.lit(size)) for c in axes})


def _around(points: DataFrame, size: float, axes: str) -> DataFrame:
    """Every row once for each cell around its own."""
    out = cells(points, size, axes)
    for c in axes:
        out = out.withColumn(f"i{c}", F.explode(F.sequence(F.col(f"i{c}") - 1, F.col(f"i{c}") + 1)))
    return out


def _sides(left: DataFrame, right: DataFrame, extra: tuple[str, ...], extra_left: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    a = left.select("scene_id", F.col("point_id").alias("left_id"), "x", "y", "z", *extra_left)
    b = right.select("scene_id", F.col("point_id").alias("right_id"), *[F.col(c).alias(f"{c}2") for c in "xyz"], *extra)
    return a, b


def _candidates(a: DataFrame, b: DataFrame, size: float, axes: str) -> DataFrame:
    keys = ["scene_id", *[f"i{c}" for c in axes]]
    spread = _around(b.withColumns({c: F.col(f"{c}2") for c in axes}), size, axes).drop(*axes)
    pairs = cells(a, size, axes).join(spread, keys).drop(*keys[1:])
    return pairs.withColumn("distance", length(*[F.col(c) - F.col(f"{c}2") for c in axes]))


def radius_join(left: DataFrame, right: DataFrame, radius: float, axes: str = "xyz", extra: tuple[str, ...] = (), extra_left: tuple[str, ...] = (), closed: bool = False) -> DataFrame:
    """scene_id, left_id, right_id, distance (and the named columns of either side) of all pairs nearer than the radius,
    or with closed also those at the radius.

    The side that is copied to the surrounding cells is the right one: give the smaller side there.
    """
    a, b = _sides(left, right, extra, extra_left)
    near = F.col("distance") <= radius if closed else F.col("distance") < radius
    return _candidates(a, b, radius, axes).where(near).select("scene_id", "left_id", "right_id", "distance", *extra_left, *extra)


#: The own cell and the half of the cells around it that come later in order.
_HALF = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (dx, dy, dz) >= (0, 0, 0)]


def positions(points: DataFrame, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """keys, x, y, z, n (points there) and point_id (the smallest)."""
    return points.groupBy(*keys, *"xyz").agg(F.count("*").alias("n"), F.min("point_id").alias("point_id"))


def position_pairs(spots: DataFrame, radius: float, keys: tuple[str, ...] = ("scene_id",), closed: bool = False) -> DataFrame:
    """keys, a and b (structs of a position's other columns) and distance of every two positions within the radius, once."""
    rest = [c for c in spots.columns if c not in keys]
    placed = cells(spots, radius)
    around = F.array(*[F.struct(*[(F.col(f"i{c}") + d).alias(f"i{c}") for c, d in zip("xyz", step)], F.lit(step == (0, 0, 0)).alias("own")) for step in _HALF])
    left = placed.select(*keys, F.struct(*rest).alias("a"), F.inline(around))
    right = placed.select(*keys, F.struct(*rest).alias("b"), "ix", "iy", "iz")
    place = lambda side: F.struct(*[f"{side}.{c}" for c in "xyz"])
    pairs = left.join(right, [*keys, "ix", "iy", "iz"]).where(~F.col("own") | (place("a") < place("b")))
    pairs = pairs.withColumn("distance", length(*[F.col(f"a.{c}") - F.col(f"b.{c}") for c in "xyz"]))
    return pairs.where(F.col("distance") <= radius if closed else F.col("distance") < radius).select(*keys, "a", "b", "distance")


def neighbour_counts(points: DataFrame, radius: float, keys: tuple[str, ...] = ("scene_id",), closed: bool = False) -> DataFrame:
    """points with `neighbours`, the number of points within the radius, the point itself counted; no pair of points is made."""
    counts = blocks.neighbour_counts(positions(points, keys).drop("point_id"), radius, keys, closed)
    return points.join(counts, [*keys, *"xyz"], "left")


def knn_join(left: DataFrame, right: DataFrame, k: int, cell: float, axes: str = "xyz", extra: tuple[str, ...] = ()) -> DataFrame:
    """scene_id, left_id, right_id, distance and rank (1 to k by distance, then right_id) of the nearest right points.

    Scenes with fewer than k right points give all that they have. Blocks follow each scene's density, whatever `cell` is."""
    near = blocks.neighbour_lists(left, right, k, axes, extra)
    return near.select("scene_id", "left_id", F.posexplode("found").alias("_at", "_f")).select("scene_id", "left_id", "_f.right_id", "_f.distance", (F.col("_at") + 1).alias("rank"), *[f"_f.{c}" for c in extra])


def nearest_join(left: DataFrame, right: DataFrame, cell: float, axes: str = "xyz", extra: tuple[str, ...] = ()) -> DataFrame:
    """The nearest right point of every left point, the smaller id on equal distances."""
    return knn_join(left, right, 1, cell, axes, extra).drop("rank")


def nearest_within(left: DataFrame, right: DataFrame, radius: float, axes: str = "xyz", extra: tuple[str, ...] = ()) -> DataFrame:
    """The nearest right point nearer than the radius, of the left points that have one."""
    return blocks.neighbour_lists(left, right, 1, axes, extra, radius).select("scene_id", "left_id", F.inline("found"))


def tiles(points: DataFrame, size: float, stride: float, least: int = 1) -> DataFrame:
    """Each point once for every half-open XY tile [x0, x0 + size) that holds it; tiles start at the scene's minimum, a
    stride apart; tiles of fewer than `least` points are left out."""
    low = points.groupBy("scene_id").agg(F.min("x").alias("_x"), F.min("y").alias("_y"), F.max("x").alias("_x1"), F.max("y").alias("_y1"))
    out = points.join(low, "scene_id")
    for c in "xy":
        d, last = F.col(c) - F.col(f"_{c}"), F.floor((F.col(f"_{c}1") - F.col(f"_{c}")) / stride)
        first = F.greatest(F.lit(0), F.floor((d - size) / stride) + 1).cast("int")
        out = out.withColumn(f"tile_{c}", F.explode(F.sequence(first, F.greatest(first, F.least(last, F.floor(d / stride)).cast("int")))))
    inside = [(F.col(c) - F.col(f"_{c}") >= F.col(f"tile_{c}") * stride) & (F.col(c) - F.col(f"_{c}") < F.col(f"tile_{c}") * stride + size) for c in "xy"]
    out = out.where(inside[0] & inside[1]).drop("_x", "_y", "_x1", "_y1")
    if least > 1:
        big = out.groupBy("scene_id", "tile_x", "tile_y").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
        out = out.join(big, ["scene_id", "tile_x", "tile_y"], "left_semi")
    return out


def _anchored_numbers(at: Column, low: Column, high: Column, size: float, stride: float) -> Column:
    """Numbers of the tiles that hold a place; the last tile ends at high."""
    last = F.greatest(F.lit(0), F.ceil((high - low - size) / stride)).cast("int")
    # one number more at both sides, for rounding
    first = F.least(last, F.greatest(F.lit(0), F.floor((at - low - size) / stride)).cast("int"))
    end = F.greatest(first, F.least(last, F.floor((at - low) / stride).cast("int") + 1))

    def inside(k: Column) -> Column:
        begin = F.greatest(low, F.least(low + k * stride, high - size))
        return at.between(begin, begin + size)

    return F.filter(F.array_distinct(F.array_append(F.sequence(first, end), last)), inside)


def anchored_tiles(points: DataFrame, size: float, stride: float) -> DataFrame:
    """Tiles whose last one is moved back so that it ends at the scene's maximum; closed at both ends. The numbers of a
    point's tiles follow from its place."""
    box = points.groupBy("scene_id").agg(*[f(c).alias(f"_{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"])
    out = points.join(box, "scene_id")
    for c in "xy":
        out = out.withColumn(f"tile_{c}", F.explode(_anchored_numbers(F.col(c), F.col(f"_lo{c}"), F.col(f"_hi{c}"), size, stride)))
    return out.drop("_lox", "_loy", "_hix", "_hiy")
