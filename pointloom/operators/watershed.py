"""Marker-based watershed of the distance transform of occupied cells, as joins and aggregations over cells of all scenes.

Cells have a total order: the higher comes first, then the smaller index. Every cell but the markers climbs to the
first of its six neighbours if that comes before it; what climbs to one top or marker is a basin. Two basins meet at
their best saddle, the pair of neighbouring cells whose later one comes first of all. Flooding from the top joins basins
in the order of saddles and keeps marked ones apart: a group of basins without a marker joins the neighbour behind its
best saddle, whatever else happens first, so all such groups join at once in each round. Groups that reach no marked one
stay unlabelled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.lineage import cut

from . import graph, spatial

_AXES = "xyz"
_CELL = ["scene_id", "ix", "iy", "iz"]
_SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
_AROUND = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)]


def _moved(cells: DataFrame, steps: list[tuple[int, int, int]]) -> DataFrame:
    """Rows once for each step from their cell that stays in the scene's box (nx, ny, nz)."""
    to = F.array(*[F.struct(*[(F.col(f"i{c}") + d).alias(f"i{c}") for c, d in zip(_AXES, s)]) for s in steps])
    out = cells.withColumn("_to", F.explode(to)).withColumns({f"i{c}": F.col(f"_to.i{c}") for c in _AXES}).drop("_to")
    return out.where(" AND ".join(f"i{c} BETWEEN 0 AND n{c} - 1" for c in _AXES))


def boxes(points: DataFrame, cell: float, most_cells: int) -> DataFrame:
    """scene_id, the least coordinates, res and nx, ny, nz: the size of cells, grown by tenths until the box has at most
    `most_cells`, and the cells along each axis."""
    ends = points.groupBy("scene_id").agg(*[f(c).alias(f"{n}{c}") for c in _AXES for n, f in (("lo", F.min), ("hi", F.max))])
    count = lambda c, size: F.ceil((F.col(f"hi{c}") - F.col(f"lo{c}")) / size) + 1
    total = lambda size: count("x", size).cast("double") * count("y", size) * count("z", size)
    sizes = F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: F.lit(cell) * F.pow(F.lit(1.1), i))
    out = ends.withColumn("res", F.get(F.filter(sizes, lambda s: total(s) <= most_cells), F.lit(0)))
    return out.select("scene_id", *[f"lo{c}" for c in _AXES], "res", *[count(c, F.col("res")).cast("long").alias(f"n{c}") for c in _AXES])


def depths(solid: DataFrame) -> DataFrame:
    """Cells (with nx, ny, nz) and `depth`, the distance in cells to the nearest empty cell of the box, 0 where it has none."""
    around = _moved(solid, _AROUND).select(*_CELL).distinct()
    at = {c: F.col(f"i{c}").cast("double") for c in _AXES}
    name = F.xxhash64(*_CELL)
    empty = around.join(solid, _CELL, "left_anti").withColumns({**at, "point_id": name})
    full = cut(solid.withColumns({**at, "point_id": F.col("id")}))
    near = spatial.nearest_join(full, empty, 2.0).select("scene_id", F.col("left_id").alias("id"), F.col("distance").alias("depth"))
    return solid.join(near, ["scene_id", "id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0.0)))


def smoothed(cells: DataFrame, sigma: float) -> DataFrame:
    """Cells with `height`: the Gaussian of `depth` (0 outside of the cells), cut at four sigma, mirrored at the box's sides,
    one axis after the other."""
    if sigma <= 0:
        return cells.withColumn("height", F.round("depth", 9))
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = [w / sum(weights) for w in weights]
    grid = cells.select(*_CELL, "nx", "ny", "nz", F.col("depth").alias("height"))
    for c in _AXES:
        i, n = F.col(f"i{c}"), F.col(f"n{c}")
        images = F.filter(F.array(*[image + 2 * n * m for m in range(-3, 4) for image in (i, -1 - i)]), lambda a: a.between(-radius, n - 1 + radius))
        spread = grid.withColumn("_at", F.explode(images)).withColumn("_w", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-radius, radius + 1), weights)])))
        spread = spread.withColumn(f"i{c}", F.col("_at") - F.col("_w.k")).where(F.col(f"i{c}").between(0, n - 1))
        grid = spread.groupBy(*_CELL, "nx", "ny", "nz").agg(F.sum(F.col("height") * F.col("_w.w")).alias("height"))
    return cells.join(grid.select(*_CELL, F.round("height", 9).alias("height")), _CELL)


def _order() -> Column:
    return F.struct((-F.col("height")).alias("h"), "ix", "iy", "iz", "id")


def ordered(cells: DataFrame) -> DataFrame:
    """cells with `order` (of the cell) and `best`, the first order of the cell and its six neighbours."""
    own = cells.withColumn("order", _order())
    near = _moved(own.select(*_CELL, "nx", "ny", "nz", "order"), [(0, 0, 0), *_SIX]).groupBy(*_CELL).agg(F.min("order").alias("best"))
    return cut(own.join(near, _CELL))


def basins(cells: DataFrame, markers: DataFrame) -> DataFrame:
    """cells with `top`, the order of the top or marker (scene_id, order) that the cell climbs to."""
    marked = markers.select("scene_id", F.col("order.id").alias("id"), F.lit(True).alias("_marked"))
    now = cells.join(marked, ["scene_id", "id"], "left").withColumn("top", F.when(F.col("_marked"), F.col("order")).otherwise(F.col("best"))).drop("_marked", "best")
    now = cut(now)
    while True:
        up = now.select("scene_id", F.col("id").alias("_at"), F.col("top").alias("_next"))
        moved = cut(now.withColumn("_at", F.col("top.id")).join(up, ["scene_id", "_at"]).drop("_at"))
        now = moved.withColumn("top", F.col("_next")).drop("_next")
        if moved.where("top.id != _next.id").isEmpty():
            return now


def peaks(cells: DataFrame) -> DataFrame:
    """scene_id and order of the cells with a height above `least_height` that no higher cell is within `apart` cells of along
    all axes; of equally high ones so near, the first in the order, and what no chosen one is near."""
    tile = {f"t{c}": F.floor(F.col(f"i{c}") / (F.col("apart") + 1)) for c in _AXES}
    names = ["scene_id", *tile]
    placed = cells.withColumns(tile)
    tops = placed.where((F.col("order.h") == F.col("best.h")) & (F.col("height") > F.col("least_height")))
    steps = F.array(*[F.struct(*[(F.col(f"t{c}") + d).alias(f"t{c}") for c, d in zip(_AXES, s)]) for s in _AROUND])
    spread = tops.select("scene_id", "apart", F.col("order").alias("own"), *tile).withColumn("_to", F.explode(steps)).drop(*tile).select("*", "_to.*").drop("_to")
    inside = lambda a, b: F.greatest(*[F.abs(F.col(f"{a}.i{c}") - F.col(f"{b}.i{c}")) for c in _AXES]) <= F.col("apart")
    beats = (F.col("other.h") < F.col("own.h")) & inside("own", "other")
    # the first cell of a tile rules most tops out; the rest is compared with all cells of the tiles around
    firsts = placed.groupBy(*names).agg(F.min("order").alias("other"))
    out = spread.join(firsts, names).where(beats).select("scene_id", F.col("own.id").alias("id")).distinct()
    left = cut(spread.withColumn("id", F.col("own.id")).join(out, ["scene_id", "id"], "left_anti"))
    out = left.join(placed.select(*names, F.col("order").alias("other")), names).where(beats).select("scene_id", "id").distinct()
    good = cut(left.join(out, ["scene_id", "id"], "left_anti"))
    own = good.select("scene_id", "apart", F.col("own").alias("order")).distinct()
    there = good.select(*names, "apart", "own").join(own.select("scene_id", F.col("order").alias("other"), *[F.floor(F.col(f"order.i{c}") / (F.col("apart") + 1)).alias(f"t{c}") for c in _AXES]), names)
    beaten = cut(there.where((F.col("other") < F.col("own")) & inside("own", "other")).select("scene_id", F.col("own").alias("order"), F.col("other").alias("by")).distinct())
    live, kept = cut(own.select("scene_id", "order")), None
    while not live.isEmpty():
        waits = beaten.join(live.select("scene_id", F.col("order").alias("by")), ["scene_id", "by"], "left_semi")
        stay = cut(live.join(waits.select("scene_id", "order"), ["scene_id", "order"], "left_anti"))
        kept = stay if kept is None else kept.unionByName(stay)
        gone = beaten.join(stay.select("scene_id", F.col("order").alias("by")), ["scene_id", "by"], "left_semi").select("scene_id", "order")
        live = cut(live.join(stay, ["scene_id", "order"], "left_anti").join(gone, ["scene_id", "order"], "left_anti"))
    return kept if kept is not None else live


def flooded(cells: DataFrame, markers: DataFrame) -> DataFrame:
    """scene_id, id (of a top) and group, for the basins (of cells with order and top) that flooding from the markers
    (scene_id, order) reaches; a group holds one marker."""
    other = _moved(cells.select(*_CELL, "nx", "ny", "nz", F.col("order").alias("a"), F.col("top.id").alias("u")), [s for s in _SIX if s > (0, 0, 0)])
    pairs = other.join(cells.select(*_CELL, F.col("order").alias("b"), F.col("top.id").alias("v")), _CELL).where("u != v")
    key = F.struct(F.greatest("a", "b").alias("later"), F.least("a", "b").alias("first"))
    saddles = pairs.select("scene_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), key.alias("key")).groupBy("scene_id", "u", "v").agg(F.min("key").alias("key"))
    marked = markers.select("scene_id", F.col("order.id").alias("id"), F.lit(True).alias("marked"))
    tops = cells.select("scene_id", F.col("top.id").alias("id")).distinct()
    now = cut(tops.join(marked, ["scene_id", "id"], "left").select("scene_id", "id", F.col("id").alias("group"), F.coalesce("marked", F.lit(False)).alias("marked")))
    edges = cut(saddles)
    while True:
        groups = now.groupBy("scene_id", "group").agg(F.max("marked").alias("marked"))
        both = edges.select("scene_id", F.col("u").alias("group"), F.col("v").alias("to"), "key").unionByName(edges.select("scene_id", F.col("v").alias("group"), F.col("u").alias("to"), "key"))
        open_ = both.join(groups.where("NOT marked"), ["scene_id", "group"], "left_semi")
        picks = cut(open_.groupBy("scene_id", "group").agg(F.min(F.struct("key", "to"))["to"].alias("to")))
        if picks.isEmpty():
            held = groups.where("marked").select("scene_id", "group")
            return now.join(held, ["scene_id", "group"], "left_semi").select("scene_id", "id", "group")
        joined = cut(graph.components(picks.select("scene_id", F.col("group").alias("u"), F.col("to").alias("v"))).where("node != component"))
        name = lambda df, c: df.join(joined.withColumnsRenamed({"node": c, "component": "_to"}), ["scene_id", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        now = cut(name(now, "group"))
        renamed = name(name(edges, "u"), "v").where("u != v")
        edges = cut(renamed.groupBy("scene_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("key").alias("key")))


def watershed(points: DataFrame, cell: float, separation: float, sigma: float = 1.0, dilation: int = 1, least_depth: float = 0.0, most_cells: int = 50_000_000) -> DataFrame:
    """Adds `label`, the smallest point id of the basin group of a peak, null where flooding reaches no peak.

    Occupied cells are dilated `dilation` times along the axes; heights are smoothed distances to empty cells, sigma in
    cells; peaks are `separation` apart and higher than `least_depth`, both in the points' unit."""
    box = cut(boxes(points, cell, most_cells))
    index = {f"i{c}": F.least(F.floor((F.col(c) - F.col(f"lo{c}")) / F.col("res")), F.col(f"n{c}") - 1) for c in _AXES}
    placed = cut(points.join(box, "scene_id").withColumns(index).select(*points.columns, "ix", "iy", "iz"))
    sides = box.select("scene_id", "nx", "ny", "nz")
    solid = placed.select(*_CELL).distinct().join(sides, "scene_id")
    for _ in range(dilation):
        solid = _moved(solid, [(0, 0, 0), *_SIX]).distinct()
    number = (F.col("ix") * F.col("ny") + F.col("iy")) * F.col("nz") + F.col("iz")
    rules = box.select("scene_id", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(separation) / F.col("res"))).alias("apart"), (F.lit(least_depth) / F.col("res")).alias("least_height"))
    hill = ordered(smoothed(cut(depths(cut(solid.withColumn("id", number)))), sigma).join(rules, "scene_id"))
    markers = cut(peaks(hill))
    hill = basins(hill, markers)
    groups = flooded(hill, markers)
    owned = cut(placed.join(hill.select(*_CELL, F.col("top.id").alias("id")), _CELL).join(groups, ["scene_id", "id"]).select("scene_id", "point_id", "group"))
    names = owned.groupBy("scene_id", "group").agg(F.min("point_id").alias("label"))
    return points.join(owned.join(names, ["scene_id", "group"]).select("scene_id", "point_id", "label"), ["scene_id", "point_id"], "left")
