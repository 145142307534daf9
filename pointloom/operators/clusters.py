"""Clustering of points into instances; labels are null for noise, and the smallest id of a cluster names it.

Every method is made of range joins, aggregations and components over all scenes at once: no task holds a scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.lineage import cut

from . import blocks, graph, sampling, spatial
from .watershed import watershed


def dbscan(points: DataFrame, eps: float, least: int, same: str | None = None) -> DataFrame:
    """Adds `label`. Core points have `least` points, themselves counted, within eps; core points within eps of each
    other share a cluster; others within eps of a core point join the cluster of the smallest name. With `same`,
    neighbours must agree in that column.

    The work is on positions and on cells so small that all of a cell's points are within eps: cells of `least` points are
    core as wholes, and the core points of a cell are one node of the graph, so that dense places make few pairs."""
    keys = ("scene_id", same) if same else ("scene_id",)
    spots = spatial.cells(spatial.positions(points, keys), eps / 3**0.5 * (1 - 1e-6)).withColumnsRenamed({f"i{c}": f"f{c}" for c in "xyz"})
    spots, cell = cut(spots), [*keys, "fx", "fy", "fz"]
    full = cut(spots.groupBy(*cell).agg(F.sum("n").alias("_n")).where(F.col("_n") >= least).select(*cell))
    dense, sparse = spots.join(full, cell, "left_semi"), spots.join(full, cell, "left_anti")
    near = _near(sparse, spots.select(*keys, *"xyz", F.col("n").alias("_n")), eps, keys)
    counts = near.groupBy(*cell, *"xyz").agg(F.sum("_n").alias("_n"), F.first("n").alias("n"), F.first("point_id").alias("point_id"))
    busy = counts.where(F.col("_n") >= least)
    core = cut(dense.select(spots.columns).unionByName(busy.select(spots.columns)))
    nodes = core.groupBy(*cell).agg(F.min("point_id").alias("node"))
    named = core.join(nodes, cell).select(*keys, *"xyz", "node")
    pairs = spatial.position_pairs(named, eps, keys, closed=True).where("a.node != b.node")
    edges = pairs.select("scene_id", F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    found = graph.components(edges.unionByName(nodes.select("scene_id", F.col("node").alias("u"), F.col("node").alias("v"))))
    owned = cut(named.join(found, ["scene_id", "node"]).select(*keys, *"xyz", F.col("component").alias("label")))
    rim = sparse.join(owned, [*keys, *"xyz"], "left_anti")
    border = _near(rim, owned, eps, keys).groupBy(*keys, *"xyz").agg(F.min("label").alias("label"))
    return points.join(owned.unionByName(border), [*keys, *"xyz"], "left").select(*points.columns, "label")


def _near(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...]) -> DataFrame:
    """left's rows with the other columns of every right row at the radius or nearer; left is copied to the cells around."""
    spread = spatial.cells(left, radius)
    for c in "xyz":
        spread = spread.withColumn(f"i{c}", F.explode(F.sequence(F.col(f"i{c}") - 1, F.col(f"i{c}") + 1)))
    there = spatial.cells(right, radius).withColumnsRenamed({c: f"{c}2" for c in "xyz"})
    gap = spatial.length(*[F.col(c) - F.col(f"{c}2") for c in "xyz"])
    return spread.join(there, [*keys, "ix", "iy", "iz"]).where(gap <= radius).drop("ix", "iy", "iz", "x2", "y2", "z2")


def shifted_dbscan(points: DataFrame, offsets: tuple[str, str, str], eps: float, least: int) -> DataFrame:
    """DBSCAN of the points moved by their predicted offsets; coordinates stay as they were."""
    moved = points.withColumns({f"_{c}": F.col(c) for c in "xyz"} | {c: F.col(c) + F.col(o) for c, o in zip("xyz", offsets)})
    return dbscan(moved, eps, least).withColumns({c: F.col(f"_{c}") for c in "xyz"}).drop("_x", "_y", "_z")


def ball_components(points: DataFrame, radius: float, least: int, same: str) -> DataFrame:
    """Adds `label`: components of the graph of points nearer than the radius within one class; small ones get null, as do
    points without class and points with a null, NaN or infinite coordinate.

    As in `dbscan`, the points of a cell so small that all of it is nearer than the radius are one node, and only positions of
    different nodes make pairs."""
    keys, sound = ("scene_id", same), points.where(F.col(same).isNotNull())
    for c in "xyz":
        sound = sound.where(F.abs(c) < float("inf"))
    cell = [*keys, "fx", "fy", "fz"]
    spots = cut(spatial.cells(spatial.positions(sound, keys), radius / 3**0.5 * (1 - 1e-6)).withColumnsRenamed({f"i{c}": f"f{c}" for c in "xyz"}))
    named = cut(spots.join(spots.groupBy(*cell).agg(F.min("point_id").alias("node")), cell).select(*keys, *"xyz", "n", "node"))
    pairs = spatial.position_pairs(named.drop("n"), radius, keys).where("a.node != b.node")
    alone = named.select("scene_id", F.col("node").alias("u"), F.col("node").alias("v"))
    edges = pairs.select("scene_id", F.col("a.node").alias("u"), F.col("b.node").alias("v")).unionByName(alone).distinct()
    placed = cut(named.join(graph.components(edges), ["scene_id", "node"]))
    big = placed.groupBy("scene_id", "component").agg(F.sum("n").alias("_n")).where(F.col("_n") >= least).drop("_n")
    kept = placed.join(big, ["scene_id", "component"]).select(*keys, *"xyz", F.col("component").alias("label"))
    return points.join(kept, [*keys, *"xyz"], "left").select(*points.columns, "label")


def soft_groups(points: DataFrame, scores: dict[int, Column], threshold: float, radius: float, least: int) -> DataFrame:
    """scene_id, cls, proposal_id, point_id: a point enters every class whose score is over the threshold, and the classes
    are grouped apart."""
    classes = F.array_compact(F.array(*[F.when(s > threshold, F.lit(c)) for c, s in scores.items()]))
    each = points.withColumn("cls", F.explode(classes)).withColumn("_scene", F.col("scene_id")).withColumn("scene_id", F.struct("scene_id", "cls"))
    out = ball_components(each, radius, least, "cls").where("label IS NOT NULL")
    return out.select(F.col("scene_id.scene_id").alias("scene_id"), "cls", F.col("label").alias("proposal_id"), "point_id")


def dual_groups(points: DataFrame, offsets: tuple[str, str, str], radius: float, least: int, same: str) -> DataFrame:
    """Proposals from the coordinates as they are and from shifted ones; score: size over the scene's largest, at most 1."""
    moved = points.withColumns({c: F.col(c) + F.col(o) for c, o in zip("xyz", offsets)})
    sets = [ball_components(p, radius, least, same).where("label IS NOT NULL").select("scene_id", F.lit(k).alias("source"), F.col("label").alias("proposal_id"), "point_id") for k, p in enumerate((points, moved))]
    both = sets[0].unionByName(sets[1])
    sizes = both.groupBy("scene_id", "source", "proposal_id").agg(F.count("*").alias("n"))
    most = sizes.groupBy("scene_id").agg(F.max("n").alias("_most"))
    return sizes.join(most, "scene_id").withColumn("score", F.least(F.lit(1.0), F.col("n") / F.col("_most"))).drop("_most")


def density_peaks(points: DataFrame, k: int, centres: int, separation: float, cell: float) -> DataFrame:
    """Adds `label`, the nearest density peak: peaks have the largest product of density (inverse mean distance to k
    neighbours) and distance to a denser neighbour; each is apart from better ones."""
    near = blocks.neighbour_lists(points, points, k).withColumn("rho", 1.0 / (blocks.mean_distance() + 1e-6))
    rho = near.select("scene_id", F.col("left_id").alias("right_id"), F.col("rho").alias("rho2"))
    pairs = near.select("scene_id", "left_id", "rho", F.inline("found")).join(rho, ["scene_id", "right_id"])
    delta = cut(pairs.groupBy("scene_id", F.col("left_id").alias("point_id")).agg(F.min(F.when(F.col("rho2") > F.col("rho"), F.col("distance"))).alias("delta"), F.first("rho").alias("rho")))
    most = delta.groupBy("scene_id").agg(F.max("delta").alias("_most"))
    gamma = delta.join(most, "scene_id").select("scene_id", "point_id", (F.col("rho") * F.coalesce("delta", "_most")).alias("score"))
    best = first_separated(points, gamma, centres, separation)
    there = points.join(best, ["scene_id", "point_id"], "left_semi").select("scene_id", F.col("point_id").alias("label"), *[F.col(c).alias(f"_{c}") for c in "xyz"])
    return to_nearest(points, there)


def to_nearest(points: DataFrame, centres: DataFrame, cap: float | None = None) -> DataFrame:
    """Adds the label of the nearest centre (scene_id, label, _x, _y, _z; a few rows for each scene)."""
    there = centres.groupBy("scene_id").agg(F.collect_list(F.struct("label", "_x", "_y", "_z")).alias("_there"))
    gaps = F.transform("_there", lambda t: F.struct(spatial.length(*[F.col(c) - t[f"_{c}"] for c in "xyz"]).alias("gap"), t["label"].alias("label")))
    if cap is not None:
        gaps = F.filter(gaps, lambda g: g.gap <= cap)
    return points.join(there, "scene_id", "left").withColumn("label", F.array_min(gaps)["label"]).drop("_there")


def separated(points: DataFrame, scores: DataFrame, separation: float) -> DataFrame:
    """scene_id, point_id, score of the points that are `separation` or more from every better chosen one (the smaller id on
    ties). Rounds: points that no better live point is near stay, those near one that stays go."""
    top = cut(scores.join(points.select("scene_id", "point_id", *"xyz"), ["scene_id", "point_id"]))
    pairs = spatial.radius_join(top, top.withColumn("score2", F.col("score")), separation, extra=("score2",), extra_left=("score",))
    better = (F.col("score2") > F.col("score")) | ((F.col("score2") == F.col("score")) & (F.col("right_id") < F.col("left_id")))
    beaten = cut(pairs.where((F.col("left_id") != F.col("right_id")) & better).select("scene_id", F.col("left_id").alias("point_id"), F.col("right_id").alias("by")))
    live, kept = top.select("scene_id", "point_id", "score"), None
    while not live.isEmpty():
        waiting = beaten.join(live.select("scene_id", F.col("point_id").alias("by")), ["scene_id", "by"], "left_semi").select("scene_id", "point_id")
        stay = cut(live.join(waiting, ["scene_id", "point_id"], "left_anti"))
        kept = stay if kept is None else kept.unionByName(stay)
        gone = beaten.join(stay.select("scene_id", F.col("point_id").alias("by")), ["scene_id", "by"], "left_semi").select("scene_id", "point_id")
        live = cut(live.join(stay, ["scene_id", "point_id"], "left_anti").join(gone, ["scene_id", "point_id"], "left_anti"))
    return kept if kept is not None else live


def first_separated(points: DataFrame, scores: DataFrame, count: int, separation: float) -> DataFrame:
    """scene_id, point_id, score of the first `count` points, from the best score down (the smaller id on ties), that are
    `separation` or more from all chosen before.

    A round for each: an aggregation takes the best point of every scene that is apart from those chosen."""
    placed, kept = cut(scores.join(points.select("scene_id", "point_id", *"xyz"), ["scene_id", "point_id"])), None
    live = placed
    for _ in range(count):
        key = F.struct((-F.col("score")).alias("s"), "point_id", *"xyz")
        best = cut(live.groupBy("scene_id").agg(F.min(key).alias("b")).select("scene_id", "b"))
        if best.isEmpty():
            break
        kept = best if kept is None else kept.unionByName(best)
        gone = kept.groupBy("scene_id").agg(F.collect_list("b").alias("_gone"))
        apart = F.forall("_gone", lambda g: (F.col("point_id") != g.point_id) & (spatial.length(*[F.col(c) - g[c] for c in "xyz"]) >= separation))
        live = placed.join(gone, "scene_id").where(apart).drop("_gone")
    chosen = kept if kept is not None else best
    return chosen.select("scene_id", "b.point_id", (-F.col("b.s")).alias("score"))


def mean_shift(points: DataFrame, bandwidth: float, cell: float, least: int = 1, most_rounds: int = 20, tolerance: float = 1e-3) -> DataFrame:
    """Adds `label`: grid centroids of cells with `least` points move to the mean of the points within the bandwidth until
    none moves; modes nearer than the bandwidth to a busier one fall together; points take the nearest mode."""
    grid = spatial.cells(points, cell).groupBy("scene_id", "ix", "iy", "iz").agg(F.count("*").alias("n"), F.min("point_id").alias("point_id"), *[F.avg(c).alias(c) for c in "xyz"]).where(F.col("n") >= least)
    seeds = cut(grid.select("scene_id", "point_id", *"xyz"))
    for _ in range(most_rounds):
        near = spatial.radius_join(seeds, points.withColumns({f"p{c}": F.col(c) for c in "xyz"}), bandwidth, extra=("px", "py", "pz"), extra_left=("x", "y", "z"))
        old = [F.first(c).alias(f"_{c}") for c in "xyz"]
        moved = cut(near.groupBy("scene_id", F.col("left_id").alias("point_id")).agg(*[F.avg(f"p{c}").alias(c) for c in "xyz"], F.count("*").alias("n"), *old))
        far = moved.agg(F.max(spatial.length(*[F.col(c) - F.col(f"_{c}") for c in "xyz"]))).first()[0]
        seeds = moved
        if far is None or far < tolerance:
            break
    modes = separated(seeds, seeds.select("scene_id", "point_id", F.col("n").cast("double").alias("score")), bandwidth)
    near = spatial.nearest_join(points, seeds.join(modes, ["scene_id", "point_id"], "left_semi"), bandwidth)
    return points.join(near.select("scene_id", F.col("left_id").alias("point_id"), F.col("right_id").alias("label")), ["scene_id", "point_id"], "left")


def k_means(points: DataFrame, k: int, rounds: int = 15, flat: bool = True) -> DataFrame:
    """Adds `label` (1 to k): Lloyd's steps of all scenes at once, from points at even places of the order of ids."""
    start = sampling.strided(points.select("scene_id", "point_id", *"xyz"), k)
    axes = "xy" if flat else "xyz"
    centres = cut(start.select("scene_id", F.col("point_id").alias("label"), *[F.col(c).alias(f"_{c}") for c in "xyz"]))
    zero = (lambda df, cols: df.withColumns({c: F.lit(0.0) for c in cols})) if flat else (lambda df, cols: df)
    base = zero(points.select("scene_id", "point_id", *"xyz"), ["z"])
    for _ in range(rounds):
        near = to_nearest(base, zero(centres, ["_z"]))
        moved = cut(near.groupBy("scene_id", "label").agg(*[F.avg(c).alias(f"_{c}") for c in axes], *([F.lit(0.0).alias("_z")] if flat else [])))
        gap = centres.alias("a").join(moved.alias("b"), ["scene_id", "label"]).agg(F.max(F.greatest(*[F.abs(F.col(f"a._{c}") - F.col(f"b._{c}")) for c in axes]))).first()[0]
        centres = moved
        if gap is None or gap < 1e-6:
            break
    found = to_nearest(base, centres).select("scene_id", "point_id", "label")
    return points.join(found, ["scene_id", "point_id"], "left")


def linked(points: DataFrame, k: int, cell: float, threshold: float) -> DataFrame:
    """Adds `label`: single linkage over the k-nearest graph, cut at the threshold."""
    near = blocks.neighbour_lists(points, points, k).select("scene_id", "left_id", F.inline("found")).where(F.col("distance") <= threshold)
    found = graph.components(near.select("scene_id", F.col("left_id").alias("u"), F.col("right_id").alias("v")))
    return points.join(found.select("scene_id", F.col("node").alias("point_id"), F.col("component").alias("label")), ["scene_id", "point_id"], "left")


def summarised(points: DataFrame, threshold: float, reach: float) -> DataFrame:
    """Adds `label`: points are summarised as counts and sums of cells (the additive features of a summary tree's leaves),
    and summaries with centroids within reach are linked."""
    placed = spatial.cells(points, threshold)
    keys = ["scene_id", "ix", "iy", "iz"]
    leaves = cut(placed.groupBy(*keys).agg(F.min("point_id").alias("point_id"), *[F.avg(c).alias(c) for c in "xyz"]))
    pairs = spatial.radius_join(leaves, leaves, reach)
    found = graph.components(pairs.select("scene_id", F.col("left_id").alias("u"), F.col("right_id").alias("v")))
    named = leaves.join(found.withColumnRenamed("node", "point_id"), ["scene_id", "point_id"]).select(*keys, F.col("component").alias("label"))
    return placed.join(named, keys).drop("ix", "iy", "iz")


#: Cells of a feature tree are an eighth of the radius bound at first and double their size with each level, up to four bounds.
TREE_LEVELS = 6


def feature_leaves(points: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Points with `label`, the leaf that holds them (named by its smallest point), and the leaves: scene_id, label, n, the
    sums sx, sy, sz, the sum of squares ss and the radius (root mean square distance from the mean), which is no more than
    the bound.

    A leaf is a triple of count, sums and sum of squares, which add up when leaves merge. Points are summarised by small
    cells; level by level, the summaries of a cell of twice the size merge if their radius stays within the bound, else they
    are leaves for good. Every level is one aggregation over summaries, whose number falls with each."""
    keys, sums = ["scene_id", "ix", "iy", "iz"], ["n", "sx", "sy", "sz", "ss"]
    placed = spatial.cells(points, radius / 8)
    squares = F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("ss")
    bases = placed.groupBy(*keys).agg(F.min("point_id").alias("label"), F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in "xyz"], squares)
    bases = cut(bases)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - (F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz")) / (F.col("n") * F.col("n"))))
    live, done = bases, None
    for level in range(TREE_LEVELS + 1):
        if level == TREE_LEVELS:
            closed, live = live, None
        else:
            upper = ["scene_id", *[f"u{c}" for c in "xyz"]]
            up = live.withColumns({f"u{c}": F.floor(F.col(f"i{c}") / 2) for c in "xyz"})
            parents = up.groupBy(*upper).agg(F.min("label").alias("label"), *[F.sum(c).alias(c) for c in sums])
            good = cut(parents.where(spread <= radius))
            closed = up.join(good.select(*upper), upper, "left_anti").select(*keys, "label", *sums)
            live = good.select("scene_id", *[F.col(f"u{c}").alias(f"i{c}") for c in "xyz"], "label", *sums)
        closed = closed.withColumn("level", F.lit(level))
        done = closed if done is None else done.unionByName(closed)
    done = cut(done)
    paths = [F.struct(F.lit(k).alias("level"), *[F.floor(F.col(f"i{c}") / (1 << k)).alias(f"a{c}") for c in "xyz"]) for k in range(TREE_LEVELS + 1)]
    above = bases.select(*keys, F.inline(F.array(*paths)))
    named = above.join(done.select("scene_id", "level", *[F.col(f"i{c}").alias(f"a{c}") for c in "xyz"], "label"), ["scene_id", "level", "ax", "ay", "az"])
    home = named.groupBy(*keys).agg(F.min(F.struct("level", "label"))["label"].alias("label"))  # the lowest leaf above a cell is its own
    leaves = done.select("scene_id", "label", *sums, spread.alias("radius"))
    return placed.join(home, keys).select(*points.columns, "label"), leaves


def with_adaptive_seed(points: DataFrame, distances: tuple[float, ...], cell: float, share: float = 0.1, least: int = 50) -> tuple[float, DataFrame]:
    """The first seed distance that leaves at most `share` of the points in clusters under `least` points, else the one that
    leaves the fewest, and its labels."""
    from .filters import sized

    best = None
    for distance in distances:
        out = cut(sized(watershed(points, cell, distance), "label", least, 1 << 60))
        left = out.agg(F.avg(F.when(F.col("label").isNull(), 1.0).otherwise(0.0))).first()[0] or 0.0
        if best is None or left < best[0]:
            best = (left, distance, out)
        if left <= share:
            break
    return best[1], best[2]
