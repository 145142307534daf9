"""Graphs of points, clusters and proposals: components, overlaps, suppression and selection."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pointloom.lineage import cut

#: Edges that a task joins at once.
BATCH = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.r_[u, v], return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value."""
    column = column.combine_chunks()
    if not pa.types.is_struct(column.type):
        return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    parts = np.stack([_codes(pa.chunked_array([c])) for c in column.flatten()], 1)
    return np.unique(parts, axis=0, return_inverse=True)[1].reshape(-1)


def _joined(edges: pa.Table, group: str) -> pa.Table:
    """group, node and root of the edges of one batch, group by group."""
    code, u, v = _codes(edges[group]), edges["u"].to_numpy(), edges["v"].to_numpy()
    by = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(code[by]) != 0])
    nodes, roots, at = [], [], []
    for f, e in zip(starts, [*starts[1:], len(by)]):
        n, r = forest(u[by[f:e]], v[by[f:e]])
        nodes.append(n), roots.append(r), at.append(np.full(len(n), by[f]))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({group: edges[group].take(cat(at)), "node": cat(nodes), "root": cat(roots)})


def _contracted(edges: DataFrame, group: str) -> DataFrame:
    """group, node, root: a star for each part of the edges (u and v are numbers) that hangs together within a batch of a task."""
    shape = edges.select(group, F.col("u").cast("long").alias("node"), F.col("v").cast("long").alias("root"))
    schema = to_arrow_schema(shape.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if held and (batch is None or size >= BATCH):
                yield from _joined(pa.Table.from_batches(held), group).cast(schema).to_batches()
                held, size = [], 0
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.num_rows

    return edges.select(group, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInArrow(run, shape.schema)


def components(edges: DataFrame, group: str = "scene_id", hold: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """group, node and component (the smallest node that it reaches) of all nodes of edges (group, u, v).

    Numbered nodes are first joined within batches of edges; a node of several batches links their roots, and what is left
    is a graph of roots. A node whose only edge is to itself is its own component.
    """
    kind = edges.schema["u"].dataType.simpleString()
    if kind not in ("bigint", "int") or edges.schema["v"].dataType.simpleString() not in ("bigint", "int"):
        return _components(edges, group, hold)
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL")
    homes = hold(_contracted(edges, group).groupBy(group, "node").agg(F.array_sort(F.collect_set("root")).alias("roots")))
    links = homes.where(F.size("roots") > 1).select(group, F.explode("roots").alias("u"), F.get("roots", F.lit(0)).alias("v"))
    found = _components(hold(links.where("u != v")), group, hold).where("node != component").select(group, F.col("node").alias("_root"), "component")
    own = homes.select(group, "node", F.get("roots", F.lit(0)).alias("_root")).join(found, [group, "_root"], "left")
    return own.select(group, F.col("node").cast(kind).alias("node"), F.coalesce("component", "_root").cast(kind).alias("component"))


def _components(edges: DataFrame, group: str, hold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """components() by alternating large-star and small-star steps: aggregations and joins on the node, a few rounds whatever
    the diameter."""
    alone = edges.where(F.col("u") == F.col("v")).select(group, F.col("u").alias("node")).distinct()
    now = hold(edges.where(F.col("u") != F.col("v")).select(group, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = [F.count("*"), F.sum(F.pmod(F.xxhash64(group, "u", "v"), F.lit(1 << 30)))]
    before = None
    while (after := now.agg(*state).first()) != before:
        before = after
        both = now.unionByName(now.select(group, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(group, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, [group, "u"]).select(group, F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy(group, "u").agg(F.min("v").alias("m"))
        moved = large.join(lower, [group, "u"]).where(F.col("v") > F.col("m")).select(group, F.col("v").alias("u"), F.col("m").alias("v"))
        now = hold(moved.unionByName(lower.select(group, "u", F.col("m").alias("v"))).distinct())
    roots = now.select(group, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = now.select(group, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    rest = alone.join(found.select(group, "node"), [group, "node"], "left_anti")
    return found.unionByName(rest.select(group, "node", F.col("node").alias("component")))


def overlaps(proposals: DataFrame) -> DataFrame:
    """scene_id, a, b (a < b), shared points, sizes, IoU and overlap of the smaller, of proposals with common points."""
    sizes = proposals.groupBy("scene_id", "proposal_id").agg(F.count("*").alias("n"))
    a = proposals.select("scene_id", "point_id", F.col("proposal_id").alias("a"))
    b = proposals.select("scene_id", "point_id", F.col("proposal_id").alias("b"))
    both = a.join(b, ["scene_id", "point_id"]).where("a < b").groupBy("scene_id", "a", "b").agg(F.count("*").alias("shared"))
    for side in "ab":
        both = both.join(sizes.select("scene_id", F.col("proposal_id").alias(side), F.col("n").alias(f"n_{side}")), ["scene_id", side])
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return both.withColumns({"iou": F.col("shared") / union, "of_smaller": F.col("shared") / F.least("n_a", "n_b")})


def merged(proposals: DataFrame, scores: DataFrame, iou: float, of_smaller: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Proposals joined over blocks: components of the overlap graph, their points once each, and the best score."""
    pairs = overlaps(proposals).where((F.col("iou") >= iou) | (F.col("of_smaller") >= of_smaller))
    alone = scores.select("scene_id", F.col("proposal_id").alias("u"), F.col("proposal_id").alias("v"))
    found = components(pairs.select("scene_id", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(alone))
    found = found.select("scene_id", F.col("node").alias("proposal_id"), "component")
    points = proposals.join(found, ["scene_id", "proposal_id"]).select("scene_id", F.col("component").alias("proposal_id"), "point_id").distinct()
    best = scores.join(found, ["scene_id", "proposal_id"]).groupBy("scene_id", F.col("component").alias("proposal_id")).agg(F.max("score").alias("score"))
    return points, best


def suppressed(proposals: DataFrame, scores: DataFrame, iou: float) -> DataFrame:
    """Greedy non-maximum suppression: scene_id, proposal_id and score of what stays.

    Rounds instead of a sequence: proposals that no better live proposal overlaps stay, those that overlap one that
    stays go; this is the greedy result, as every decision needs only better proposals. Ties go to the smaller id.
    """
    pairs = overlaps(proposals).where(F.col("iou") > iou)
    s = {x: scores.select("scene_id", F.col("proposal_id").alias(x), F.col("score").alias(f"s_{x}")) for x in "ab"}
    pairs = pairs.join(s["a"], ["scene_id", "a"]).join(s["b"], ["scene_id", "b"])
    first = F.col("s_a") >= F.col("s_b")
    pairs = cut(pairs.select("scene_id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse")))
    live, kept = cut(scores.select("scene_id", "proposal_id", "score")), None
    while not live.isEmpty():
        known = pairs.join(live.select("scene_id", F.col("proposal_id").alias("better")), ["scene_id", "better"], "left_semi")
        stay = cut(live.join(known.select("scene_id", F.col("worse").alias("proposal_id")), ["scene_id", "proposal_id"], "left_anti"))
        kept = stay if kept is None else kept.unionByName(stay)
        gone = pairs.join(stay.select("scene_id", F.col("proposal_id").alias("better")), ["scene_id", "better"], "left_semi").select("scene_id", F.col("worse").alias("proposal_id"))
        live = cut(live.join(stay, ["scene_id", "proposal_id"], "left_anti").join(gone, ["scene_id", "proposal_id"], "left_anti"))
    return scores.limit(0).select("scene_id", "proposal_id", "score") if kept is None else kept


def greedy_cover(proposals: DataFrame, scores: DataFrame, share: float = 0.5) -> DataFrame:
    """scene_id, point_id, proposal_id: from the best score down, a proposal is taken if more than `share` of its points
    are free, and takes those.

    Rounds: a proposal is decided once all better ones that share points with it are; points of taken proposals leave
    the table before the next round. There are as many rounds as the longest chain of overlapping proposals.
    """
    scored = proposals.join(scores, ["scene_id", "proposal_id"])
    sizes = scored.groupBy("scene_id", "proposal_id").agg(F.count("*").alias("n"), F.first("score").alias("score"))
    pairs = overlaps(scored.select("scene_id", "proposal_id", "point_id")).select("scene_id", "a", "b")
    s = {x: sizes.select("scene_id", F.col("proposal_id").alias(x), F.col("score").alias(f"s_{x}")) for x in "ab"}
    first = F.col("s_a") >= F.col("s_b")
    better, worse = F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("proposal_id")
    waits = cut(pairs.join(s["a"], ["scene_id", "a"]).join(s["b"], ["scene_id", "b"]).select("scene_id", better, worse))
    live, free, out = cut(sizes.select("scene_id", "proposal_id", "n")), scored.select("scene_id", "point_id", "proposal_id"), None
    while not live.isEmpty():
        held = waits.join(live.select("scene_id", F.col("proposal_id").alias("better")), ["scene_id", "better"], "left_semi").select("scene_id", "proposal_id")
        ready = live.join(held, ["scene_id", "proposal_id"], "left_anti")
        enough = free.join(ready, ["scene_id", "proposal_id"]).groupBy("scene_id", "proposal_id", "n").agg(F.count("*").alias("left")).where(F.col("left") > share * F.col("n"))
        taken = cut(free.join(enough, ["scene_id", "proposal_id"], "left_semi").select("scene_id", "point_id", "proposal_id"))
        out = taken if out is None else out.unionByName(taken)
        live = cut(live.join(ready.select("scene_id", "proposal_id"), ["scene_id", "proposal_id"], "left_anti"))
        free = cut(free.join(taken, ["scene_id", "point_id"], "left_anti").join(live, ["scene_id", "proposal_id"], "left_semi"))
    return out if out is not None else scored.limit(0).select("scene_id", "point_id", "proposal_id")


def assigned_by_score(proposals: DataFrame, scores: DataFrame) -> DataFrame:
    """Every point's proposal of the highest score, the smaller id on ties."""
    ranked = proposals.join(scores, ["scene_id", "proposal_id"]).groupBy("scene_id", "point_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "proposal_id")).alias("b"))
    return ranked.select("scene_id", "point_id", F.col("b.proposal_id").alias("proposal_id"))
