"""Connected components by alternating large-star and small-star steps, as DataFrame joins and aggregations.

Edges are rows (g, u, v): nodes u and v are linked in graph g, and all graphs take their steps together. Each step
writes its edges to the shared folder, which cuts lineage. A large-star step links every larger neighbour of a node to
the least of the node and its neighbours; a small-star step links the node and its smaller neighbours to that least
one. The steps end when they change nothing: every node then points at the smallest node that it reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Tables


#: Shares into which the edges of a hub are dealt, so that it does not meet its least neighbour in one task. A hub is a
#: node with more than HUB edges and more than one in HUBS of all: there are no more than a few times HUBS of them.
SALTS, HUB, HUBS = 64, 5000, 1000


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges with m, the least neighbour of u; least: g, u, m and n (edges of u). Hubs, which are few, stand on the other
    side once for each share."""
    if total <= HUB:
        return edges.join(least, ["g", "u"])
    many = F.col("n") > max(HUB, total // HUBS)
    hubs = F.broadcast(least.where(many).select("g", "u", F.lit(True).alias("_hub")))
    salted = edges.join(hubs, ["g", "u"], "left").withColumn("_salt", F.when(F.col("_hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(-1))
    spread = least.withColumn("_salt", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))))
    return salted.join(spread, ["g", "u", "_salt"])


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("g", "u", "v").unionByName(edges.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("g", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.where(F.col("v") > F.col("u")), least, total).select("g", F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Edges here point from larger to smaller."""
    least = edges.groupBy("g", "u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, total).where(F.col("v") > F.col("m")).select("g", F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("g", "u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """g, node and component (the least node that it reaches) of every node that has an edge to another node.

    Self-edges and nulls are left out; repeated edges count once; without edges the result is empty.
    """
    pairs = edges.select("g", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u IS NOT NULL AND u != v").distinct()
    before, k, old = None, 0, None
    while True:
        seen = Observation()
        counted = pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("g", "u", "v"), F.lit(1 << 30))).alias("s"))
        now = tables.write(counted, f"{name}-{k}")
        after = seen.get
        if old is not None:
            tables.drop(old)
        if after == before or not after["n"]:
            break
        before, old, k = after, f"{name}-{k}", k + 1
        pairs = _small_star(_large_star(now, after["n"]), after["n"])
    roots = now.select("g", F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select("g", F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
