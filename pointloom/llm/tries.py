"""Prefix trie of rebuilt conversations, with rollups over subtrees.

A conversation is the sequence of its turns (role, text), ordered by turn (null first; turns of one number by the MD5 of
role and text); null roles and texts are empty; rows without conv_id are left out; repeated rows are turns of their own.
Conversation c is rebuilt from the first h = crc32(c) % HEADS turns of conversation c - c % HUNDRED and its own turns
after the first h. A node of the trie is a distinct sequence of first turns, named by a 128-bit fingerprint: the running
XOR of two hashes of place and turn. An empty table has no nodes, not even the root.

Nodes with more than SHARD turns below them are heavy; every other node belongs to the shard of its topmost light
ancestor, so that a shard has SHARD nodes at most however common its first turns are. Shards are built in tasks as succinct
level-order tries (LOUDS): a bit vector tells degrees, arrays in the same order hold labels, and sums roll up from the
last level to the first. The heavy levels, as many times fewer as SHARD tells, merge afterwards in the same way, one
trie for each first turn, on top of the totals of the shards below them; the root is an aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables

#: Turns below a node from which on it is heavy, and nodes that one step of a task builds.
SHARD, STEP = 200_000, 20_000
#: Rebuilding takes fewer than HEADS turns of the conversation that begins the hundred.
HEADS, HUNDRED = 6, 100
#: Ends of a node are joined in pieces of so many consecutive ids, so that no task holds all of a node's.
PIECE = 512

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_NODE = "fa long, fb long, pa long, pb long, depth long, conv_id long, n_convs long"


def louds(parents: np.ndarray, levels: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level order, bit vector and level bounds of a forest: parents hold indexes, or -1 for the children of a root that is
    added; siblings follow `tie`. The bits are 10 for the root's own parent, then for every node in level order, the root
    first, a 1 for each child and a 0."""
    n = len(parents)
    by_level = np.argsort(levels, kind="stable")
    bounds = np.searchsorted(levels[by_level], np.arange(int(levels.max(initial=-1)) + 2))
    place, order = np.full(n, -1, np.int64), np.empty(n, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        at = by_level[a:b]
        up = np.where(parents[at] < 0, -1, place[parents[at]])
        at = at[np.lexsort((tie[at], up))]
        place[at], order[a:b] = np.arange(a, b), at
    up = np.where(parents[order] < 0, 0, place[parents[order]] + 1)
    degrees = np.bincount(up, minlength=n + 1)
    bits = np.ones(2 + n + n + 1, bool)
    bits[1] = False
    bits[1 + np.cumsum(degrees + 1)] = False
    return order, bits, bounds


def parents_of(bits: np.ndarray) -> np.ndarray:
    """The parent of each node in level order (the added root, the first, has -1): zeros before the node's 1, less one."""
    ones = np.flatnonzero(bits)
    return ones - np.arange(len(ones)) - 1


def degrees_of(bits: np.ndarray) -> np.ndarray:
    return np.diff(np.flatnonzero(~bits)) - 1


def rolled(nodes: pd.DataFrame) -> pd.DataFrame:
    """nodes of whole subtrees with n_children, n_leaves, saved_tokens and parent_conv_id (null where the parent is not
    among them); kids, leaves and saved are what lies below a node outside of this table."""
    n = len(nodes)
    both = np.stack([np.r_[nodes.fa, nodes.pa], np.r_[nodes.fb, nodes.pb]], 1)
    known, names = np.unique(both, axis=0, return_inverse=True)
    names = names.reshape(-1)
    at = np.full(len(known), -1, np.int64)
    at[names[:n]] = np.arange(n)
    parents, depth = at[names[n:]], nodes.depth.to_numpy(np.int64)
    tops = np.unique(np.stack([nodes.ka, nodes.kb], 1), axis=0, return_inverse=True)[1].reshape(-1)
    least = np.full(tops.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, tops, depth)
    order, bits, bounds = louds(parents, depth - least[tops], names[:n])
    up, children = parents_of(bits)[1:], degrees_of(bits)[1:]
    out = nodes.iloc[order].reset_index(drop=True)
    children = children + out.kids.to_numpy(np.int64)
    leaves = np.r_[0, np.where(children == 0, 1, out.leaves.to_numpy(np.int64))]
    saved = np.r_[0, (out.n_convs.to_numpy(np.int64) - 1) * out.chars.to_numpy(np.int64) + out.saved.to_numpy(np.int64)]
    for a, b in zip(bounds[-2::-1], bounds[:0:-1]):
        np.add.at(leaves, up[a:b], leaves[a + 1 : b + 1])
        np.add.at(saved, up[a:b], saved[a + 1 : b + 1])
    names_up = np.r_[0, out.conv_id.to_numpy(np.int64)][up]
    out["parent_conv_id"] = pd.array(np.where(up > 0, names_up, 0), dtype="Int64")
    out.loc[up == 0, "parent_conv_id"] = pd.NA
    out["n_children"], out["n_leaves"], out["saved_tokens"] = children, leaves[1:], saved[1:]
    return out


def _in_steps(frames: Iterator[pd.DataFrame], step: int) -> Iterator[pd.DataFrame]:
    """Frames of about `step` rows that hold whole groups of (ka, kb); the input is sorted by them."""
    held: list[pd.DataFrame] = []
    for frame in filter(len, frames):
        last = frame.iloc[-1]
        whole = len(frame) - int(((frame.ka == last.ka) & (frame.kb == last.kb)).sum())
        goes_on = bool(held) and (held[-1].ka.iloc[-1], held[-1].kb.iloc[-1]) == (last.ka, last.kb)
        if held and not goes_on and sum(map(len, held)) + whole >= step:
            yield pd.concat([*held, frame.iloc[:whole]])
            held, frame = [], frame.iloc[whole:]
        held.append(frame)
    if held:
        yield pd.concat(held)


def _roll(nodes: DataFrame) -> DataFrame:
    """rolled() over shards (ka, kb): a task takes whole shards, a step of them at once."""
    columns = ["fa", "fb", "pa", "pb", "depth", "conv_id", "n_convs", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _in_steps(frames, STEP):
            yield rolled(frame)[columns]

    ready = nodes.repartition("ka", "kb").sortWithinPartitions("ka", "kb")
    return ready.mapInPandas(run, f"{_NODE}, parent_conv_id long, n_children long, n_leaves long, saved_tokens long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, place, label and chars of the rebuilt conversations' turns (place orders them and may skip numbers), and
    conv_id of all conversations."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    label = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    known = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", label.alias("label"), F.length(text).cast("long").alias("chars"))
    own = known.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "label"))).drop("turn")
    takes = F.crc32(F.col("conv_id").cast("string")) % HEADS
    ids = own.where("place = 1").select("conv_id")
    first = own.where((F.col("conv_id") % HUNDRED == 0) & (F.col("place") < HEADS)).withColumnRenamed("conv_id", "_base")
    wants = ids.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % HUNDRED, "_h": takes})
    heads = wants.join(first, "_base").where(F.col("place") <= F.col("_h")).select("conv_id", "place", "label", "chars")
    tails = own.where(F.col("place") > takes).select("conv_id", (F.col("place") + HEADS).alias("place"), "label", "chars")
    return heads.unionByName(tails), ids


def _paths(turns: DataFrame) -> DataFrame:
    """A row for each conversation and prefix: depth, length, the prefix's fingerprint, its parent's and the first turn's."""
    by = W.partitionBy("conv_id").orderBy("place")
    so_far, whole = by.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("conv_id")
    numbered = turns.withColumn("depth", F.row_number().over(by).cast("long"))
    hashed = numbered.withColumns({"_a": F.xxhash64("depth", "label"), "_b": F.xxhash64(F.lit(7), "depth", "label")})
    run = hashed.withColumns({"fa": F.bit_xor("_a").over(so_far), "fb": F.bit_xor("_b").over(so_far), "length": F.count("*").over(whole)})
    run = run.withColumns({"pa": F.col("fa").bitwiseXOR(F.col("_a")), "pb": F.col("fb").bitwiseXOR(F.col("_b")), "ga": F.first("fa").over(so_far), "gb": F.first("fb").over(so_far)})
    return run.select("conv_id", "depth", "length", "fa", "fb", "pa", "pb", "ga", "gb", "chars")


def _ends(ends: DataFrame) -> DataFrame:
    """fa, fb and ends_sha256 of the conversations (fa, fb, conv_id) that end at a node: ids are joined in pieces by an
    aggregation, and a node's pieces, in order, go through one hash."""
    pieces = ends.groupBy("fa", "fb", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            done = []
            for fa, fb, ids in zip(frame.fa, frame.fb, frame.ids):
                if (fa, fb) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (fa, fb), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["fa", "fb", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["fa", "fb", "ends_sha256"])

    ready = pieces.repartition("fa", "fb").sortWithinPartitions("fa", "fb", "piece")
    return ready.mapInPandas(run, "fa long, fb long, ends_sha256 string")


def prefix_trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every
    node of the trie over turns (conv_id, turn, role, text)."""
    tables = Tables(turns.sparkSession, "trie")
    sequence, ids = rebuilt(turns)
    ids = tables.write(ids, "ids")
    paths = tables.write(_paths(sequence), "paths")
    below = paths.groupBy("fa", "fb").agg(F.sum(F.col("length") - F.col("depth")).alias("below"))
    heavy = tables.write(below.where(F.col("below") > shard).select("fa", "fb", F.lit(True).alias("heavy")), "heavy")

    placed = paths.join(heavy, ["fa", "fb"], "left")
    top = F.min(F.when(F.col("heavy").isNull(), F.struct("depth", "fa", "fb"))).over(W.partitionBy("conv_id"))
    light = placed.withColumn("_top", top).where("heavy IS NULL").withColumns({"ka": F.col("_top.fa"), "kb": F.col("_top.fb")})
    upper = placed.where("heavy").withColumns({"ka": F.col("ga"), "kb": F.col("gb")})

    def nodes(rows: DataFrame) -> DataFrame:
        one = [F.min(c).alias(c) for c in ("pa", "pb", "depth", "chars")]
        return rows.groupBy("ka", "kb", "fa", "fb").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *one)

    none = {c: F.lit(0).cast("long") for c in ("kids", "leaves", "saved")}
    low = tables.write(_roll(nodes(light).withColumns(none)), "light")
    # a shard's top is the only one of its nodes without a parent there
    totals = low.where("parent_conv_id IS NULL").groupBy(F.col("pa").alias("fa"), F.col("pb").alias("fb")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    high = nodes(upper).join(totals, ["fa", "fb"], "left").fillna(0, ["kids", "leaves", "saved"])
    high = tables.write(_roll(high), "upper")

    both = low.unionByName(high)
    first = both.where("depth = 1").agg(F.count("*").alias("n_children"), F.greatest(F.lit(1), F.coalesce(F.sum("n_leaves"), F.lit(0))).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    members = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = lambda *names: [F.lit(0).cast("long").alias(c) for c in names]
    root = tables.write(members.join(F.broadcast(first)).select(*zero("fa", "fb"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), *zero("depth"), "conv_id", "n_convs", F.lit(None).cast("long").alias("parent_conv_id"), "n_children", "n_leaves", "saved_tokens"), "root")
    owners = high.unionByName(root).select(F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("conv_id").alias("_owner"))

    turnless = ids.join(paths.select("conv_id").where("depth = 1"), "conv_id", "left_anti").select(*zero("fa", "fb"), "conv_id")
    ends = _ends(paths.where("depth = length").select("fa", "fb", "conv_id").unionByName(turnless))
    named = both.unionByName(root).join(owners, ["pa", "pb"], "left").join(ends, ["fa", "fb"], "left")
    return named.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_owner").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def oracle_sql() -> str:
    """DuckDB SQL of the same rows over the table conversations."""
    step = "xor(s, greatest(x - 256, 0)::BIGINT)"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length(c::VARCHAR)), lambda i: (CASE WHEN i % 8 = 0 THEN 256 + ascii(substr(c::VARCHAR, (i // 8 + 1)::INT, 1)) ELSE 0 END)::BIGINT)), lambda s, x: xor({step} >> 1, 3988292384 * ({step} & 1))))"
    return f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
  {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(turn ORDER BY i) AS turns FROM t GROUP BY c),
h AS (SELECT c, turns, {crc} % {HEADS} AS h FROM o),
r AS (SELECT h.c, list_concat(list_slice(coalesce(b.turns, []), 1, h), list_slice(h.turns, h + 1, len(h.turns))) AS s FROM h LEFT JOIN o b ON b.c = h.c - h.c % {HUNDRED}),
p AS (SELECT c, len(s) AS n, d, list_slice(s, 1, d) AS k FROM r, unnest(range(0, len(s) + 1)) AS u(d)),
g AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM p GROUP BY k, d),
m AS (SELECT k, d, conv_id, n_convs, ends, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(k[d].text) END AS own, (SELECT count(*) FROM g x WHERE x.d = g.d + 1 AND list_slice(x.k, 1, g.d) = g.k) AS n_children FROM g)
SELECT a.conv_id, a.d AS depth, (SELECT x.conv_id FROM g x WHERE x.d = a.d - 1 AND x.k = list_slice(a.k, 1, a.d - 1)) AS parent_conv_id, a.n_convs, a.n_children,
  CAST(sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(b.own) AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM m a JOIN m b ON b.d >= a.d AND list_slice(b.k, 1, a.d) = a.k GROUP BY a.k, a.d, a.conv_id, a.n_convs, a.n_children, a.ends"""
