"""Line dedup by the spread of a line over sites, with DataFrame functions alone.

Each line's hash gathers a HyperLogLog sketch of its sites, merged by aggregation. Lines whose estimate is clear of the
threshold are decided by it; for those near it distinct sites are counted exactly. A line on at least `min_sites` sites
is boilerplate: it stays where it stands first (smallest doc_id, then first place) and goes everywhere else.

A null text is one empty line; lines of spaces alone are never boilerplate; a null site is no site. Rows with the same
doc_id and text share places, so repeats of the first row keep the line too. Lines are told apart by a 64-bit hash
beside a CRC-32.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

MIN_SITES, LG_K = 10, 12
#: Estimates within these shares of the threshold are near it; the sketch's standard error is 1.04 / 2 ** (LG_K / 2).
NEAR_LOW, NEAR_HIGH = 0.8, 1.25


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, min_sites: int, tables: Tables) -> DataFrame:
    """h, c (hashes of a line), doc and at (where it stands first) of every boilerplate line; docs: doc, site and text."""
    lines = docs.select("doc", F.col("site").cast("string").alias("site"), F.posexplode(_lines_of(F.col("text"))).alias("at", "line")).where(F.trim("line") != "")
    keyed = lines.select(F.xxhash64("line").alias("h"), F.crc32("line").alias("c"), "site", "doc", "at")
    sketches = keyed.groupBy("h", "c").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("doc", "at")).alias("first"))
    # a sketch of few values is exact, so a line on one site never gets this far
    spread = sketches.select("h", "c", F.hll_sketch_estimate("sketch").alias("sites"), "first.doc", "first.at")
    found = tables.write(spread.where(F.col("sites") >= NEAR_LOW * min_sites), "candidates")
    clear = found.where(F.col("sites") > NEAR_HIGH * min_sites)
    near = found.where(F.col("sites") <= NEAR_HIGH * min_sites)
    pairs = keyed.select("h", "c", "site").join(near.select("h", "c"), ["h", "c"], "left_semi").distinct()
    exact = pairs.groupBy("h", "c").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites)
    return tables.write(clear.unionByName(near.join(exact.select("h", "c"), ["h", "c"], "left_semi")).drop("sites"), "boilerplate")


def remove_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """All columns of docs, the text without the lines that go, and n_lines and n_removed (names it replaces if taken)."""
    names, tables = docs.columns, Tables(docs.sparkSession, "lines")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc, where, body = (F.col(f"c{names.index(c)}") for c in ("doc_id", site, text))
    slim = plain.select(doc.alias("doc"), where.alias("site"), body.alias("text"))
    common = boilerplate(slim, min_sites, tables)
    placed = slim.select(F.col("doc").alias("_doc"), F.xxhash64("text").alias("_of"), F.posexplode(_lines_of(F.col("text"))).alias("_at", "line"))
    placed = placed.select("_doc", "_of", "_at", F.xxhash64("line").alias("h"), F.crc32("line").alias("c"))
    again = placed.join(common, ["h", "c"]).where(~(F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_at") == F.col("at"))))
    gone = again.groupBy("_doc", "_of").agg(F.collect_set("_at").alias("gone"))
    joined = plain.join(gone, doc.eqNullSafe(F.col("_doc")) & (F.xxhash64(body) == F.col("_of")), "left").withColumn("lines", _lines_of(body))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    rest = F.array_join(F.transform(left, lambda p: F.get(F.col("lines"), p)), "\n")
    none = F.col("gone").isNull()
    old = [(i, c) for i, c in enumerate(names) if c not in ("n_lines", "n_removed")]
    kept = [F.when(none, body).otherwise(rest) if c == text else F.col(f"c{i}") for i, c in old]
    counts = [F.size("lines").cast("long"), F.when(none, 0).otherwise(F.size("gone")).cast("long")]
    return joined.select(*[c.alias(f"new{i}") for i, c in enumerate([*kept, *counts])]).toDF(*[c for _, c in old], "n_lines", "n_removed")


def oracle_sql(min_sites: int = MIN_SITES) -> str:
    return f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
b AS (SELECT line FROM l WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
r AS (
  SELECT l.*, b.line IS NOT NULL AND row_number() OVER (PARTITION BY l.line ORDER BY doc_id, pos) > 1 AS gone
  FROM l LEFT JOIN b ON l.line = b.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id"""
