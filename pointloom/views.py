"""Point, proposal and experiment tables derived from the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTS = """
SELECT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS point_id, l_suppkey % 6 AS scene_id,
       CAST(l_partkey % 97 AS DOUBLE) * 0.03 AS x, CAST(l_orderkey % 89 AS DOUBLE) * 0.03 AS y, l_discount * 3.0 AS z,
       l_tax AS r, l_discount AS g, l_quantity / 50.0 AS b,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS sem_gt, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS sem_pred,
       CAST(l_quantity AS INT) % 11 AS gt_inst, CAST(l_quantity AS INT) % 12 AS base_inst,
       CASE WHEN l_linenumber <= 5 THEN CAST(l_quantity AS INT) % 11 ELSE CAST(l_quantity AS INT) % 12 END AS pred_inst,
       l_tax * 20.0 - 0.8 AS logit0, l_discount * 20.0 - 1.0 AS logit1
FROM lineitem"""

EVENT_POINTS = """
SELECT event_id AS point_id, event_type AS scene_id, value / 100.0 AS x, CAST(user_id % 50 AS DOUBLE) * 0.1 AS y,
       CAST(event_id % 31 AS DOUBLE) * 0.01 AS z, CAST(user_id % 7 AS INT) AS inst
FROM events"""

RESULTS = """
SELECT o_orderkey AS run_id, o_orderpriority AS model, 'c' || CAST(o_custkey % 3 AS VARCHAR(4)) AS clustering,
       CASE WHEN o_orderkey % 2 = 0 THEN 'base' ELSE 'refined' END AS refinement,
       CAST(o_custkey % 23 AS INT) AS scene_id, o_totalprice / 1000.0 AS metric, CAST(o_orderkey % 5 AS INT) AS plant_id
FROM orders"""

PROPOSALS = """
SELECT DISTINCT l_suppkey % 6 AS scene_id, l_partkey % 40 AS proposal_id, l_orderkey % 500 AS point_id FROM lineitem"""

SCORES = """
SELECT l_suppkey % 6 AS scene_id, l_partkey % 40 AS proposal_id, round(avg(l_discount) * 10, 6) AS score
FROM lineitem GROUP BY 1, 2"""

VIEWS = {"points": POINTS, "event_points": EVENT_POINTS, "results": RESULTS, "proposals": PROPOSALS, "scores": SCORES}
_SOURCE = {"points": "lineitem", "event_points": "events", "results": "orders", "proposals": "lineitem", "scores": "lineitem"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = _SOURCE[name]
    return spark.sql(VIEWS[name].replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """SQL that may use the views by name, as one statement over the driver's tables."""
    used = [name for name in VIEWS if f" {name}" in sql.replace("\n", " ").replace(",", " ")]
    head = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in used)
    body = sql.strip()
    if not head:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{head},\n{body[len(start):]}"
    return f"WITH {head}\n{body}"
