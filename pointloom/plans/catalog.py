"""All queries of the library and the SQL that they are checked against."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLE_SQL, QUERIES

for _name in ("point_queries", "join_queries", "metric_queries", "cluster_queries", "source_queries"):
    import_module(f"{__package__}.{_name}")

FLAGSHIP = "me1_instance_matching"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
