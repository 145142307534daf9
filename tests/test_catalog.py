"""Every query against its SQL, and entry points, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from pointloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(found):
    return sorted(tuple("null" if v is None else repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert rows(df.select(columns).collect()) == rows(expected)


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["scene_id", "pred", "gt", "n", "pred_area", "gt_area", "iou"]
