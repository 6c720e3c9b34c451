"""The driver's contract: every query has a callable, names agree, and a spread of them equals the SQL on the small tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def _norm(v):
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return f"{v:.9g}" if abs(v) > 1e-12 else "0"
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found"} <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p5_found", "p5_proxies", "p5_users", "m01_sma", "m02_wma", "t06_statistical_trend", "a01_anomalies_iqr", "d31_kaplan_meier", "f01_funnel_ordered", "n16_flux_recipe", "q_tpch3", "g01_lineage_trace", "i01_ranking_metrics", "s03_sessions"])
def test_equals_sql(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    import pandas as pd

    rows = lambda d: sorted(tuple(_norm(None if x is pd.NaT or x is pd.NA else x) for x in r) for r in d[cols].astype(object).itertuples(index=False))
    assert [tuple(map(lambda x: x.replace(".0", ""), r)) for r in rows(got)] == [tuple(map(lambda x: x.replace(".0", ""), r)) for r in rows(want)]


def test_found_columns(spark, sf):
    want = {
        "p1_found": [("table_name", "string"), ("record_key", "string"), ("ref_id", "string"), ("touched_month", "string")],
        "p2_found": [("object_id", "string"), ("load_id", "int"), ("pos", "int"), ("grader_ref", "string")],
        "p3_found": [("table_name", "string"), ("column_name", "string"), ("load_id", "int"), ("finding", "string")],
        "p4_found": [("tree", "string"), ("node_id", "string"), ("root_id", "string"), ("node_depth", "int")],
        "p5_found": [("field_name", "string"), ("key_value", "bigint")],
    }
    for name, cols in want.items():
        assert entry.queries()[name](spark, sf).dtypes == cols, name
