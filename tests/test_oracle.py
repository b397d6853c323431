"""Every registered query against its DuckDB oracle on the smallest test tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from timberline.fixtures import TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if "datetime" in type(v).__name__ else v.isoformat()
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted("|".join(_norm(r[c]) for c in cols) for r in pdf.to_dict("records"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "ts", "hostname", "source", "unit", "severity", "pid", "message"]
    assert df.count() > 0


@pytest.mark.parametrize("key", sorted(E.queries()))
def test_query_matches_oracle(spark, duck, key):
    sdf = E.queries()[key](spark, SF)
    spark_pdf = pd.DataFrame([r.asDict() for r in sdf.collect()], columns=sdf.columns)
    sql = E.oracle_sql().get(key)
    if sql is None:
        assert len(spark_pdf) >= 1
        return
    assert _rows(spark_pdf) == _rows(duck.execute(sql).df())
