"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf, db, name):
    want, got = db.sql(registry.SQL[name]).df(), registry.QUERIES[name](spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    key = sorted(got.columns)
    want, got = (x[key].sort_values(key, ignore_index=True) for x in (want, got))
    for c in key:
        if want[c].dtype.kind == "M":
            want[c], got[c] = pd.to_datetime(want[c]), pd.to_datetime(got[c])
    pd.testing.assert_frame_equal(got.astype(object).where(got.notna(), None).infer_objects(), want.astype(object).where(want.notna(), None).infer_objects(), check_dtype=False, rtol=1e-5, atol=2e-5)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.SQL.keys()))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
