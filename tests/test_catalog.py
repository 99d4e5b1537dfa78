from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
CORE = sorted(k for k in entry.oracle_sql() if not k.startswith("p") or not k[1].isdigit())


def rows(df):
    def cell(x):
        if x is None or (not isinstance(x, list) and pd.isna(x)):
            return "null"
        if isinstance(x, float) or (isinstance(x, int) and not isinstance(x, bool)):
            return repr(round(float(x), 5) + 0.0) if math.isfinite(x) else str(x)
        return str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
