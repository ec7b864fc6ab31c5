"""Every registered query of the library itself against its SQL, on the driver's smallest table."""

import os

import duckdb
import pandas as pd
import pytest

from skein.plans import coverage_queries, forecast_queries, job_queries, panel_queries, research_queries, stream_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
PARTS = (panel_queries, forecast_queries, job_queries, research_queries, coverage_queries, stream_queries)
CASES = [(p, n) for p in PARTS for n in p.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df.reindex(sorted(df.columns), axis=1)
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype.kind in "iuf":
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda v: "" if v is None or v is pd.NaT or v is pd.NA else str(v)[:19])
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("part,name", CASES, ids=[n for _, n in CASES])
def test_query_equals_sql(spark, duck, part, name):
    got, want = plain(part.QUERIES[name](spark, SF).toPandas()), plain(duck.execute(part.SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-3, rtol=1e-6)
