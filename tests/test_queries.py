"""Every query that has SQL against DuckDB over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from weft.catalog import all_queries, all_sql

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.7g}") if v else 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_matches_sql(spark, con, name):
    df = all_queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cursor = con.execute(all_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_runs(spark, name):
    df = all_queries()[name](spark, DATA)
    assert df.columns
    df.collect()
