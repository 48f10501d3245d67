"""Queries on small tables whose keys are as large as those of large tables, against their SQL."""

import os

import duckdb
import pytest

from weft.catalog import all_queries, all_sql

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_bridge_suggestions_with_large_ids(spark, tmp_path):
    con = duckdb.connect()
    for name, key in (("customer", "c_custkey"), ("orders", "o_custkey")):
        far = f"SELECT * REPLACE ({key} + 1000000 * ({key} % 3) AS {key}) FROM '{DATA}/{name}.parquet'"
        con.execute(f"COPY ({far}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = all_queries()["q04_bridge_suggestions"](spark, str(tmp_path)).select("source", "target", "hops").collect()
    want = con.execute(f"SELECT source, target, hops FROM ({all_sql()['q04_bridge_suggestions']})").fetchall()
    assert want and sorted(map(tuple, got)) == sorted(want)
