"""Corpus queries that SQL can express give its rows, on the smallest tables."""

import os

import duckdb
import pytest

from ratewell.llm.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables aren't here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    key = next(c for c in ("doc_id", "page_id", "vec_id") if c in got.columns)
    want, got = (x.sort_values(key).reset_index(drop=True) for x in (want, got))
    assert (got[want.columns].astype(str) == want.astype(str)).all().all()
