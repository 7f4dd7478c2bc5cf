"""The SQL of the queries that have one gives the same rows."""

import duckdb
import pytest

from rasterloom.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
