"""Every query of the catalogue against its SQL."""

import duckdb
import pytest

from rasterloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def key(row):
    return tuple(str(v) for v in row)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    if name not in catalog.ORACLE_SQL:
        assert df.count() > 0
        return
    want = con.sql(catalog.ORACLE_SQL[name])
    assert set(want.columns) == set(df.columns)
    got = [tuple(r) for r in df.select(*want.columns).collect()]
    assert sorted(got, key=key) == sorted(want.fetchall(), key=key)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["img", "channel", "sym", "n"]


def test_entry_points_without_the_optional_folder(monkeypatch):
    import importlib.util

    import __spark_entry__ as e

    plain = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith("rasterloom.llm") else plain(n, *a))
    assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.ORACLE_SQL)
