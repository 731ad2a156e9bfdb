"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from cartmill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(float(v)) if isinstance(v, decimal.Decimal) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(rows) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_all_oracles_have_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
