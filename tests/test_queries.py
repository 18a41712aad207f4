"""Every registered query against its DuckDB twin on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, data):
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(set(df.columns)) == len(df.columns)
    if name not in SQL:
        assert got
        return
    cur = duck.execute(SQL[name])
    want_names = [d[0] for d in cur.description]
    assert sorted(want_names) == sorted(df.columns)
    assert got == rows(want_names, cur.fetchall())


def test_contract(spark):
    assert set(SQL) <= set(QUERIES)
    assert entry.entry(spark).count() > 0
