"""Every registered query gives the rows of its SQL at the smallest scale."""

import math
import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return "null" if isinstance(value, float) and math.isnan(value) else f"{float(value):.6f}"
    return "null" if value is None else f"{float(value):.6f}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    found = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [found.columns.index(c) for c in order]
    theirs = sorted(tuple(plain(r[k]) for k in at) for r in found.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
