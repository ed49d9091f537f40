"""Every registered query against its SQL twin on the smallest tables."""

import collections

import duckdb
import pytest

import __spark_entry__ as contract
from docketry.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None:
        return None
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return (type(value).__name__, str(value))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(rows) >= 1
        return
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == columns
    theirs = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    assert collections.Counter(map(plain, rows)) == collections.Counter(map(plain, theirs))
