"""Every registered query against its SQL on another engine."""

import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from mendline.plans.queries import QUERIES, TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value) if isinstance(value, decimal.Decimal) else repr(value)


def table(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, engine, name):
    df = entry.queries()[name](spark, DATA)
    result = engine.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = table(columns, result.fetchall())
    assert expected, "an empty result checks nothing"
    assert table(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 16
