"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from ampliq.plans import catalog

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([float(v[i]) if isinstance(v[i], (int, float)) and not isinstance(v[i], bool) else str(v[i]) for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert len(got) > 0
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    from decimal import Decimal

    expected = [tuple(int(v) if isinstance(v, Decimal) else v for v in r) for r in want.fetchall()]
    assert rows(df.columns, got) == rows(want.columns, expected)
