"""Every registered query against its SQL, on the smallest given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from workload.inputs import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _plain(rows, order):
    def cell(v):
        v = v.item() if hasattr(v, "item") else v
        return None if isinstance(v, float) and math.isnan(v) else v

    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, FOLDER)
    want = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    names = sorted(columns)
    rows = _plain(got.collect(), [got.columns.index(c) for c in names])
    assert rows == _plain(want.fetchall(), [columns.index(c) for c in names])


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
