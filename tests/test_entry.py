"""The driver's contract on the smallest tables: every query runs and agrees with its SQL."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as contract
from confera.plans.oracle import SQL
from confera.plans.queries import QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == columns
        assert rows == sorted((tuple(plain(x) for x in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


def test_registry():
    assert set(SQL) <= set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_flagship(spark):
    assert contract.entry(spark).count() > 0
