"""Every query of the library against its SQL, on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from spinmill.plans import catalog, more, runs  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def cells(rows, columns):
    one = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, float) else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got.collect(), got.columns) == cells(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())
