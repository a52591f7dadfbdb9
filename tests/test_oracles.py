"""Each query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from strataframe.plans import catalogue

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM read_parquet('{t}')")
    return con


def rows(of, columns):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[c]) for c in columns) for r in of), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, tables, name):
    df = catalogue.QUERIES[name](spark, DATA)
    want = tables.sql(catalogue.SQL[name])
    names = list(want.columns)
    assert sorted(df.columns) == sorted(names)
    kinds = dict(zip(names, map(str, want.types)))
    assert all(TYPES.get(t, kinds[c]) == kinds[c] for c, t in df.dtypes)
    got = rows(df.collect(), sorted(names))
    assert got == rows([dict(zip(names, r)) for r in want.fetchall()], sorted(names))
    assert got


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
