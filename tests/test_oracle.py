"""Every query with SQL gives the rows that DuckDB gives for it."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        out.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return out


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, db, name):
    found = contract.queries()[name](spark, SF)
    want = db.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    got_rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    at = [want.columns.index(c) for c in columns]
    want_rows = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert len(got_rows) == len(want_rows)
    bad = [(a, b) for a, b in zip(got_rows, want_rows) if a != b]
    assert not bad, (len(bad), bad[:3])
    assert got_rows or name.startswith("_")


def test_flagship(spark):
    assert contract.entry(spark).count() == 1
