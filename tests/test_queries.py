"""Every query with SQL gives DuckDB's rows."""

import glob
import math
import os

import duckdb
import pytest

from tradelake.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(rows):
    def cell(x):
        return "~" if x is None else f"{x:.6f}" if isinstance(x, float) and not math.isnan(x) else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    want = canonical(duck.sql(f"SELECT {', '.join(order)} FROM ({SQL[name]})").fetchall())
    assert canonical(map(tuple, got.select(*order).collect())) == want
    assert want
