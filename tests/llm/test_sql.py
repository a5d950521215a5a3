"""The registered queries with SQL give DuckDB's rows on the given tables."""

import glob
import os

import duckdb
import pytest

from tradelake.llm import queries as llm

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = llm.queries()[name](spark, SF)
    order = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(order)} FROM ({llm.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(str, want))
