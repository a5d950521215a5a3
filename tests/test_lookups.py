"""Tariff lookups by hand, on odd rows against the SQL, and by plans that don't grow with a table's square."""

import duckdb
import pytest

from tradelake.plans import lookups
from tests.test_queries import canonical

PARTS = [
    *((k, ["large ring", "hot bolt", "blue ring", "ringed plate", None, "12 7", "boltless"][k % 7], ["LARGE", "SMALL RING", "BOLT"][k % 3], ["Brand#7", "bolt hot", None, "ring"][k % 4]) for k in range(1, 300)),
    *((k, "hot bolt ring", "ECONOMY", "Brand#1") for k in range(2_000_000, 2_000_040)),
]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("parts"))
    spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{at}/part.parquet")
    return at


@pytest.mark.parametrize("name", ["hs_band_pick", "hs_search_numeric"])
def test_odd_parts(spark, parts, name):
    build, sql = lookups.QUERIES[name]
    got = build(spark, parts)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{parts}/part.parquet/*.parquet'")
    order = sorted(got.columns)
    assert canonical(map(tuple, got.select(*order).collect())) == canonical(con.sql(f"SELECT {', '.join(order)} FROM ({sql})").fetchall())


def test_beginnings_are_not_broadcast(spark, parts):
    """The table is small on disk; ten beginnings of each code are not."""
    plan = lookups.QUERIES["hs_search_numeric"][0](spark, parts)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan and "WindowGroupLimit" in plan


def test_points_are_added_by_word(spark):
    kinds = spark.createDataFrame([("1", ["ring"], ["bolt"], "a"), ("1", ["ringed", "bo"], [], "b"), ("2", ["bolt"], [], "c")], "band string, d array<string>, e array<string>, kind string")
    asked = spark.createDataFrame([("1", ["ring", "ring", "bolt"], "x"), ("1", ["bo", "rin"], "y"), ("1", [], "z")], "band string, q array<string>, id string")
    # one word of four characters or more begins the other: "rin" and "bo" begin nothing
    assert {(r.id, r.kind, r.points) for r in lookups.points_met(asked, kinds).collect()} == {("x", "a", 5), ("x", "b", 4), ("y", "b", 2)}
