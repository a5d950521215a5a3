"""Properties of the operators that SQL doesn't express, against plain Python."""

import random

import pytest

from tradelake.operators.apportion import with_ceilings
from tradelake.operators.matching import greedy
from tradelake.plans import catalogue

SF = "/root/testdata/sf0.001"


def claimed(pairs):
    out, left, right = [], set(), set()
    for g, a, b, s in sorted(set(pairs), key=lambda p: (p[0], -p[3], p[1], p[2])):
        if (g, a) not in left and (g, b) not in right:
            left.add((g, a))
            right.add((g, b))
            out.append((g, a, b, s))
    return sorted(out)


def test_greedy_claims_in_order_of_score(spark):
    r = random.Random(3)
    pairs = [(g, r.randrange(6), r.randrange(6), r.randrange(4)) for g in range(12) for _ in range(20)]
    best = {}
    for g, a, b, s in pairs:
        best[g, a, b] = max(s, best.get((g, a, b), 0))
    pairs = [(*k, s) for k, s in best.items()]
    got = greedy(spark.createDataFrame(pairs, "g int, a int, b int, s int"), ["g"], "a", "b", "s")
    assert sorted(map(tuple, got.select("g", "a", "b", "s").collect())) == claimed(pairs)
    assert greedy(spark.createDataFrame([], "g int, a int, b int, s int"), ["g"], "a", "b", "s").count() == 0


def test_ceilings_hold_and_sums_are_exact(spark):
    r = random.Random(7)
    rows = []
    for g in range(200):
        total = r.randrange(0, 5000)
        zero = g % 10 == 0
        rows += [(g, i, 0 if zero else r.randrange(0, 100), total, r.randrange(0, 1500)) for i in range(r.randrange(1, 12))]
    got = with_ceilings(spark.createDataFrame(rows, "g int, i int, b long, t long, c long"), ["g"], ["i"], "b", "t", "c", "share").collect()
    groups = {}
    for x in got:
        groups.setdefault(x.g, []).append(x)
    feasible = 0
    for xs in groups.values():
        equal = sum(x.b for x in xs) == 0
        room = sum(x.c for x in xs if equal or x.b > 0)
        if room < xs[0].t:
            assert all(x.share is None for x in xs)
            continue
        feasible += 1
        assert sum(x.share for x in xs) == xs[0].t
        assert all(0 <= x.share <= x.c for x in xs)
        level = [x.share / (1 if equal else x.b) for x in xs if x.share < x.c - 1 and (equal or x.b)]
        for x in xs:  # a capped item has no more for its basis than an open one, but for a unit
            if level and x.share == x.c and (equal or x.b):
                assert (x.share - 1) / (1 if equal else x.b) <= max(level) + 1
    assert feasible > 50


@pytest.mark.parametrize("name", ["match_greedy_similarity", "xml_struct"])
def test_runs_over_whole_tables(spark, name):
    rows = catalogue.queries()[name](spark, SF).collect()
    assert len(rows) > 100
    if name == "xml_struct":
        assert all(r["items"].startswith("<item>") and r["items"].rstrip().endswith("</item>") for r in rows)


def test_subset_sums_of_many_totals(spark, tmp_path):
    """As the reference: all single totals, and all sums of the 8 smallest distinct ones."""
    r = random.Random(5)
    orders, lines, want = [], [], {}
    for key in range(120):
        prices = [r.randrange(1000, 400_000) for _ in range(r.choice([3, 8, 9, 12, 17]))]
        total = r.choice([r.choice(prices), sum(sorted(prices)[:6]), sum(sorted(prices)[-3:]), sum(prices)])
        orders.append((key, total / 100))
        lines += [(key, i, 1, 1, p / 100, 1.0, 0.0, 0.0, "N", "O") for i, p in enumerate(prices)]
        small = sorted(set(prices))[:8]
        sums = {sum(p for i, p in enumerate(small) if bits >> i & 1) for bits in range(1, 1 << len(small))} | set(prices)
        want[key] = (len(set(prices)), any(abs(y - total) * 100 <= max(total * 2, 500) for y in sums))
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalogue.queries()["subset_sum_totals_gate"](spark, str(tmp_path))
    assert {x.l_orderkey: (x.n_totals, x.matched) for x in got.collect()} == want
    assert {m for n, m in want.values() if n > 8} == {True, False}


def test_groups_of_a_margin_cross_batches(spark):
    """Groups are taken whole from sorted batches, whatever these cut; a null group is one as well."""
    from tradelake.operators.matching import with_margin

    pairs = [(g, a, b, (a * 7 + b * 5 + len(g or "")) % 40 + 20) for g in ("x", "yy", None, "zzz") for a in range(4) for b in range(3)]
    df = spark.createDataFrame([*pairs, ("x", 9, 9, None)], "job string, l int, r int, score int")
    whole = sorted(map(str, with_margin(df, "job", "l", "r", "score", 8, 50).collect()))
    plan = with_margin(df, "job", "l", "r", "score", 8, 50)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        cut = sorted(map(str, with_margin(df, "job", "l", "r", "score", 8, 50).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cut == whole and len(whole) == 16 and "FlatMapGroupsInArrow" not in plan
