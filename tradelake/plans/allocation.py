"""Queries of the allocation operators: jobs are orders, items are lineitems, money is cents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import apportion as a
from ..operators.relational import first_of
from ..sources.tables import ITEMS_SQL, items, read

G, O = ["l_orderkey"], ["ord"]  # noqa: E741


def _with_total(s, d):
    total = read(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long").alias("total"))
    return items(s, d).join(total, "l_orderkey").select("l_orderkey", "ord", "cents", "total", "l_quantity", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber")


_TOTAL = f"{ITEMS_SQL}, j AS (SELECT i.*, CAST(round(o_totalprice * 100) AS BIGINT) AS total FROM items i JOIN orders ON l_orderkey = o_orderkey)"


def _lr_sql(source: str, basis: str, total: str, name: str) -> str:
    """CTEs that add `share` by largest remainder."""
    return f"""{name}_w AS (SELECT *, CASE WHEN sum({basis}) OVER g > 0 THEN {basis} ELSE 1 END::HUGEINT AS b_, CASE WHEN sum({basis}) OVER g > 0 THEN sum({basis}) OVER g ELSE count(*) OVER g END::HUGEINT AS w_, {total}::HUGEINT AS t_ FROM {source} WINDOW g AS (PARTITION BY l_orderkey)),
{name}_d AS (SELECT *, (t_ * b_) // w_ AS down_, (t_ * b_) % w_ AS rest_ FROM {name}_w),
{name} AS (SELECT * EXCLUDE (b_, w_, t_, down_, rest_), (down_ + CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY rest_ DESC, ord) <= t_ - sum(down_) OVER (PARTITION BY l_orderkey) THEN 1 ELSE 0 END)::BIGINT AS {name}_share FROM {name}_d)"""


def _largest(s, d):
    return a.largest_remainder(_with_total(s, d), G, O, "cents", "total", "share").select("l_orderkey", "ord", "cents", "total", "share")


def _floors(s, d):
    x = _with_total(s, d).withColumn("total", F.expr("total div 100")).withColumn("floor", F.when(F.col("l_returnflag") == "R", 40000).otherwise(100).cast("long"))
    return a.with_floors(x, G, O, "cents", "total", "floor", "share").select("l_orderkey", "ord", "floor", "total", "share")


def _zero(s, d):
    x = _with_total(s, d).withColumn("basis", F.when(F.col("l_linestatus") == "F", F.lit(0)).otherwise(F.col("cents")).cast("long"))
    return a.largest_remainder(x, G, O, "basis", "total", "share").select("l_orderkey", "ord", "basis", "share")


def _residual(s, d):
    return a.residual_to_largest(_with_total(s, d), G, O, "cents", "total", "share").select("l_orderkey", "ord", "share")


def _running(s, d):
    x = items(s, d).withColumn("qty", F.col("l_quantity").cast("long")).withColumn("total", F.lit(1000).cast("long"))
    return a.running_split(x, ["l_orderkey", "l_returnflag"], O, "qty", "total", "cartons").select("l_orderkey", "l_returnflag", "ord", "cartons")


def _valuation(s, d):
    x = _with_total(s, d)
    rate = F.lit("1.3275").cast("decimal(10,4)")
    national = F.round(F.col("cents").cast("decimal(18,0)") * rate, 0).cast("long")
    sums = x.groupBy("l_orderkey").agg(F.sum("cents").alias("foreign_total"), F.sum(national).alias("sum_of_rounded"))
    return sums.select("l_orderkey", "foreign_total", "sum_of_rounded", F.round(F.col("foreign_total").cast("decimal(18,0)") * rate, 0).cast("long").alias("rounded_sum"))


def _bands(s, d):
    sums = _with_total(s, d).groupBy("l_orderkey", "total").agg(F.sum("cents").alias("goods"))
    code = F.when(F.abs(F.col("total") - F.col("goods")) <= 50, "OK").when(F.col("goods") * 100 < F.col("total") * 80, "ROWS_INCOMPLETE").otherwise("TOTAL_MISMATCH")
    return sums.select("l_orderkey", "goods", "total", code.alias("code"))


def _net_ladder(s, d):
    x = items(s, d).join(read(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    qty = F.col("l_quantity").cast("long")
    value, source = first_of(PIN=F.when(F.col("ord") == 1, qty * 900), INVOICE=F.when(F.col("l_tax") > 0.04, qty * 1000), DESCRIPTION=F.when(F.col("p_size") > 25, qty * F.col("p_size") * 20), RATIO=F.expr("cents * 7 div 10"))
    return x.select("l_orderkey", "ord", value.cast("long").alias("net_grams"), source.alias("net_source"))


def _plausible(s, d):
    x = items(s, d).withColumn("unit", F.expr("cents div greatest(1, cast(l_quantity as bigint))"))
    middle = x.groupBy("l_orderkey", "l_returnflag").agg(F.expr("percentile(unit, 0.5)").alias("middle"), F.count("*").alias("n"))
    x = x.join(middle, ["l_orderkey", "l_returnflag"])
    flag = (F.col("n") >= 2) & ((F.col("unit") >= 3 * F.col("middle")) | (F.col("unit") * 3 <= F.col("middle")))
    return x.select("l_orderkey", "ord", "unit", "middle", flag.alias("implausible"))


def _prorate(s, d):
    o = read(s, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("form"))
    gross = items(s, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("cents").alias("authority"))
    x = o.join(gross, "o_orderkey")
    freight = F.when(F.col("form") > F.col("authority"), F.expr("(2 * cast(100000 as decimal(18,0)) * authority + form) div (2 * form)")).otherwise(F.lit(100000))
    return x.select("o_orderkey", "form", "authority", freight.cast("long").alias("freight"))


QUERIES = {
    "alloc_largest_remainder": (_largest, f"WITH {_TOTAL}, {_lr_sql('j', 'cents', 'total', 's')} SELECT l_orderkey, ord, cents, total, s_share AS share FROM s"),
    "alloc_with_floors": (_floors, f"""WITH {_TOTAL}, k AS (SELECT * EXCLUDE (total), total // 100 AS total, CASE WHEN l_returnflag = 'R' THEN 40000 ELSE 100 END::BIGINT AS floor FROM j),
{_lr_sql('k', 'cents', 'total', 'p')}, l AS (SELECT *, (total - sum(floor) OVER (PARTITION BY l_orderkey))::BIGINT AS left_ FROM p), l2 AS (SELECT *, greatest(left_, 0) AS left2 FROM l), {_lr_sql('l2', 'cents', 'left2', 'q')}
SELECT l_orderkey, ord, floor, total, CASE WHEN left_ < 0 THEN NULL WHEN min(CASE WHEN p_share >= floor THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) = 1 THEN p_share ELSE floor + q_share END AS share FROM q"""),
    "alloc_zero_basis_equal": (_zero, f"WITH {_TOTAL}, k AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 0 ELSE cents END AS basis FROM j), {_lr_sql('k', 'basis', 'total', 's')} SELECT l_orderkey, ord, basis, s_share AS share FROM s"),
    "cost_alloc_residual_to_max": (_residual, f"""WITH {_TOTAL}, w AS (SELECT *, sum(cents) OVER (PARTITION BY l_orderkey)::HUGEINT AS w_ FROM j), n AS (SELECT *, (2 * total::HUGEINT * cents + w_) // (2 * w_) AS near FROM w)
SELECT l_orderkey, ord, (near + CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY cents DESC, ord) = 1 THEN total - sum(near) OVER (PARTITION BY l_orderkey) ELSE 0 END)::BIGINT AS share FROM n"""),
    "shared_carton_split": (_running, f"""WITH {ITEMS_SQL}, w AS (SELECT *, (1000 * l_quantity::BIGINT) // greatest(1, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey, l_returnflag)) AS down_ FROM items)
SELECT l_orderkey, l_returnflag, ord, CASE WHEN lead(1) OVER o IS NULL THEN 1000 - coalesce(sum(down_) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE down_ END::BIGINT AS cartons FROM w WINDOW o AS (PARTITION BY l_orderkey, l_returnflag ORDER BY ord)"""),
    "valuation_cif_alpha": (_valuation, f"WITH {ITEMS_SQL} SELECT l_orderkey, sum(cents)::BIGINT AS foreign_total, sum(((cents::HUGEINT * 13275 + 5000) // 10000))::BIGINT AS sum_of_rounded, ((sum(cents)::HUGEINT * 13275 + 5000) // 10000)::BIGINT AS rounded_sum FROM items GROUP BY l_orderkey"),
    "invoice_totals_bands": (_bands, f"WITH {_TOTAL}, k AS (SELECT l_orderkey, total, sum(cents)::BIGINT AS goods FROM j GROUP BY ALL) SELECT l_orderkey, goods, total, CASE WHEN abs(total - goods) <= 50 THEN 'OK' WHEN goods * 100 < total * 80 THEN 'ROWS_INCOMPLETE' ELSE 'TOTAL_MISMATCH' END AS code FROM k"),
    "net_weight_ladder": (_net_ladder, f"""WITH {ITEMS_SQL} SELECT l_orderkey, ord, (CASE WHEN ord = 1 THEN l_quantity::BIGINT * 900 WHEN l_tax > 0.04 THEN l_quantity::BIGINT * 1000 WHEN p_size > 25 THEN l_quantity::BIGINT * p_size * 20 ELSE cents * 7 // 10 END)::BIGINT AS net_grams,
CASE WHEN ord = 1 THEN 'PIN' WHEN l_tax > 0.04 THEN 'INVOICE' WHEN p_size > 25 THEN 'DESCRIPTION' ELSE 'RATIO' END AS net_source FROM items JOIN part ON l_partkey = p_partkey"""),
    "unit_weight_plausibility": (_plausible, f"""WITH {ITEMS_SQL}, u AS (SELECT *, cents // greatest(1, l_quantity::BIGINT) AS unit FROM items), m AS (SELECT l_orderkey, l_returnflag, quantile_cont(unit::DOUBLE, 0.5) AS middle, count(*) AS n FROM u GROUP BY ALL)
SELECT l_orderkey, ord, unit, middle, n >= 2 AND (unit >= 3 * middle OR unit * 3 <= middle) AS implausible FROM u JOIN m USING (l_orderkey, l_returnflag)"""),
    "freight_prorate": (_prorate, f"""WITH {ITEMS_SQL}, g AS (SELECT l_orderkey AS o_orderkey, sum(cents)::BIGINT AS authority FROM items GROUP BY 1), x AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS form, authority FROM orders JOIN g USING (o_orderkey))
SELECT *, CASE WHEN form > authority THEN (200000::HUGEINT * authority + form) // (2 * form) ELSE 100000 END::BIGINT AS freight FROM x"""),
}
