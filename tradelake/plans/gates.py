"""Queries of reconciliation gates, candidate selection and declaration checks: jobs are orders, items are lineitems, money is cents."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.cells import tokens
from ..operators import apportion as a
from ..operators.matching import greedy
from ..operators.relational import best_row, limited
from ..sources.tables import ITEMS_SQL, items, read
from .allocation import _TOTAL, _lr_sql, _with_total
from .goods import GREEDY_SQL


def _ceilings(s, d):
    x = _with_total(s, d).withColumn("total", F.expr("total div 2")).withColumn("cap", F.when(F.col("l_linestatus") == "F", F.expr("cents div 3")).otherwise(F.col("cents") * 2))
    return a.with_ceilings(x, ["l_orderkey"], ["ord"], "cents", "total", "cap", "share").select("l_orderkey", "ord", "total", "cap", "share")


def _density(s, d):
    """Grams of items without a weight from the density of their unit's items, else of all the order's."""
    x = items(s, d).withColumn("stated", F.when(F.col("l_tax") > 0.02, F.col("l_quantity").cast("long") * 500))
    for name, w in (("u", Window.partitionBy("l_orderkey", "l_returnflag")), ("j", Window.partitionBy("l_orderkey"))):
        known = F.col("stated").isNotNull()
        x = x.withColumn(f"{name}_e", F.sum("stated").over(w)).withColumn(f"{name}_f", F.sum(F.when(known, F.col("cents"))).over(w))
    near = "(2 * cast(cents as decimal(18,0)) * {0}_e + {0}_f) div (2 * {0}_f)"
    guess = F.coalesce(F.when(F.col("u_f") > 0, F.expr(near.format("u"))), F.when(F.col("j_f") > 0, F.expr(near.format("j"))), F.lit(1).cast("long"))
    return x.select("l_orderkey", "ord", F.coalesce("stated", F.greatest(F.lit(1).cast("long"), guess)).alias("basis"), F.col("stated").isNull().alias("estimated"))


def _freight(s, d):
    """The largest of an order's freight candidates in its own currency or a blank one; foreign ones are counted."""
    c = read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 3).alias("own"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    x = read(s, d, "orders").select("o_orderkey", "o_custkey", cents.alias("cents")).join(c, "o_custkey")
    made = lambda name, amount, currency: F.struct(amount.cast("long").alias("amount"), F.lit(name).alias("source"), currency.cast("int").alias("currency"))
    every = F.array(made("WAYBILL", F.expr("cents div 50"), F.col("o_orderkey") % 3), made("BANK", F.expr("cents div 40"), F.col("o_custkey") % 3), made("INVOICE", F.lit(150000), F.lit(None)))
    fits = lambda z: z["currency"].isNull() | (z["currency"] == F.col("own"))
    best = F.array_max(F.transform(F.filter(every, fits), lambda z: F.struct(z["amount"], z["source"])))
    return x.select("o_orderkey", best["amount"].alias("freight"), best["source"].alias("source"), F.size(F.filter(every, lambda z: ~fits(z))).alias("n_foreign"))


def _subset(s, d):
    """Whether a printed total of an order, or a sum of its 8 smallest distinct ones, is within 2 % of its own total."""
    x = _with_total(s, d).groupBy("l_orderkey", "total").agg(F.array_sort(F.collect_set("cents")).alias("t"))
    zero = F.array(F.lit(0).cast("long"))
    sums = F.aggregate(F.slice("t", 1, 8), zero, lambda acc, v: F.concat(acc, F.transform(acc, lambda y: y + v)))
    hit = F.exists(F.concat(F.slice("sums", 2, 255), "t"), lambda y: F.abs(y - F.col("total")) * 100 <= F.greatest(F.col("total") * 2, F.lit(500)))
    return x.withColumn("sums", sums).select("l_orderkey", F.size("t").alias("n_totals"), F.coalesce(hit, F.lit(False)).alias("matched"))


def _supplementary(s, d):
    """The number of a tariff's own units, in ten-thousandths: kilograms, pairs, dozens, square metres, else pieces."""
    x = items(s, d).join(read(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey").withColumn("q", F.col("l_quantity").cast("long"))
    kind = F.element_at(F.array(*(F.lit(u) for u in ("KGM", "UNT", "PR", "DZN", "SQM"))), (F.col("p_size") % 5 + 1).cast("int"))
    tens = F.when(F.col("unit") == "KGM", F.expr("cents * 7")).when(F.col("unit") == "PR", F.col("q") * 5000).when(F.col("unit") == "DZN", F.expr("(q * 10000 + 6) div 12")).when(F.col("unit") == "SQM", F.col("q") * 15240).otherwise(F.col("q") * 10000)
    return x.withColumn("unit", kind).select("l_orderkey", "ord", "unit", tens.cast("long").alias("amount"))


def _serial(s, d):
    """Orders of 3 items or more whose line numbers count up by one: a serial column, not a number of cartons."""
    step = F.col("l_linenumber") - F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("ord"))
    return items(s, d).select("l_orderkey", step.alias("step")).groupBy("l_orderkey").agg(F.count("*").alias("n"), ((F.count("*") >= 3) & F.coalesce(F.bool_and(F.col("step") == 1), F.lit(False))).alias("serial"))


def _band(s, d):
    """Opening words of turns that no turn next to them holds: an equal join on the turns around, not a range join."""
    x = read(s, d, "conversations").where("text is not null").withColumn("ws", F.split(F.lower("text"), " "))
    anchors = x.select("conv_id", "turn", "role", F.col("ws")[0].alias("word")).distinct()
    near = x.select("conv_id", "turn", F.explode("ws").alias("word")).distinct().select("conv_id", "word", F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1)).alias("turn"))
    return anchors.join(near, ["conv_id", "turn", "word"], "left_anti").select("conv_id", "turn", "role", "word")


def _grounding(s, d):
    """Words of benchmark items that no document prints."""
    seen = read(s, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    asked = read(s, d, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("word")).distinct()
    return asked.join(seen, "word", "left_anti").groupBy("item_id").agg(F.count("*").alias("ungrounded"))


def _unknown_costs(s, d):
    cost = F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("long"))
    x = read(s, d, "events").withColumn("month", F.to_date(F.trunc("ts", "month"))).withColumn("cost", cost)
    return x.groupBy("user_id", "month").agg(F.sum("cost").alias("known_cents"), F.count_if(F.col("cost").isNull()).alias("unknown"))


def _dual(s, d):
    """Two windows at once (3 a day, 10 a week): the wait is the longer of both."""
    e = read(s, d, "events").where("event_type = 'error'").select("event_id", "user_id", F.expr("unix_timestamp(cast(ts as timestamp))").alias("at"))
    day = limited(e, "user_id", "at", 86400, 3).withColumnsRenamed({"n": "n_day", "retry_after": "wait_day"})
    both = limited(day, "user_id", "at", 604800, 10)
    return both.select("event_id", "user_id", "n_day", F.col("n").alias("n_week"), F.greatest("wait_day", "retry_after").alias("retry_after"))


def _authority(s, d):
    """Each order's governing document: the first rung that is there, then the largest amount, then the first place."""
    x = items(s, d).withColumn("rung", F.coalesce(F.try_element_at(F.create_map(F.lit("R"), F.lit(1), F.lit("A"), F.lit(2)), "l_returnflag"), F.lit(3)))
    return best_row(x, ["l_orderkey"], [F.col("rung"), F.desc("cents"), F.col("ord")]).select("l_orderkey", "rung", "ord", "cents")


def _waybill(s, d):
    """A customer's waybill by points (status, priority, amount); taken only if it leads the next by 30."""
    points = F.when(F.col("o_orderstatus") == "F", 40).otherwise(0) + F.when(F.col("o_orderpriority").startswith("1"), 30).otherwise(0) + F.when(F.col("o_totalprice") > 200000, 20).otherwise(0)
    w = Window.partitionBy("o_custkey").orderBy(F.desc("score"), "o_orderkey")
    x = read(s, d, "orders").withColumn("score", points).withColumn("next", F.lead("score").over(w)).withColumn("place", F.row_number().over(w)).where("place = 1")
    return x.select("o_custkey", "o_orderkey", F.col("score").cast("int").alias("score"), (F.col("next").isNull() | (F.col("score") - F.col("next") >= 30)).alias("taken"))


def _similar(s, d):
    """Goods of an order against its packing names (another part of the brand's list): scored by shared tokens, claimed greedily."""
    part = read(s, d, "part").select("p_partkey", tokens(F.concat_ws(" ", "p_name", "p_type")).alias("t"))
    x = items(s, d).select("l_orderkey", "ord", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey").select("l_orderkey", "ord", "t")
    goods, packing = x.where("ord % 2 = 1").select("l_orderkey", F.col("ord").alias("item"), F.col("t").alias("a")), x.where("ord % 2 = 0").select("l_orderkey", F.col("ord").alias("packing"), F.col("t").alias("b"))
    words = goods.select("l_orderkey", "item", "a", F.explode("a").alias("w")).join(packing.select("l_orderkey", "packing", "b", F.explode("b").alias("w")), ["l_orderkey", "w"])
    scored = words.groupBy("l_orderkey", "item", "packing").agg(F.count("*").alias("k"), F.first(F.size("a") + F.size("b")).alias("n"))
    pairs = scored.select("l_orderkey", "item", "packing", F.expr("cast(200 * k div n as int)").alias("score"))
    return greedy(pairs, ["l_orderkey"], "item", "packing", "score")


def _declaration(s, d):
    """An order's findings: no items, a buyer or supplier that no table has, items off the printed total. Ready if none blocks."""
    o = read(s, d, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("total"))
    buyer = read(s, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("buyer"))
    seller = read(s, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).alias("seller"))
    per = items(s, d).join(seller, "l_suppkey", "left").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("cents").alias("goods"), F.count_if(F.col("seller").isNull()).alias("unknown"))
    x = o.join(buyer, "o_custkey", "left").join(per, "o_orderkey", "left")
    codes = F.array_compact(F.array(F.when(F.col("n").isNull(), "NO_ITEMS"), F.when(F.col("buyer").isNull(), "BUYER_UNKNOWN"), F.when(F.col("unknown") > 0, "SUPPLIER_UNKNOWN"), F.when(F.abs(F.col("goods") - F.col("total")) > 5, "SUM_MISMATCH")))
    return x.withColumn("c", codes).select("o_orderkey", F.array_join("c", ",").alias("codes"), (~F.arrays_overlap("c", F.array(F.lit("NO_ITEMS"), F.lit("BUYER_UNKNOWN")))).alias("ready"))


def _confirm(s, d):
    """Rows whose quantity times unit price is the printed amount (0.5 % and a cent); where it isn't, a whole quotient gives the quantity."""
    x = items(s, d).withColumn("q", F.col("l_quantity").cast("long"))
    x = x.withColumn("price", F.expr("cents div q")).withColumn("printed", F.when(F.col("ord") % 4 == 0, F.col("q") + 1).otherwise(F.col("q")))
    fits = F.abs(F.col("printed") * F.col("price") - F.col("cents")) * 1000 <= F.col("cents") * 5 + 1000
    derived = F.when(F.col("cents") % F.col("price") == 0, F.expr("cents div price"))
    return x.select("l_orderkey", "ord", F.when(fits, F.col("printed")).otherwise(derived).alias("quantity"), F.when(fits, "PRINTED").when(derived.isNotNull(), "DERIVED").otherwise("REJECTED").alias("verdict"))


def _xml(s, d):
    x = items(s, d).select("l_orderkey", "ord", F.to_xml(F.struct(F.col("ord").alias("sequence"), F.col("l_partkey").alias("code"), (F.col("cents") / 100).cast("decimal(18,2)").alias("amount")), {"rowTag": "item"}).alias("xml"))
    return x.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "xml"))), lambda r: r["xml"]), "\n").alias("items"))


_AT = "e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_ FROM events WHERE event_type = 'error')"
QUERIES = {
    "alloc_ceiling_fixpoint": (_ceilings, f"""WITH {_TOTAL}, k AS (SELECT * EXCLUDE (total), total // 2 AS total, CASE WHEN l_linestatus = 'F' THEN cents // 3 ELSE cents * 2 END::BIGINT AS cap FROM j),
p AS (SELECT *, (sum(cents) OVER g - coalesce(sum(cents) OVER b, 0))::HUGEINT AS bl, (total - coalesce(sum(cap) OVER b, 0))::HUGEINT AS tl FROM k WINDOW g AS (PARTITION BY l_orderkey), b AS (PARTITION BY l_orderkey ORDER BY cap::DOUBLE / cents, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * bl < cents * tl AS capped FROM p), r AS (SELECT *, CASE WHEN capped THEN 0 ELSE cents END AS open_, greatest(0, total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (PARTITION BY l_orderkey), 0))::BIGINT AS rest_total FROM f), {_lr_sql('r', 'open_', 'rest_total', 's')}
SELECT l_orderkey, ord, total, cap, CASE WHEN sum(cap) OVER (PARTITION BY l_orderkey) < total THEN NULL WHEN capped THEN cap ELSE s_share END AS share FROM s"""),
    "basis_with_group_density": (_density, f"""WITH {ITEMS_SQL}, x AS (SELECT *, CASE WHEN l_tax > 0.02 THEN l_quantity::BIGINT * 500 END AS stated FROM items),
y AS (SELECT *, sum(stated) OVER u AS ue, sum(CASE WHEN stated IS NOT NULL THEN cents END) OVER u AS uf, sum(stated) OVER j AS je, sum(CASE WHEN stated IS NOT NULL THEN cents END) OVER j AS jf FROM x WINDOW u AS (PARTITION BY l_orderkey, l_returnflag), j AS (PARTITION BY l_orderkey))
SELECT l_orderkey, ord, coalesce(stated, greatest(1, CASE WHEN uf > 0 THEN (2 * cents::HUGEINT * ue + uf) // (2 * uf) WHEN jf > 0 THEN (2 * cents::HUGEINT * je + jf) // (2 * jf) ELSE 1 END))::BIGINT AS basis, stated IS NULL AS estimated FROM y"""),
    "freight_select_max_comparable": (_freight, """WITH x AS (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, c_nationkey % 3 AS own FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT o_orderkey, own, cents // 50 AS amount, 'WAYBILL' AS source, o_orderkey % 3 AS currency FROM x UNION ALL SELECT o_orderkey, own, cents // 40, 'BANK', o_custkey % 3 FROM x UNION ALL SELECT o_orderkey, own, 150000, 'INVOICE', NULL FROM x)
SELECT o_orderkey, max(amount) FILTER (WHERE currency IS NULL OR currency = own) AS freight, arg_max(source, {'a': amount, 's': source}) FILTER (WHERE currency IS NULL OR currency = own) AS source, count(*) FILTER (WHERE currency <> own)::INTEGER AS n_foreign FROM c GROUP BY o_orderkey"""),
    "subset_sum_totals_gate": (_subset, f"""WITH {_TOTAL}, g AS (SELECT l_orderkey, total, list_sort(list(DISTINCT cents)) AS t FROM j GROUP BY ALL), m AS (SELECT *, t[1:8] AS few, unnest(range(1, 1 << least(8, len(t)))) AS mask FROM g),
v AS (SELECT l_orderkey, total, t, list_sum(list_transform(range(1, len(few) + 1), lambda i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN few[i] ELSE 0 END)) AS y FROM m UNION ALL SELECT l_orderkey, total, t, unnest(t) FROM g)
SELECT l_orderkey, len(t)::INTEGER AS n_totals, bool_or(abs(y - total) * 100 <= greatest(total * 2, 500)) AS matched FROM v GROUP BY l_orderkey, t"""),
    "supplementary_unit": (_supplementary, f"""WITH {ITEMS_SQL}, x AS (SELECT l_orderkey, ord, cents, l_quantity::BIGINT AS q, ['KGM', 'UNT', 'PR', 'DZN', 'SQM'][p_size % 5 + 1] AS unit FROM items JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, ord, unit, CASE unit WHEN 'KGM' THEN cents * 7 WHEN 'PR' THEN q * 5000 WHEN 'DZN' THEN (q * 10000 + 6) // 12 WHEN 'SQM' THEN q * 15240 ELSE q * 10000 END AS amount FROM x"""),
    "serial_column_detect": (_serial, f"WITH {ITEMS_SQL}, x AS (SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY ord) AS step FROM items) SELECT l_orderkey, count(*) AS n, count(*) >= 3 AND coalesce(bool_and(step = 1), false) AS serial FROM x GROUP BY 1"),
    "band_anti_join": (_band, """WITH x AS (SELECT conv_id, turn, role, string_split(lower(text), ' ') AS ws FROM conversations WHERE text IS NOT NULL), a AS (SELECT DISTINCT conv_id, turn, role, ws[1] AS word FROM x)
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.conv_id = a.conv_id AND abs(x.turn - a.turn) = 1 AND list_contains(x.ws, a.word))"""),
    "value_grounding_anti": (_grounding, "WITH s AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents), q AS (SELECT DISTINCT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark) SELECT item_id, count(*) AS ungrounded FROM q WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.word = q.word) GROUP BY 1"),
    "cost_with_unknowns": (_unknown_costs, "SELECT user_id, date_trunc('month', ts)::DATE AS month, sum(CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END)::BIGINT AS known_cents, count(*) FILTER (WHERE event_type = 'error') AS unknown FROM events GROUP BY 1, 2"),
    "limiter_dual": (_dual, f"""WITH {_AT}, w AS (SELECT *, count(*) OVER f AS n_day, min(at_) OVER f AS o_day, count(*) OVER g AS n_week, min(at_) OVER g AS o_week FROM e WINDOW f AS (PARTITION BY user_id ORDER BY at_ RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW), g AS (PARTITION BY user_id ORDER BY at_ RANGE BETWEEN 604799 PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, n_day, n_week, greatest(CASE WHEN n_day >= 3 THEN greatest(1, 86400 - (at_ - o_day)) END, CASE WHEN n_week >= 10 THEN greatest(1, 604800 - (at_ - o_week)) END) AS retry_after FROM w"""),
    "authority_ladder": (_authority, f"WITH {ITEMS_SQL}, x AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS rung FROM items) SELECT l_orderkey, rung, ord::INTEGER AS ord, cents FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rung, cents DESC, ord) AS r FROM x) WHERE r = 1"),
    "waybill_score": (_waybill, """WITH x AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 40 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 30 ELSE 0 END + CASE WHEN o_totalprice > 200000 THEN 20 ELSE 0 END AS score FROM orders),
y AS (SELECT *, lead(score) OVER w AS next, row_number() OVER w AS place FROM x WINDOW w AS (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey)) SELECT o_custkey, o_orderkey, score, next IS NULL OR score - next >= 30 AS taken FROM y WHERE place = 1"""),
    "match_greedy_similarity": (_similar, GREEDY_SQL),
    "declaration_gates": (_declaration, f"""WITH {ITEMS_SQL}, p AS (SELECT l_orderkey AS o_orderkey, sum(cents) AS goods, count(*) FILTER (WHERE s_suppkey IS NULL) AS unknown FROM items LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) ON l_suppkey = s_suppkey GROUP BY 1),
x AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS total, goods, unknown, c_custkey AS buyer FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey LEFT JOIN p USING (o_orderkey))
SELECT o_orderkey, concat_ws(',', CASE WHEN goods IS NULL THEN 'NO_ITEMS' END, CASE WHEN buyer IS NULL THEN 'BUYER_UNKNOWN' END, CASE WHEN unknown > 0 THEN 'SUPPLIER_UNKNOWN' END, CASE WHEN abs(goods - total) > 5 THEN 'SUM_MISMATCH' END) AS codes, goods IS NOT NULL AND buyer IS NOT NULL AS ready FROM x"""),
    "invoice_row_confirm": (_confirm, f"""WITH {ITEMS_SQL}, x AS (SELECT *, l_quantity::BIGINT AS q FROM items), y AS (SELECT *, cents // q AS price, CASE WHEN ord % 4 = 0 THEN q + 1 ELSE q END AS printed FROM x), z AS (SELECT *, abs(printed * price - cents) * 1000 <= cents * 5 + 1000 AS fits FROM y)
SELECT l_orderkey, ord, CASE WHEN fits THEN printed WHEN cents % price = 0 THEN cents // price END AS quantity, CASE WHEN fits THEN 'PRINTED' WHEN cents % price = 0 THEN 'DERIVED' ELSE 'REJECTED' END AS verdict FROM z"""),
    "xml_struct": (_xml, f"""WITH {ITEMS_SQL} SELECT l_orderkey, string_agg('<item>' || chr(10) || '    <sequence>' || ord || '</sequence>' || chr(10) || '    <code>' || l_partkey || '</code>' || chr(10) || '    <amount>' || (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') || '</amount>' || chr(10) || '</item>', chr(10) ORDER BY ord) AS items FROM items GROUP BY 1"""),
}
