"""Queries of weights, cartons and charges: jobs are orders, items are lineitems, packing rows are items by flag, grams and cents are whole."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import cells as c
from ..operators import apportion as a
from ..operators.relational import best_row, first_of
from ..sources.tables import ITEMS_SQL, items, read


def job():
    return Window.partitionBy("l_orderkey")


def _gross_basis(s, d):
    """What gross weight is split by: packing gross, else cartons, else value (packing names all items), else quantity."""
    x = items(s, d).withColumn("gross", F.when(F.col("l_tax") > 0.05, F.col("l_quantity").cast("long") * 400)).withColumn("cartons", F.when(F.col("l_discount") > 0.04, F.col("ord")))
    packed = F.col("l_returnflag") != "N"
    any_of = lambda v: F.max(v.isNotNull()).over(job())
    complete = F.min(packed).over(job())
    kind = F.when(any_of(F.col("gross")), "PACKING_GROSS").when(any_of(F.col("cartons")), "CARTONS").when(complete, "VALUE").otherwise("QUANTITY")
    x = x.withColumn("kind", kind)
    basis = F.when(F.col("kind") == "PACKING_GROSS", F.coalesce("gross", F.lit(0))).when(F.col("kind") == "CARTONS", F.coalesce("cartons", F.lit(0))).when(F.col("kind") == "VALUE", F.col("cents")).otherwise(F.col("l_quantity").cast("long"))
    return x.select("l_orderkey", "ord", "kind", basis.cast("long").alias("basis"))


def _packing_split(s, d):
    """Each item's share of its packing group's weight, in millionths: by quantity, where there is none by value, else equal."""
    x = items(s, d).withColumn("q", F.when(F.col("l_returnflag") == "A", 0).otherwise(F.col("l_quantity").cast("long"))).withColumn("v", F.when(F.col("l_linestatus") == "F", 0).otherwise(F.col("cents")))
    w = Window.partitionBy("l_orderkey", "l_returnflag", "l_linestatus")
    by = F.when(F.sum("q").over(w) > 0, "QUANTITY").when(F.sum("v").over(w) > 0, "VALUE").otherwise("EQUAL")
    x = x.withColumn("split_by", by).withColumn("b", F.when(F.col("split_by") == "QUANTITY", F.col("q")).when(F.col("split_by") == "VALUE", F.col("v")).otherwise(1))
    return x.withColumn("all", F.sum("b").over(w)).select("l_orderkey", "ord", "split_by", F.expr("1000000 * b div all").cast("long").alias("share"))


def _packing_groups(s, d):
    """Packing rows of one name: sums, codes, and the name as first printed."""
    x = items(s, d).join(read(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")
    printed = F.when(F.col("ord") % 2 == 0, F.upper("p_name")).otherwise(F.concat_ws("-", F.split("p_name", " ")))
    g = x.withColumn("printed", printed).groupBy("l_orderkey", c.item_key(F.col("printed")).alias("key"))
    return g.agg(F.sum(F.col("l_quantity").cast("long")).alias("gross"), F.sum("cents").alias("net"), F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",").alias("codes"), F.min_by("printed", "ord").alias("name"))


def _weight_column(s, d):
    """What an unnamed weight column of a packing list holds: the type all rows state, else the printed total (net first) that its sum is within 2 % of, else by shape."""
    x = items(s, d).withColumn("stated", F.when(F.col("l_returnflag") == "R", "GROSS").when(F.col("l_returnflag") == "A", "NET"))
    g = x.groupBy("l_orderkey").agg(F.sum("cents").alias("declared"), F.min("stated").alias("lo"), F.max("stated").alias("hi"), F.count_if(F.col("stated").isNull()).alias("unstated"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    total = read(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long").alias("printed"))
    g = g.join(total, "l_orderkey").withColumn("net", F.when(F.col("l_orderkey") % 3 == 0, F.expr("declared + declared div 60")).otherwise(F.expr("printed div 2"))).withColumn("gross", F.when(F.col("l_orderkey") % 3 == 1, F.col("declared") + 4).otherwise(F.col("printed")))
    near = lambda v: F.abs(F.col("declared") - F.col(v)) * 100 <= F.greatest(F.col(v) * 2, F.lit(500))
    kind = F.when((F.col("unstated") == 0) & (F.col("lo") == F.col("hi")), F.col("lo")).when(near("net"), "NET").when(near("gross"), "GROSS").otherwise("SHAPE")
    return g.select("l_orderkey", kind.alias("kind"))


def _rejection(s, d):
    """Net weights read from descriptions that go, worst first, until the floors of an order fit its gross weight; the others stay."""
    x = items(s, d).withColumn("net", F.col("l_quantity").cast("long") * 100).withColumn("guess", F.col("l_returnflag") == "R")
    x = x.withColumn("room", F.sum(F.col("l_quantity").cast("long")).over(job()) * 60)
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("guess"), F.desc("net"), "ord")
    before = F.coalesce(F.sum(F.when(F.col("guess"), F.col("net"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the floors that are left when all guesses before this one have gone
    left = F.sum("net").over(job()) - before
    return x.select("l_orderkey", "ord", "net", (F.col("guess") & (left > F.col("room"))).alias("rejected"))


def _pinned(s, d):
    """Gross weight with pinned items exact and the rest split over the others by floors; null where pins and floors don't fit."""
    total = read(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.round(F.col("o_totalprice")).cast("long").alias("authority"))
    x = items(s, d).join(total, "l_orderkey").withColumn("pin", F.when(F.col("l_linenumber") == 1, F.expr("authority div 9")))
    x = x.withColumn("floor", F.when(F.col("pin").isNull(), F.col("l_quantity").cast("long") + 1).otherwise(0)).withColumn("rest", F.col("authority") - F.coalesce(F.sum("pin").over(job()), F.lit(0)))
    free = a.with_floors(x.where("pin is null"), ["l_orderkey"], ["ord"], "cents", "rest", "floor", "share").select("l_orderkey", "ord", "share")
    return x.join(free, ["l_orderkey", "ord"], "left").select("l_orderkey", "ord", "pin", "floor", F.coalesce("pin", "share").alias("gross"))


def _shared_cartons(s, d):
    """Cartons of rows that share an identifier: differing counts add up; equal ones are the range's size if it is one, else stand once."""
    x = items(s, d).withColumn("n", F.when(F.col("l_linestatus") == "F", F.lit(3)).otherwise(F.col("l_quantity").cast("long") % 5 + 1).cast("long"))
    x = x.withColumn("carton", F.when(F.col("l_returnflag") == "R", F.concat(F.lit("C/NO 1-"), (F.col("l_orderkey") % 7 + 1).cast("string"))).otherwise(F.concat(F.lit("X"), F.col("l_returnflag"), F.lit("-9"))))
    g = x.groupBy("l_orderkey", "carton").agg(F.sum("n").alias("all"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    covered = F.when(F.col("carton").rlike(r"\d+\s*-\s*\d+$") & (c.range_count(F.col("carton")) > 1), c.range_count(F.col("carton")))
    return g.select("l_orderkey", "carton", F.when(F.col("lo") != F.col("hi"), F.col("all")).otherwise(F.coalesce(covered, "lo")).alias("cartons"))


def _lattice(s, d):
    """Cartons in hundredths: at least one each, whole hundredths, the order's sum as printed. BELOW, OFF_LATTICE, SUM or OK."""
    x = items(s, d).withColumn("thousandths", F.when(F.col("ord") % 9 == 0, F.col("cents") % 10).otherwise(F.expr("cents div 10 * 10")))
    g = x.groupBy("l_orderkey").agg(F.min("thousandths").alias("least"), F.max(F.col("thousandths") % 10).alias("off"), F.sum("thousandths").alias("cartons"), F.sum(F.expr("cents div 10 * 10")).alias("printed"))
    code = F.when(F.col("least") < 10, "BELOW").when(F.col("off") != 0, "OFF_LATTICE").when((F.col("cartons") != F.col("printed")) | (F.col("l_orderkey") % 8 == 0), "SUM").otherwise("OK")
    return g.select("l_orderkey", "cartons", code.alias("code"))


def _feasible(s, d):
    """Whether net weights can stand in a gross weight: one over it, a sum over 95 % of it, and the three largest contributors."""
    total = read(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long").alias("gross"))
    x = items(s, d).join(total, "l_orderkey")
    g = x.groupBy("l_orderkey", "gross").agg(F.sum("cents").alias("net"), F.max("cents").alias("most"), F.slice(F.sort_array(F.collect_list(F.struct("cents", (-F.col("ord")).alias("o"))), False), 1, 3).alias("t"))
    code = F.when(F.col("most") > F.col("gross"), "ITEM_OVER_SHIPMENT").when(F.col("net") * 100 > F.col("gross") * 95, "SUM_OVER").otherwise("OK")
    return g.select("l_orderkey", code.alias("code"), F.array_join(F.transform("t", lambda r: (-r["o"]).cast("string")), ",").alias("top"))


def _disagree(s, d):
    """Items of which some other reading of the weight is ten times off the one that is taken."""
    x = items(s, d).join(read(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    q = F.col("l_quantity").cast("long")
    readings = {"INVOICE": F.when(F.col("l_tax") > 0.04, q * 1000), "PACKING": F.when(F.col("l_discount") > 0.05, q * 150), "DESCRIPTION": q * F.col("p_size") * 20}
    value, source = first_of(**readings)
    far = F.exists(F.array_compact(F.array(*readings.values())), lambda y: (y > F.col("taken") * 10) | (y * 10 < F.col("taken")))
    return x.withColumn("taken", value).withColumn("source", source).select("l_orderkey", "ord", "taken", "source", far.alias("disagrees"))


def _implausible(s, d):
    """Items whose implied unit weight is 10 times the median of their unit, or a tenth of it, where two or more state one."""
    x = items(s, d).withColumn("unit", F.expr("cents div greatest(1, cast(l_quantity * l_linenumber * l_linenumber as bigint))"))
    middle = x.groupBy("l_orderkey", "l_returnflag").agg(F.expr("percentile(unit, 0.5)").alias("middle"), F.count("*").alias("n"))
    flag = (F.col("n") >= 2) & ((F.col("unit") >= 10 * F.col("middle")) | (F.col("unit") * 10 <= F.col("middle")))
    return x.join(middle, ["l_orderkey", "l_returnflag"]).select("l_orderkey", "ord", "unit", "middle", flag.alias("implausible"))


def _awb_charges(s, d):
    """A waybill's charges: prepaid, else collect, else its parts (with a weight charge), else what is printed; a mismatch with the parts is told."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    k = F.col("o_orderkey") % 6
    x = read(s, d, "orders").select("o_orderkey", F.when(k == 0, cents).alias("prepaid"), F.when(k == 1, cents).when(k == 2, 0).alias("collect"), F.when(k < 4, F.expr("cast(round(o_totalprice * 100) as bigint) * 9 div 10")).alias("weight"), F.when(k == 3, cents - F.expr("cast(round(o_totalprice * 100) as bigint) * 9 div 10")).otherwise(0).alias("other"), F.when(k == 4, cents).alias("printed"))
    parts = F.when(F.col("weight") > 0, F.col("weight") + F.coalesce("other", F.lit(0)))
    value, source = first_of(PREPAID=F.when(F.col("prepaid") > 0, F.col("prepaid")), COLLECT=F.when(F.col("collect") > 0, F.col("collect")), PARTS=parts, PRINTED=F.when(F.col("printed") > 0, F.col("printed")))
    return x.select("o_orderkey", value.cast("long").alias("charge"), source.alias("source"), F.coalesce(source.isin("PREPAID", "COLLECT") & (F.abs(parts - value) > 5), F.lit(False)).alias("mismatch"))


def _target(s, d):
    """What an invoice's goods should add up to: the grand total less freight, insurance and other charges, with the discount put back."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    k = F.col("o_orderkey")
    made = {"freight": F.when(k % 3 == 0, F.expr("cast(round(o_totalprice * 100) as bigint) div 20")), "insurance": F.when(k % 4 == 0, 1500), "other": F.when(k % 5 == 0, 250), "discount": F.when(k % 7 == 0, -900).when(k % 11 == 0, 700)}
    x = read(s, d, "orders").select("o_orderkey", cents.alias("grand"), *(v.cast("long").alias(n) for n, v in made.items()))
    z = lambda n: F.coalesce(n, F.lit(0))
    return x.select("o_orderkey", "grand", (F.col("grand") - z("freight") - z("insurance") - z("other") + F.abs(z("discount"))).alias("target"))


def _all_or_nothing(s, d):
    """A total over chunks only where each of them gives one."""
    x = items(s, d).withColumn("part", F.when(F.col("l_tax") > 0.01, F.col("cents")))
    return x.groupBy("l_orderkey").agg(F.when(F.count("part") == F.count("*"), F.sum("part")).alias("total"), F.count("*").alias("chunks"))


def _rescored(s, d):
    """Forms of a job scored anew by comparison: 20 more for the lowest and for the highest gross weight, where they differ."""
    x = items(s, d).withColumn("score", F.when(F.col("l_returnflag") == "R", 60).when(F.col("l_returnflag") == "A", 40).otherwise(0))
    lo, hi = F.min(F.struct("cents", "ord")).over(job()), F.max(F.struct(F.col("cents"), (-F.col("ord")).alias("o"))).over(job())
    x = x.withColumn("lo", lo).withColumn("hi", hi)
    differ = F.col("lo.cents") < F.col("hi.cents")
    more = F.when(differ & (F.col("ord") == F.col("lo.ord")), 20).when(differ & (F.col("ord") == -F.col("hi.o")), 20).otherwise(0)
    return x.select("l_orderkey", "ord", (F.col("score") + more).cast("int").alias("score"))


RATES = [("view", None, None, None, 2000), ("click", 3_000_000, 300_000, 9_000_000, None), ("purchase", 5_000_000, None, 15_000_000, None), ("signup", None, None, 8_000_000, None)]


def _cost(s, d):
    """Estimated cost of a call in billionths: pages and tokens at their model's rates; cached tokens are a part of the prompt's. Null if nothing is priced."""
    rates = s.createDataFrame(RATES, "event_type string, per_in long, per_cached long, per_out long, per_page long")
    n = F.get_json_object("props", "$.k").cast("long")
    x = read(s, d, "events").select("event_id", "event_type", n.alias("prompt"), F.expr("event_id % 17 * 3").cast("long").alias("cached"), (F.col("event_id") % 5).cast("long").alias("completion"), F.when(F.col("event_type") == "view", 1).otherwise(0).cast("long").alias("pages"))
    x = x.join(F.broadcast(rates), "event_type", "left").withColumn("cached", F.least("cached", "prompt"))
    page = F.when((F.col("pages") > 0) & F.col("per_page").isNotNull(), F.col("pages") * F.col("per_page") * 1000)
    asked = F.when((F.col("prompt") > 0) & F.col("per_in").isNotNull(), ((F.col("prompt") - F.col("cached")) * F.col("per_in") + F.col("cached") * F.coalesce("per_cached", "per_in")) / 1000)
    answered = F.when((F.col("completion") > 0) & F.col("per_out").isNotNull(), F.col("completion") * F.col("per_out") / 1000)
    some = F.coalesce(page, asked, answered).isNotNull()
    return x.select("event_id", F.when(some, sum((F.coalesce(p, F.lit(0)) for p in (page, asked, answered)), F.lit(0)).cast("long")).alias("cost"))


def _last_totals(s, d):
    """A packing list's totals: of each field the last page that prints it."""
    x = items(s, d).withColumn("gross", F.when(F.col("l_returnflag") == "R", F.col("cents"))).withColumn("packages", F.when(F.col("l_linestatus") == "F", F.col("ord")))
    last = lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), F.col("ord"))).alias(v)
    return x.groupBy("l_orderkey").agg(last("gross"), last("packages"))


_FLOOR = """fl AS (SELECT *, sum(cents) OVER g AS w_, sum(floor) OVER g AS f_ FROM k WHERE pin IS NULL WINDOW g AS (PARTITION BY l_orderkey)),
p AS (SELECT *, (rest::HUGEINT * cents) // w_ AS d1, (rest::HUGEINT * cents) % w_ AS r1, (greatest(rest - f_, 0)::HUGEINT * cents) // w_ AS d2, (greatest(rest - f_, 0)::HUGEINT * cents) % w_ AS r2 FROM fl),
q AS (SELECT *, d1 + CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY r1 DESC, ord) <= rest - sum(d1) OVER (PARTITION BY l_orderkey) THEN 1 ELSE 0 END AS s1, floor + d2 + CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY r2 DESC, ord) <= greatest(rest - f_, 0) - sum(d2) OVER (PARTITION BY l_orderkey) THEN 1 ELSE 0 END AS s2 FROM p),
z AS (SELECT l_orderkey, ord, CASE WHEN f_ > rest THEN NULL WHEN min(CASE WHEN s1 >= floor THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) = 1 THEN s1 ELSE s2 END AS share FROM q)"""
_PRICE = "CAST(round(o_totalprice * 100) AS BIGINT)"
QUERIES = {
    "gross_basis_choice": (_gross_basis, f"""WITH {ITEMS_SQL}, x AS (SELECT *, l_quantity::BIGINT AS q, CASE WHEN l_tax > 0.05 THEN l_quantity::BIGINT * 400 END AS gross, CASE WHEN l_discount > 0.04 THEN ord END AS cartons FROM items),
k AS (SELECT *, CASE WHEN count(gross) OVER j > 0 THEN 'PACKING_GROSS' WHEN count(cartons) OVER j > 0 THEN 'CARTONS' WHEN count(*) FILTER (WHERE l_returnflag = 'N') OVER j = 0 THEN 'VALUE' ELSE 'QUANTITY' END AS kind FROM x WINDOW j AS (PARTITION BY l_orderkey))
SELECT l_orderkey, ord, kind, CASE kind WHEN 'PACKING_GROSS' THEN coalesce(gross, 0) WHEN 'CARTONS' THEN coalesce(cartons, 0) WHEN 'VALUE' THEN cents ELSE q END::BIGINT AS basis FROM k"""),
    "packing_split_to_lines": (_packing_split, f"""WITH {ITEMS_SQL}, x AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity::BIGINT END AS q, CASE WHEN l_linestatus = 'F' THEN 0 ELSE cents END AS v FROM items),
y AS (SELECT *, sum(q) OVER g AS aq, sum(v) OVER g AS av, count(*) OVER g AS n FROM x WINDOW g AS (PARTITION BY l_orderkey, l_returnflag, l_linestatus))
SELECT l_orderkey, ord, CASE WHEN aq > 0 THEN 'QUANTITY' WHEN av > 0 THEN 'VALUE' ELSE 'EQUAL' END AS split_by, CASE WHEN aq > 0 THEN 1000000 * q // aq WHEN av > 0 THEN 1000000 * v // av ELSE 1000000 // n END::BIGINT AS share FROM y"""),
    "packing_group_sums": (_packing_groups, f"""WITH {ITEMS_SQL}, x AS (SELECT *, CASE WHEN ord % 2 = 0 THEN upper(p_name) ELSE replace(p_name, ' ', '-') END AS printed FROM items JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, regexp_replace(lower(printed), '[^a-z0-9]+', '', 'g') AS key, sum(l_quantity::BIGINT)::BIGINT AS gross, sum(cents)::BIGINT AS net, array_to_string(list_sort(list(DISTINCT l_partkey::VARCHAR)), ',') AS codes, arg_min(printed, ord) AS name FROM x GROUP BY 1, 2"""),
    "weight_column_class": (_weight_column, f"""WITH {ITEMS_SQL}, g AS (SELECT l_orderkey, sum(cents) AS declared, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'A') AS a FROM items GROUP BY 1),
x AS (SELECT g.*, CASE WHEN l_orderkey % 3 = 0 THEN declared + declared // 60 ELSE {_PRICE} // 2 END AS net, CASE WHEN l_orderkey % 3 = 1 THEN declared + 4 ELSE {_PRICE} END AS gross FROM g JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, CASE WHEN r = n THEN 'GROSS' WHEN a = n THEN 'NET' WHEN abs(declared - net) * 100 <= greatest(net * 2, 500) THEN 'NET' WHEN abs(declared - gross) * 100 <= greatest(gross * 2, 500) THEN 'GROSS' ELSE 'SHAPE' END AS kind FROM x"""),
    "description_rejection": (_rejection, f"""WITH RECURSIVE {ITEMS_SQL}, x AS (SELECT l_orderkey, ord, l_quantity::BIGINT * 100 AS net, l_returnflag = 'R' AS guess FROM items),
j AS (SELECT l_orderkey, sum(net) * 60 // 100 AS room, sum(net) AS floors FROM x GROUP BY 1), o AS (SELECT l_orderkey, ord, net, row_number() OVER (PARTITION BY l_orderkey ORDER BY net DESC, ord) AS k FROM x WHERE guess),
r AS (SELECT l_orderkey, 0::BIGINT AS k, floors, room FROM j UNION ALL SELECT r.l_orderkey, o.k, r.floors - o.net, room FROM r JOIN o ON o.l_orderkey = r.l_orderkey AND o.k = r.k + 1 WHERE r.floors > room),
m AS (SELECT l_orderkey, max(k) AS gone FROM r GROUP BY 1) SELECT x.l_orderkey, x.ord, x.net, coalesce(o.k <= gone, false) AS rejected FROM x JOIN m ON m.l_orderkey = x.l_orderkey LEFT JOIN o ON o.l_orderkey = x.l_orderkey AND o.ord = x.ord"""),
    "gross_with_pins": (_pinned, f"""WITH {ITEMS_SQL}, i AS (SELECT items.*, CAST(round(o_totalprice) AS BIGINT) AS authority FROM items JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT *, CASE WHEN l_linenumber = 1 THEN authority // 9 END AS pin FROM i),
k AS (SELECT *, CASE WHEN pin IS NULL THEN l_quantity::BIGINT + 1 ELSE 0 END AS floor, (authority - coalesce(sum(pin) OVER (PARTITION BY l_orderkey), 0))::BIGINT AS rest FROM n), {_FLOOR}
SELECT k.l_orderkey, k.ord, pin, floor::BIGINT AS floor, coalesce(pin, share)::BIGINT AS gross FROM k LEFT JOIN z ON z.l_orderkey = k.l_orderkey AND z.ord = k.ord"""),
    "shared_carton_total": (_shared_cartons, f"""WITH {ITEMS_SQL}, x AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'F' THEN 3 ELSE l_quantity::BIGINT % 5 + 1 END AS n, CASE WHEN l_returnflag = 'R' THEN 'C/NO 1-' || (l_orderkey % 7 + 1) ELSE 'X' || l_returnflag || '-9' END AS carton, CASE WHEN l_returnflag = 'R' AND l_orderkey % 7 > 0 THEN l_orderkey % 7 + 1 END AS covered FROM items)
SELECT l_orderkey, carton, CASE WHEN min(n) <> max(n) THEN sum(n) ELSE coalesce(any_value(covered), min(n)) END::BIGINT AS cartons FROM x GROUP BY 1, 2"""),
    "carton_lattice": (_lattice, f"""WITH {ITEMS_SQL}, x AS (SELECT l_orderkey, CASE WHEN ord % 9 = 0 THEN cents % 10 ELSE cents // 10 * 10 END AS t, cents // 10 * 10 AS p FROM items)
SELECT l_orderkey, sum(t)::BIGINT AS cartons, CASE WHEN min(t) < 10 THEN 'BELOW' WHEN max(t % 10) <> 0 THEN 'OFF_LATTICE' WHEN sum(t) <> sum(p) OR l_orderkey % 8 = 0 THEN 'SUM' ELSE 'OK' END AS code FROM x GROUP BY 1"""),
    "net_feasibility": (_feasible, f"""WITH {ITEMS_SQL}, x AS (SELECT items.*, {_PRICE} AS gross FROM items JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, CASE WHEN max(cents) > any_value(gross) THEN 'ITEM_OVER_SHIPMENT' WHEN sum(cents) * 100 > any_value(gross) * 95 THEN 'SUM_OVER' ELSE 'OK' END AS code, array_to_string(list(ord ORDER BY cents DESC, ord)[1:3], ',') AS top FROM x GROUP BY 1"""),
    "weight_source_disagreement": (_disagree, f"""WITH {ITEMS_SQL}, x AS (SELECT l_orderkey, ord, CASE WHEN l_tax > 0.04 THEN l_quantity::BIGINT * 1000 END AS i, CASE WHEN l_discount > 0.05 THEN l_quantity::BIGINT * 150 END AS p, l_quantity::BIGINT * p_size * 20 AS d FROM items JOIN part ON l_partkey = p_partkey), y AS (SELECT *, coalesce(i, p, d) AS taken FROM x)
SELECT l_orderkey, ord, taken, CASE WHEN i IS NOT NULL THEN 'INVOICE' WHEN p IS NOT NULL THEN 'PACKING' ELSE 'DESCRIPTION' END AS source, len(list_filter([i, p, d], lambda v: v > taken * 10 OR v * 10 < taken)) > 0 AS disagrees FROM y"""),
    "unit_weight_tenfold": (_implausible, f"""WITH {ITEMS_SQL}, u AS (SELECT *, cents // greatest(1, (l_quantity * l_linenumber * l_linenumber)::BIGINT) AS unit FROM items), m AS (SELECT l_orderkey, l_returnflag, quantile_cont(unit::DOUBLE, 0.5) AS middle, count(*) AS n FROM u GROUP BY ALL)
SELECT l_orderkey, ord, unit, middle, n >= 2 AND (unit >= 10 * middle OR unit * 10 <= middle) AS implausible FROM u JOIN m USING (l_orderkey, l_returnflag)"""),
    "awb_charge_total": (_awb_charges, f"""WITH x AS (SELECT o_orderkey, o_orderkey % 6 AS k, {_PRICE} AS c FROM orders)
SELECT o_orderkey, CASE WHEN k = 5 THEN NULL WHEN k = 2 THEN c * 9 // 10 ELSE c END AS charge, ['PREPAID', 'COLLECT', 'PARTS', 'PARTS', 'PRINTED', NULL][k + 1] AS source, k IN (0, 1) AND c - c * 9 // 10 > 5 AS mismatch FROM x"""),
    "printed_goods_target": (_target, f"""WITH x AS (SELECT o_orderkey, o_orderkey AS k, {_PRICE} AS grand FROM orders) SELECT o_orderkey, grand,
grand - CASE WHEN k % 3 = 0 THEN grand // 20 ELSE 0 END - CASE WHEN k % 4 = 0 THEN 1500 ELSE 0 END - CASE WHEN k % 5 = 0 THEN 250 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 900 WHEN k % 11 = 0 THEN 700 ELSE 0 END AS target FROM x"""),
    "all_or_nothing_sum": (_all_or_nothing, f"WITH {ITEMS_SQL} SELECT l_orderkey, CASE WHEN min(l_tax) > 0.01 THEN sum(cents) END::BIGINT AS total, count(*) AS chunks FROM items GROUP BY 1"),
    "comparative_rescore": (_rescored, f"""WITH {ITEMS_SQL}, x AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 60 WHEN 'A' THEN 40 ELSE 0 END AS score, min(cents) OVER j AS lo, max(cents) OVER j AS hi, row_number() OVER (PARTITION BY l_orderkey ORDER BY cents, ord) AS up, row_number() OVER (PARTITION BY l_orderkey ORDER BY cents DESC, ord) AS down FROM items WINDOW j AS (PARTITION BY l_orderkey))
SELECT l_orderkey, ord, score + CASE WHEN lo < hi AND (up = 1 OR down = 1) THEN 20 ELSE 0 END AS score FROM x"""),
    "cost_estimate": (_cost, """WITH x AS (SELECT event_id, event_type AS m, CAST(json_extract_string(props, '$.k') AS BIGINT) AS p, event_id % 17 * 3 AS c, event_id % 5 AS o FROM events), y AS (SELECT *, least(c, p) AS h FROM x)
SELECT event_id, CASE m WHEN 'view' THEN 2000000 WHEN 'click' THEN CASE WHEN p > 0 OR o > 0 THEN ((p - h) * 3000000 + h * 300000) // 1000 + o * 9000 END WHEN 'purchase' THEN CASE WHEN p > 0 OR o > 0 THEN p * 5000 + o * 15000 END WHEN 'signup' THEN CASE WHEN o > 0 THEN o * 8000 END END::BIGINT AS cost FROM y"""),
    "last_packing_totals": (_last_totals, f"WITH {ITEMS_SQL} SELECT l_orderkey, arg_max(cents, ord) FILTER (WHERE l_returnflag = 'R') AS gross, max(ord) FILTER (WHERE l_linestatus = 'F')::INTEGER AS packages FROM items GROUP BY 1"),
}
