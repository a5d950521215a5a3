"""Queries of lookups, ladders and ordered joins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.cells import name_key, tokens
from ..operators.relational import as_of, best_row, first_of, islands
from ..sources.tables import ITEMS_SQL, items, read


def _tariff(s, d):
    """part as tariff: code (11 digits), description."""
    return read(s, d, "part").select(F.lpad((F.col("p_partkey") * 7919).cast("string"), 11, "0").alias("code"), F.concat_ws(" ", "p_name", "p_type").alias("description"), "p_partkey")


_TARIFF = "tariff AS (SELECT lpad((p_partkey * 7919)::VARCHAR, 11, '0') AS code, concat_ws(' ', p_name, p_type) AS description, p_partkey FROM part)"


def _prefix(s, d):
    """The most specific level (8, 6, then 4 digits) at which a printed code's prefix is known, and how many codes it has."""
    t = _tariff(s, d)
    asked = read(s, d, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 7919 + 13).cast("string"), 11, "0").alias("raw"))
    found = None
    for level in (8, 6, 4):
        hits = t.groupBy(F.substring("code", 1, level).alias("p")).agg(F.count("*").alias("n"), F.min("code").alias("first"))
        part = asked.join(hits, F.substring("raw", 1, level) == F.col("p")).select("p_partkey", F.lit(level).alias("level"), "n", "first")
        found = part if found is None else found.unionByName(part)
    return best_row(found, ["p_partkey"], [F.desc("level")])


def _idf(s, d):
    """Each part name's best tariff by the summed inverse frequency of shared tokens (the lowest code at a tie)."""
    words = _tariff(s, d).select("code", F.explode(tokens(F.col("description"))).alias("w"))
    n = _tariff(s, d).agg(F.count("*").alias("n_all"))
    # one row: the number of codes
    weight = words.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("w", "df", F.expr("cast(round(1000 * ln(n_all / df)) as bigint)").alias("idf"))
    names = read(s, d, "part").select("p_name").distinct().select("p_name", F.explode(tokens(F.col("p_name"))).alias("w"))
    scored = names.join(weight, "w").join(words, "w").groupBy("p_name", "code").agg(F.sum("idf").alias("score"))
    return best_row(scored, ["p_name"], [F.desc("score"), F.col("code")])


def _country(s, d):
    n = read(s, d, "nation").select("n_nationkey", "n_name")
    x = items(s, d).join(read(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey", "left")
    x = x.join(read(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", "left").join(read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    key, source = first_of(ITEM=F.when(F.col("l_returnflag") == "R", F.col("l_partkey") % 25), SUPPLIER=F.when(F.col("l_linestatus") == "F", F.col("s_nationkey")), BUYER=F.col("c_nationkey"))
    return x.select("l_orderkey", "ord", key.cast("int").alias("n_nationkey"), source.alias("source")).join(F.broadcast(n), "n_nationkey", "left").select("l_orderkey", "ord", "n_name", "source")


def _asof(s, d):
    e = read(s, d, "events")
    starts = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("section"))
    return as_of(e.where("event_type != 'signup'").select("event_id", "user_id", "ts"), starts, "user_id", "ts", "section").select("event_id", "user_id", "section")


def _islands(s, d):
    x = islands(items(s, d), ["l_orderkey"], ["ord"], "l_returnflag")
    return x.groupBy("l_orderkey", "island").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.min("l_returnflag").alias("flag"), F.count("*").alias("n"))


def _code_match(s, d):
    """Packing rows (parts named with other case and spacing) matched to invoice rows by exact key, else by unique code."""
    inv = items(s, d).join(read(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    pack = read(s, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.lit("?")).otherwise(F.lower("p_name")).alias("printed"), "p_partkey")
    keyed = pack.select("p_partkey", name_key(F.col("printed")).alias("k"))
    exact = inv.select("l_orderkey", "ord", "l_partkey", name_key(F.col("p_name")).alias("k")).join(keyed.groupBy("k").agg(F.min("p_partkey").alias("by_name")), "k", "left")
    code = keyed.select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("by_code"))
    value, rung = first_of(NAME=F.col("by_name"), CODE=F.col("by_code"))
    return exact.join(code, "l_partkey", "left").select("l_orderkey", "ord", value.alias("packing_row"), rung.alias("rung"))


def _unmatched(s, d):
    o = read(s, d, "orders")
    return o.join(read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


def _semi_or(s, d):
    some = read(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).union(read(s, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))).distinct()
    return read(s, d, "orders").join(some, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


def _carry(s, d):
    c = read(s, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    header = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return c.select("conv_id", "turn", "role", header.alias("header_turn"))


def _majority(s, d):
    x = read(s, d, "orders").join(read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    n = x.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))
    n = n.withColumn("n_all", F.sum("n").over(Window.partitionBy("c_mktsegment")))
    return best_row(n, ["c_mktsegment"], [F.desc("n"), F.col("o_orderpriority")]).select("c_mktsegment", "o_orderpriority", "n", (F.col("n") * 100 >= F.col("n_all") * 80).alias("agreed"))


_TOK = "list_filter(list_sort(list_distinct(string_split(trim(regexp_replace(regexp_replace(upper({}), '[^A-Z0-9]', ' ', 'g'), ' +', ' ', 'g')), ' '))), lambda x: length(x) >= 3)"
QUERIES = {
    "hs_prefix_complete": (_prefix, f"""WITH {_TARIFF}, q AS (SELECT p_partkey, lpad((p_partkey * 7919 + 13)::VARCHAR, 11, '0') AS raw FROM part), lv(level) AS (VALUES (8), (6), (4)),
h AS (SELECT level, substr(code, 1, level) AS p, count(*) AS n, min(code) AS first FROM tariff, lv GROUP BY ALL), m AS (SELECT q.p_partkey, h.level, n, first, row_number() OVER (PARTITION BY q.p_partkey ORDER BY h.level DESC) AS r FROM q JOIN h ON substr(raw, 1, h.level) = p)
SELECT p_partkey, level, n, first FROM m WHERE r = 1"""),
    "hs_idf_best_match": (_idf, f"""WITH {_TARIFF}, words AS (SELECT code, unnest({_TOK.format('description')}) AS w FROM tariff), weight AS (SELECT w, CAST(round(1000 * ln((SELECT count(*) FROM tariff) / count(*))) AS BIGINT) AS idf FROM words GROUP BY w),
names AS (SELECT p_name, unnest({_TOK.format('p_name')}) AS w FROM (SELECT DISTINCT p_name FROM part)), sc AS (SELECT p_name, code, sum(idf)::BIGINT AS score FROM names JOIN weight USING (w) JOIN words USING (w) GROUP BY ALL)
SELECT p_name, code, score FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, code) AS r FROM sc) WHERE r = 1"""),
    "country_cascade": (_country, f"""WITH {ITEMS_SQL}, x AS (SELECT l_orderkey, ord, CASE WHEN l_returnflag = 'R' THEN l_partkey % 25 WHEN l_linestatus = 'F' AND s_nationkey IS NOT NULL THEN s_nationkey ELSE c_nationkey END AS k, CASE WHEN l_returnflag = 'R' THEN 'ITEM' WHEN l_linestatus = 'F' AND s_nationkey IS NOT NULL THEN 'SUPPLIER' WHEN c_nationkey IS NOT NULL THEN 'BUYER' END AS source
FROM items LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey) SELECT l_orderkey, ord, n_name, source FROM x LEFT JOIN nation ON k = n_nationkey"""),
    "asof_row_to_section": (_asof, """WITH s AS (SELECT user_id, ts, max(event_id) AS section FROM events WHERE event_type = 'signup' GROUP BY ALL), f AS (SELECT user_id, arg_min(section, ts) AS first FROM s GROUP BY 1)
SELECT e.event_id, e.user_id, coalesce(s.section, f.first) AS section FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts LEFT JOIN f ON e.user_id = f.user_id WHERE e.event_type <> 'signup'"""),
    "carton_islands": (_islands, f"""WITH {ITEMS_SQL}, n AS (SELECT *, CASE WHEN lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY ord) IS NOT DISTINCT FROM l_returnflag THEN 0 ELSE 1 END AS new_ FROM items), i AS (SELECT *, sum(new_) OVER (PARTITION BY l_orderkey ORDER BY ord)::BIGINT AS island FROM n)
SELECT l_orderkey, island, min(ord) AS first, max(ord) AS last, min(l_returnflag) AS flag, count(*) AS n FROM i GROUP BY l_orderkey, island"""),
    "match_ladder_exact_code": (_code_match, f"""WITH {ITEMS_SQL}, k AS (SELECT upper(p_name) AS k, min(p_partkey) AS by_name FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1)
SELECT l_orderkey, ord, coalesce(by_name, p.p_partkey) AS packing_row, CASE WHEN by_name IS NOT NULL THEN 'NAME' WHEN p.p_partkey IS NOT NULL THEN 'CODE' END AS rung FROM items JOIN part p ON l_partkey = p.p_partkey LEFT JOIN k ON upper(p.p_name) = k.k"""),
    "orders_without_items": (_unmatched, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "semi_exists_or": (_semi_or, "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)"),
    "header_carry_forward": (_carry, "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header_turn FROM conversations"),
    "profile_majority_80": (_majority, """WITH n AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY c_mktsegment) AS a, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, o_orderpriority) AS k FROM n)
SELECT c_mktsegment, o_orderpriority, n, n * 100 >= a * 80 AS agreed FROM r WHERE k = 1"""),
}
