"""Queries of the printed forms and comparable keys of numbers, dates, names and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as c
from ..sources.tables import ITEMS_SQL, items, read


def _numbers(s, d):
    """A price as fixed, grouped and trimmed text, and a seventh of it cut (not rounded) to three places."""
    x = items(s, d)
    price = (F.col("cents").cast("decimal(18,2)") / 100).cast("decimal(18,2)")
    part = (F.col("cents").cast("decimal(18,4)") / 7).cast("decimal(28,10)")
    return x.select("l_orderkey", "ord", c.fixed2(price).alias("fixed"), c.thousands2(price).alias("grouped"), c.trimmed(price).alias("short"), c.trimmed(price, True).alias("short1"), (c.rounded_down(part) * 1000).cast("long").alias("part_mils"))


def _dates(s, d):
    """Order dates printed day first, written in both forms of a declaration; unreadable ones pass as they are."""
    day = F.to_date("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("week of "), F.date_format(day, "dd"))).when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "d-M-yyyy")).otherwise(F.concat_ws(" ", F.date_format(day, "yyyyMMdd"), F.date_format(day, "yyyy MMM dd")))
    return read(s, d, "orders").select("o_orderkey", c.day_month_year(raw, True).alias("named"), c.day_month_year(raw).alias("plain"))


def _keys(s, d):
    """Comparable keys of whole texts: without marks, plain, as identity and as invoice number."""
    text = F.col("text")
    made = {"text_key": c.text_key(text), "item_key": c.item_key(text), "identity_key": c.identity_key(text), "digits": c.digits_only(text)}
    return read(s, d, "documents").select("doc_id", *(F.sha2(v, 256).alias(k) for k, v in made.items()), c.invoice_key(F.concat_ws(" / ", "source", "lang")).alias("invoice_key"), F.size(c.meaningful_tokens(text)).cast("long").alias("n_tokens"))


def _guard(s, d):
    """What a turn's text, and each order's key as a number, would be told as a search."""
    turns = read(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn", "role").alias("id"), F.col("text").alias("q"))
    keys = read(s, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.concat(F.col("o_orderkey") % 20, F.lit(".")).alias("q"))
    return turns.unionByName(keys).select("id", "q", c.query_error(F.col("q")).alias("error"))


def _serials(s, d):
    """Serial numbers named by a printed list of each order, within its number of items; lists beyond it are refused."""
    n = items(s, d).groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    raw = F.when(F.col("l_orderkey") % 5 == 0, "all").otherwise(F.concat(F.lit("1-"), F.greatest(F.lit(1), F.expr("n div 2")).cast("string"), F.lit(", "), (F.col("l_orderkey") % 6 + 1).cast("string")))
    return n.select("l_orderkey", F.array_join(c.numbers_of(raw, F.col("n")).cast("array<string>"), " ").alias("serials"))


def _overrides(s, d):
    """Rates given in events against the default of their kind (its mean, to the cent)."""
    e = read(s, d, "events")
    usual = e.groupBy("event_type").agg(F.expr("cast(round(avg(cast(round(value * 100) as bigint))) as bigint)").alias("usual"))
    given = F.when(F.col("event_id") % 11 == 0, "n/a").when(F.col("event_id") % 13 == 0, F.concat(F.lit("-"), F.round(F.col("value") * 100).cast("long").cast("string"))).otherwise(F.round(F.col("value") * 100).cast("long").cast("string"))
    return e.join(F.broadcast(usual), "event_type").select("event_id", given.alias("given"), "usual", c.override_verdict(given, F.col("usual")).alias("verdict"))


def _votes(s, d):
    """All six votes for a text's number convention."""
    eu, us = c.locale_votes(F.col("text"))
    return read(s, d, "documents").where("text is not null").select("doc_id", eu.cast("long").alias("eu"), us.cast("long").alias("us"), c.numeric_locale(F.col("text")).alias("locale"))


def _described(s, d):
    x = items(s, d).join(read(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    unit = F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag"))
    return x.select("l_orderkey", "ord", c.described(F.col("p_name"), (F.col("l_quantity") / 4).cast("decimal(18,4)"), unit).alias("description"))


def _readings(s, d):
    """Amounts as invoices of several conventions print them, with the page's convention as hint where it is known."""
    x = items(s, d)
    plain = F.format_number((F.col("cents") / 100).cast("decimal(18,2)"), 2)
    european = F.translate(plain, ",.", ".,")
    k = F.col("ord") % 7
    raw = (
        F.when(k == 0, F.concat(F.lit("Rs. "), plain, F.lit(" Dr"))).when(k == 1, F.concat(F.lit("€ "), european, F.lit("00"))).when(k == 2, F.concat(F.lit("("), F.translate(plain, ",", " "), F.lit(")")))
        .when(k == 3, F.concat(F.translate(plain, ",", ""), F.lit("/-"))).when(k == 4, F.translate(plain, ",", ".")).when(k == 5, F.concat(european, F.lit(" "), european)).otherwise(F.concat(F.lit("about "), plain))
    )
    return x.select("l_orderkey", "ord", (c.parse_decimal(raw, F.when(k == 1, "EU")) * 100).cast("long").alias("read_cents"))


def _spellings(s, d):
    """Weights printed in eight spellings of units, in milligrams; an unknown unit is said to be so."""
    names = ["kg", "Grammes", "POUNDS", "oz.", "metric tons", "mg", "carton", ""]
    unit = F.element_at(F.array(*(F.lit(u) for u in names)), (F.col("ord") % 8 + 1).cast("int"))
    kg = c.to_kilograms(F.lit(1), unit)
    return items(s, d).select("l_orderkey", "ord", c.mass_unit(unit).alias("unit"), F.round(kg["kg"] * 1000000, 0).cast("long").alias("milligrams"), kg["recognized"].alias("recognized"))


_UP = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"
QUERIES = {
    "number_forms": (_numbers, f"""WITH {ITEMS_SQL}, x AS (SELECT *, cents // 100 AS w, lpad((cents % 100)::VARCHAR, 2, '0') AS f FROM items), y AS (SELECT *, w || '.' || f AS fixed, rtrim(f, '0') AS r FROM x)
SELECT l_orderkey, ord, fixed, format('{{:,}}', w) || '.' || f AS grouped, CASE WHEN r = '' THEN w::VARCHAR ELSE w || '.' || r END AS short, CASE WHEN r = '' THEN w || '.0' ELSE w || '.' || r END AS short1, (cents * 1000) // 7 AS part_mils FROM y"""),
    "date_forms": (_dates, """WITH x AS (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'week of ' || strftime(day, '%d') ELSE upper(strftime(day, '%d-%b-%Y')) END AS named,
CASE WHEN o_orderkey % 7 = 0 THEN 'week of ' || strftime(day, '%d') ELSE strftime(day, '%d/%m/%Y') END AS plain FROM x"""),
    "key_forms": (_keys, f"""SELECT doc_id, sha256(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', '', 'g')) AS text_key, sha256(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g')) AS item_key,
sha256({_UP.format("replace(coalesce(text, ''), 'ß', 'ss')")}) AS identity_key, sha256(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) AS digits, upper(concat_ws('/', source, lang)) AS invoice_key,
len(list_filter(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[a-z0-9]+'), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+'))) AS n_tokens FROM documents"""),
    "search_query_guard": (_guard, r"""WITH q AS (SELECT concat_ws('-', conv_id, turn, role) AS id, text AS q FROM conversations UNION ALL SELECT 'o' || o_orderkey, (o_orderkey % 20) || '.' FROM orders), t AS (SELECT *, trim(coalesce(q, '')) AS x FROM q)
SELECT id, q, CASE WHEN length(x) < 2 THEN 'TOO_SHORT' WHEN length(x) > 120 THEN 'TOO_LONG' WHEN regexp_full_match(x, '[0-9\s.,/-]+') AND length(regexp_replace(x, '[^0-9]', '', 'g')) < 2 THEN 'FEW_DIGITS' END AS error FROM t"""),
    "serial_number_lists": (_serials, """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), x AS (SELECT *, l_orderkey % 6 + 1 AS k, greatest(1, n // 2) AS h FROM n)
SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN array_to_string(range(1, n + 1), ' ') WHEN k <= n THEN array_to_string(list_sort(list_distinct(list_append(range(1, h + 1), k))), ' ') END AS serials FROM x"""),
    "rate_override": (_overrides, """WITH u AS (SELECT event_type, CAST(round(avg(CAST(round(value * 100) AS BIGINT))) AS BIGINT) AS usual FROM events GROUP BY 1), x AS (SELECT event_id, usual, CAST(round(value * 100) AS BIGINT) AS v FROM events JOIN u USING (event_type)),
y AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 13 = 0 THEN '-' || v ELSE v::VARCHAR END AS given FROM x)
SELECT event_id, given, usual, CASE WHEN event_id % 11 = 0 OR v = 0 OR event_id % 13 = 0 THEN 'INVALID' WHEN usual > 0 AND (v > usual * 10 OR v * 10 < usual) THEN 'IMPLAUSIBLE' ELSE 'OK' END AS verdict FROM y"""),
    "numeric_locale_six": (_votes, r"""WITH v AS (SELECT doc_id, 3 * len(regexp_extract_all(text, '[0-9]\.[0-9]{3},[0-9]{1,2}\b')) + 3 * len(regexp_extract_all(text, '[0-9]\.[0-9]{3}\.[0-9]{2}\b')) + 2 * len(regexp_extract_all(text, '(?i)[0-9],[0-9]{3}\s*KGS?\b')) + len(regexp_extract_all(text, '[0-9],[0-9]{2}([^0-9A-Za-z_.]|$)')) AS eu,
3 * len(regexp_extract_all(text, '[0-9],[0-9]{3}\.[0-9]{1,2}\b')) + len(regexp_extract_all(text, '[0-9]\.[0-9]{2}([^0-9A-Za-z_,]|$)')) AS us FROM documents WHERE text IS NOT NULL) SELECT doc_id, eu, us, CASE WHEN eu > us THEN 'EU' WHEN us > eu THEN 'US' END AS locale FROM v"""),
    "commercial_description": (_described, f"""WITH {ITEMS_SQL}, x AS (SELECT *, trim(p_name) AS p, (l_quantity::BIGINT) // 4 AS w, ['', '.25', '.5', '.75'][(l_quantity::BIGINT) % 4 + 1] AS f FROM items JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, ord, p || ' ' || w || f || CASE WHEN l_returnflag = 'R' THEN '' ELSE ' ' || l_returnflag END AS description FROM x"""),
    "amount_readings": (_readings, f"""WITH {ITEMS_SQL} SELECT l_orderkey, ord, CASE WHEN ord % 7 = 5 THEN NULL WHEN ord % 7 = 2 THEN -cents ELSE cents END AS read_cents FROM items"""),
    "unit_spellings": (_spellings, f"""WITH {ITEMS_SQL}, x AS (SELECT l_orderkey, ord, ord % 8 AS k FROM items)
SELECT l_orderkey, ord, ['KGM', 'G', 'LB', 'OZ', 'T', 'MG', NULL, NULL][k + 1] AS unit, [1000000, 1000, 453592, 28350, 1000000000, 1, NULL, 1000000][k + 1]::BIGINT AS milligrams, k <> 6 AS recognized FROM x"""),
}
