"""Queries of the cell and text functions, on text that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as c
from ..sources.tables import ITEMS_SQL, items, read


def _decimals(s, d):
    """Prices printed with groups, brackets and decimal commas, read back as cents."""
    x = items(s, d)
    plain = F.format_number((F.col("cents") / 100).cast("decimal(18,2)"), 2)
    eu = F.translate(plain, ",.", ".,")
    raw = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("("), plain, F.lit(")"))).when(F.col("ord") % 3 == 1, F.concat(F.lit("USD "), plain)).otherwise(F.concat(eu, F.lit(" EUR")))
    return x.select("l_orderkey", "ord", (c.parse_decimal(raw) * 100).cast("long").alias("parsed"))


def _dates(s, d):
    x = read(s, d, "orders")
    day = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(day, "yyyyMMdd")).when(k == 1, F.date_format(day, "dd/MM/yyyy")).when(k == 2, F.upper(F.date_format(day, "d MMM yyyy"))).when(k == 3, F.date_format(day, "MMM d, yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return x.select("o_orderkey", c.parse_date(raw).alias("day"))


def _weights(s, d):
    x = items(s, d)
    unit = F.element_at(F.array(*(F.lit(u) for u in ("kg", "G.", "lbs", "stone", ""))), (F.col("ord") % 5 + 1).cast("int"))
    kg = c.to_kilograms(F.col("l_quantity").cast("decimal(18,2)"), unit)
    return x.select("l_orderkey", "ord", kg.alias("w")).select("l_orderkey", "ord", F.round(F.col("w.kg") * 1000000).cast("long").alias("milligrams"), F.col("w.recognized").alias("recognized"))


def _ranges(s, d):
    x = items(s, d).withColumn("q", F.col("l_quantity").cast("long"))
    raw = F.concat(F.lit("C/NO "), F.col("ord").cast("string"), F.lit("-"), (F.col("ord") + F.col("q")).cast("string"), F.lit(", "), F.col("q").cast("string"), F.lit(" & none"))
    return x.select("l_orderkey", "ord", c.range_count(raw).alias("packages"))


def _tokens(s, d):
    return read(s, d, "part").select("p_partkey", F.array_join(c.tokens(F.concat_ws(" ", "p_name", "p_type")), " ").alias("tokens"))


def _redact(s, d):
    x = read(s, d, "documents")
    masked = c.redacted(F.col("text"))
    return x.select("doc_id", F.sha2(masked, 256).alias("masked"), (F.regexp_count(masked, F.lit(r"\[email\]")) + F.regexp_count(masked, F.lit(r"\[secret\]"))).cast("long").alias("n"))


def _table(s, d):
    """Items printed as table lines of one page per order, split and read back."""
    x = items(s, d)
    line = F.concat_ws(" | ", F.col("ord").cast("string"), F.col("l_partkey").cast("string"), F.format_number((F.col("cents") / 100).cast("decimal(18,2)"), 2))
    pages = x.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda r: F.concat(F.lit("| "), r["line"], F.lit(" |"))), "\n").alias("page"))
    rows = pages.select("l_orderkey", F.posexplode(F.split("page", "\n")).alias("line_no", "line"))
    cell = F.split(F.trim(F.col("line")), r" *\| *")
    return rows.select("l_orderkey", F.element_at(cell, 2).try_cast("int").alias("ord"), F.element_at(cell, 3).try_cast("long").alias("l_partkey"), (c.parse_decimal(F.element_at(cell, 4)) * 100).cast("long").alias("cents"))


def _locale(s, d):
    x = read(s, d, "documents")
    eu = F.regexp_count("text", F.lit(r"[0-9]\.[0-9]{3},[0-9]{2}")) * 3 + F.regexp_count("text", F.lit(r"[0-9],[0-9]{2}[^0-9.]"))
    us = F.regexp_count("text", F.lit(r"[0-9],[0-9]{3}\.[0-9]{2}")) * 3 + F.regexp_count("text", F.lit(r"[0-9]\.[0-9]{2}[^0-9]"))
    return x.select("doc_id", eu.cast("long").alias("eu"), us.cast("long").alias("us"), F.when(eu > us, "EU").when(us > eu, "US").alias("locale"))


_MAIL, _KEY = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(sk|pk|AKIA|ghp)[-_]?[A-Za-z0-9]{16,}"
QUERIES = {
    "parse_decimal_matrix": (_decimals, f"WITH {ITEMS_SQL} SELECT l_orderkey, ord, CASE WHEN ord % 3 = 0 THEN -cents ELSE cents END AS parsed FROM items"),
    "parse_date_matrix": (_dates, "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders"),
    "to_kg_matrix": (_weights, f"WITH {ITEMS_SQL}, x AS (SELECT *, CASE ord % 5 WHEN 0 THEN 100000000 WHEN 1 THEN 100000 WHEN 2 THEN 45359237 WHEN 4 THEN 100000000 END AS f FROM items) SELECT l_orderkey, ord, CAST(round(CAST(l_quantity AS BIGINT) * f::DECIMAL(18,0) / 100) AS BIGINT) AS milligrams, f IS NOT NULL AS recognized FROM x"),
    "number_range_matrix": (_ranges, f"WITH {ITEMS_SQL} SELECT l_orderkey, ord, CAST(l_quantity AS BIGINT) + 2 AS packages FROM items"),
    "text_norm_tokens": (_tokens, "SELECT p_partkey, array_to_string(list_filter(list_sort(list_distinct(string_split(trim(regexp_replace(regexp_replace(upper(concat_ws(' ', p_name, p_type)), '[^A-Z0-9]', ' ', 'g'), ' +', ' ', 'g')), ' '))), lambda x: length(x) >= 3), ' ') AS tokens FROM part"),
    "redact_secrets": (_redact, f"WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{_MAIL}', '[email]', 'g'), '{_KEY}', '[secret]', 'g') AS t FROM documents) SELECT doc_id, sha256(t) AS masked, len(regexp_extract_all(t, '\\[email\\]|\\[secret\\]'))::BIGINT AS n FROM m"),
    "table_round_trip": (_table, f"WITH {ITEMS_SQL} SELECT l_orderkey, ord::INTEGER AS ord, l_partkey, cents FROM items"),
    "numeric_locale_vote": (_locale, r"""WITH v AS (SELECT doc_id, (3 * len(regexp_extract_all(text, '[0-9]\.[0-9]{3},[0-9]{2}')) + len(regexp_extract_all(text, '[0-9],[0-9]{2}[^0-9.]')))::BIGINT AS eu, (3 * len(regexp_extract_all(text, '[0-9],[0-9]{3}\.[0-9]{2}')) + len(regexp_extract_all(text, '[0-9]\.[0-9]{2}[^0-9]')))::BIGINT AS us FROM documents)
SELECT doc_id, eu, us, CASE WHEN eu > us THEN 'EU' WHEN us > eu THEN 'US' END AS locale FROM v"""),
}
