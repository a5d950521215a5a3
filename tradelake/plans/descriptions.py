"""Queries of descriptions, table lines and declaration text, printed from orders, their items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import descriptions as t
from ..sources.tables import ITEMS_SQL, items, read


def _parts(s, d):
    return items(s, d).join(read(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_size"), "l_partkey")


def _cases(k, *values):
    """The k-th of some columns or texts."""
    return F.get(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), k.cast("int"))


def _brands(s, d):
    """Brand of each item: its cell behind a courtesy, its part's brand, or the supplier where the cell says nothing."""
    x = _parts(s, d).join(read(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    cell = _cases(F.col("ord") % 4, "n/a", F.concat(F.lit("M/S. "), "p_name"), F.col("p_brand"), F.concat(F.lit("The A. "), "p_brand"))
    return x.select("l_orderkey", "ord", t.brand(cell, F.col("s_name")).alias("brand"))


def _sizes(s, d):
    """Size of each item from its description: packs, measured values, words, and counts, which are none."""
    n, name = F.col("p_size").cast("string"), F.regexp_replace("p_name", "small|medium|large", "plain")
    text = _cases(
        F.col("ord") % 7, F.concat(name, F.lit(" "), n, F.lit(" kg, 10 x "), n, F.lit("  cm")), F.concat(name, F.lit(" "), n, F.lit("ml")), F.concat(name, F.lit(" "), n, F.lit(" PCS")),
        F.concat(name, F.lit(" S/XL")), F.concat(name, F.lit(" grade L")), F.concat(F.lit("Extra  large "), name), F.concat(name, F.lit(" US "), n),
    )
    return _parts(s, d).select("l_orderkey", "ord", t.size(F.lit("-"), text).alias("size"))


def _cleaning(s, d):
    """Descriptions parted from the batch and date annotations behind them, and whether they name anything."""
    key, day = F.col("l_orderkey").cast("string"), F.to_date("l_shipdate")
    text = _cases(
        F.col("ord") % 6, F.col("p_name"), F.concat(F.col("p_name"), F.lit(" Batch No "), key, F.lit(" Exp.Dt:"), F.upper(F.date_format(day, "dd/MMM/yyyy"))),
        F.concat(F.col("p_name"), F.lit(" 1234567 "), F.date_format(day, "MM/yyyy")), F.concat(F.col("p_name"), F.lit(" Job Lot")), F.concat(F.lit("Lot "), key, F.lit(" "), F.col("p_name")), F.concat(F.lit("SKU LA"), F.lpad(key, 9, "0")),
    )
    x = _parts(s, d).select("l_orderkey", "ord", t.cleaned(text).alias("x"))
    return x.select("l_orderkey", "ord", F.col("x.kept").alias("kept"), F.col("x.trimmed").alias("trimmed"), t.code_only(F.col("x.kept")).alias("code_only"))


def _lines(s, d):
    """Table lines of items: a pair of cells, merged cells with and without a space, and a size that is no quantity."""
    q = F.col("l_quantity").cast("int").cast("string")
    cell = _cases(F.col("ord") % 4, F.concat(q, F.lit(" | pcs")), F.concat(q, F.lit(" EA (1/EA)")), F.concat(q, F.lit("CTN")), F.concat(q, F.lit("CM")))
    code = F.concat(F.lit("PX"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"))
    return items(s, d).withColumn("line", F.concat(F.lit("| **"), F.col("ord").cast("string"), F.lit("** | "), code, F.lit(" goods | "), cell, F.lit(" | "), F.col("cents").cast("string"), F.lit(" |")))


def _quantities(s, d):
    found = t.quantity_cell(t.table_cells(F.col("line")))
    return _lines(s, d).select("l_orderkey", "ord", found.alias("x")).select("l_orderkey", "ord", F.col("x.at").cast("long").alias("place"), F.col("x.qty").alias("qty"), F.col("x.unit").alias("unit"))


def _manifest(s, d):
    """Item numbers of the lines of each printed page (an order's items of one status) that state a quantity."""
    pages = _lines(s, d).groupBy("l_orderkey", "l_linestatus").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("page"))
    lines = pages.select("l_orderkey", "l_linestatus", F.explode(F.split("page", "\n")).alias("line")).where("length(line) - length(replace(line, '|', '')) >= 4")
    cells = lines.select("l_orderkey", "l_linestatus", t.table_cells(F.col("line")).alias("cells"))
    found = cells.withColumn("at", t.quantity_cell(F.col("cells"))["at"]).where("at > 0")
    known = found.select("l_orderkey", "l_linestatus", t.identity_tokens(F.array_join(F.slice("cells", F.lit(1), F.col("at")), " ")).alias("tokens")).where("size(tokens) > 0")
    return known.groupBy("l_orderkey", "l_linestatus").agg(F.count("*").alias("anchors"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))), " ").alias("tokens"))


def _net(s, d):
    """Net weight of lines whose quantity is printed in units of mass; packs, pieces and blanks state none."""
    x = items(s, d)
    return x.select("l_orderkey", "ord", t.net_from_quantity(F.col("l_quantity").cast("decimal(18,6)"), _cases(F.col("ord") % 7, "KG", "MT", "25 KG", "mg", "", "PCS", "Grams")).alias("x")).select(
        "l_orderkey", "ord", (F.col("x.net") * 1000).cast("long").alias("net_grams"), F.col("x.doubtful").alias("doubtful"))


def _taxable(s, d):
    """Pages (an order's items) whose taxable column is a rate or junk are priced by the amount column.

    It is so if three rows or more print both figures and the taxable one is the same on all while amounts
    differ, or below a quarter of the amount on all. Other pages keep the taxable figure.
    """
    taxable = F.when(F.col("ord") % 9 == 0, F.lit(0)).when(F.col("l_orderkey") % 3 == 0, 500).when(F.col("l_orderkey") % 3 == 1, F.expr("cents div 5")).otherwise(F.expr("cents div 2"))
    x = items(s, d).select("l_orderkey", "ord", "cents", taxable.cast("long").alias("taxable"))
    both = (F.col("cents") > 0) & (F.col("taxable") > 0)
    pages = x.where(both).groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.min("taxable").alias("t0"), F.max("taxable").alias("t1"), F.min("cents").alias("a0"), F.max("cents").alias("a1"), F.bool_and(F.col("taxable") * 4 < F.col("cents")).alias("small")
    )
    junk = pages.select("l_orderkey", ((F.col("n") >= 3) & ((F.col("t0") == F.col("t1")) & (F.col("a0") < F.col("a1")) | F.col("small"))).alias("junk"))
    rejected = F.coalesce("junk", F.lit(False))
    stated = F.when(F.col("taxable") > 0, F.col("taxable")).otherwise(F.col("cents"))
    return x.join(junk, "l_orderkey", "left").select("l_orderkey", "ord", rejected.alias("rejected"), F.when(rejected, F.col("cents")).otherwise(stated).alias("value"))


def _references(s, d):
    """The reference lines of each order's declaration; the transport documents it has go by its key."""
    key, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey")
    rows = items(s, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("l_partkey").cast("string").alias("number"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date")))).alias("invoices"))
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    text = t.reference_lines(
        F.when(k % 2 == 0, F.concat(F.lit("160-"), key)), F.when(k % 4 == 0, F.concat(F.lit("H"), key)), F.when(k % 3 == 0, F.concat(F.lit("BL"), key)), F.when(k % 9 == 0, day), F.col("invoices"),
        F.when(k % 5 > 0, key), day, _cases(k % 5, "", "200", "400", "999", "123"), F.when(k % 7 == 0, "BILL_OF_LADING"),
    )
    return read(s, d, "orders").join(rows, "o_orderkey").select("o_orderkey", text.alias("lines"))


def _owned(s, d):
    """Pages owned by the parser: a confirmed row or more and no goods-like line left over; fragments without a value are excused."""
    x = items(s, d)
    row, fragment = F.col("ord") % 4 > 0, F.col("l_discount") < 0.03
    return x.groupBy("l_orderkey", "l_linestatus").agg(F.count_if(row).alias("rows"), F.count_if(~row & ~fragment).alias("left_over")).withColumn("owned", (F.col("rows") > 0) & (F.col("left_over") == 0))


_DAY = "upper(strftime({}, '%d-%b-%Y'))"
QUERIES = {
    "brand_names": (_brands, f"""WITH {ITEMS_SQL} SELECT l_orderkey, ord, upper(CASE ord % 4 WHEN 0 THEN regexp_extract(s_name, '[A-Za-z0-9]+') WHEN 1 THEN regexp_extract(p_name, '[A-Za-z0-9]+') ELSE regexp_extract(p_brand, '[A-Za-z0-9]+') END) AS brand
FROM items JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey"""),
    "item_sizes": (_sizes, f"""WITH {ITEMS_SQL} SELECT l_orderkey, ord, CASE ord % 7 WHEN 0 THEN '10 x ' || p_size || ' cm' WHEN 1 THEN p_size || 'ml' WHEN 2 THEN 'NA' WHEN 3 THEN 'SMALL/EXTRA LARGE' WHEN 4 THEN 'NA' WHEN 5 THEN 'EXTRA LARGE' ELSE 'US ' || p_size END AS size
FROM items JOIN part ON p_partkey = l_partkey"""),
    "description_cleaning": (_cleaning, f"""WITH {ITEMS_SQL}, x AS (SELECT *, ord % 6 AS k, l_shipdate::DATE AS day FROM items JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, ord, CASE k WHEN 3 THEN p_name || ' Job Lot' WHEN 4 THEN 'Lot ' || l_orderkey || ' ' || p_name WHEN 5 THEN 'SKU LA' || lpad(l_orderkey::VARCHAR, 9, '0') ELSE p_name END AS kept,
CASE k WHEN 1 THEN 'Batch No ' || l_orderkey || ' Exp.Dt ' || upper(strftime(day, '%d/%b/%Y')) WHEN 2 THEN '1234567 ' || strftime(day, '%m/%Y') END AS trimmed, k = 5 AS code_only FROM x"""),
    "quantity_cells": (_quantities, f"""WITH {ITEMS_SQL} SELECT l_orderkey, ord, CASE WHEN ord % 4 < 3 THEN 2 END AS place, CASE WHEN ord % 4 < 3 THEN l_quantity::INTEGER::VARCHAR END AS qty, ['pcs', 'EA', 'CTN', NULL][ord % 4 + 1] AS unit FROM items"""),
    "goods_row_manifest": (_manifest, f"""WITH {ITEMS_SQL}, x AS (SELECT *, 'PX' || lpad(l_partkey::VARCHAR, 6, '0') AS token FROM items WHERE ord % 4 < 3)
SELECT l_orderkey, l_linestatus, count(*) AS anchors, array_to_string(list_sort(list_distinct(list(token))), ' ') AS tokens FROM x GROUP BY 1, 2"""),
    "net_from_quantity": (_net, f"""WITH {ITEMS_SQL}, x AS (SELECT *, ord % 7 AS k, l_quantity::BIGINT AS q FROM items)
SELECT l_orderkey, ord, CASE k WHEN 0 THEN q * 1000 WHEN 1 THEN q * 1000000 WHEN 6 THEN q END AS net_grams, CASE WHEN k IN (0, 1, 6) THEN k = 1 END AS doubtful FROM x"""),
    "taxable_column": (_taxable, f"""WITH {ITEMS_SQL}, x AS (SELECT l_orderkey, ord, cents, CASE WHEN ord % 9 = 0 THEN 0 WHEN l_orderkey % 3 = 0 THEN 500 WHEN l_orderkey % 3 = 1 THEN cents // 5 ELSE cents // 2 END AS taxable FROM items),
p AS (SELECT l_orderkey, count(*) >= 3 AND (count(DISTINCT taxable) = 1 AND count(DISTINCT cents) > 1 OR max(taxable * 4 - cents) < 0) AS junk FROM x WHERE cents > 0 AND taxable > 0 GROUP BY 1)
SELECT l_orderkey, ord, coalesce(junk, false) AS rejected, CASE WHEN junk OR taxable <= 0 THEN cents ELSE taxable END AS value FROM x LEFT JOIN p USING (l_orderkey)"""),
    "declaration_references": (_references, f"""WITH {ITEMS_SQL}, i AS (SELECT l_orderkey AS o_orderkey, string_agg('INVOICE NO:' || l_partkey || ' DT: ' || {_DAY.format('l_shipdate')}, chr(10) ORDER BY ord) AS invoices FROM items GROUP BY 1),
x AS (SELECT o_orderkey AS k, invoices, {_DAY.format('o_orderdate')} AS day, CASE WHEN k % 3 = 0 THEN 'B/L NO:BL' || k || CASE WHEN k % 9 = 0 THEN ' B/L DATE:' || day ELSE '' END END AS bill,
CASE WHEN k % 2 = 0 THEN trim('MAWB NO:160-' || k || ' HAWB:' || CASE WHEN k % 4 = 0 THEN 'H' || k ELSE '' END) END AS air FROM orders JOIN i USING (o_orderkey))
SELECT k AS o_orderkey, concat_ws(chr(10), CASE WHEN k % 7 = 0 AND bill IS NOT NULL THEN NULL ELSE air END, bill, invoices, CASE WHEN k % 5 > 0 THEN ['LC NO', 'TT REF', 'FOC', 'BANK REF'][k % 5] || ':' || k || ', DT:' || day END) AS lines FROM x"""),
    "page_ownership": (_owned, f"""WITH {ITEMS_SQL}, x AS (SELECT l_orderkey, l_linestatus, count(*) FILTER (WHERE ord % 4 > 0) AS rows, count(*) FILTER (WHERE ord % 4 = 0 AND l_discount >= 0.03) AS left_over FROM items GROUP BY 1, 2)
SELECT *, rows > 0 AND left_over = 0 AS owned FROM x"""),
}
