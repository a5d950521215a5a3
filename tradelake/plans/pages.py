"""Queries of printed pages: headers, rows put right and confirmed, layouts remembered. Pages are printed from orders and read back as text."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import headers as h
from ..operators import evidence as e, references as r, tables as t
from ..sources.tables import ITEMS_SQL, items, read

# headers as documents print them, and the columns of their roles, worked out by hand
HEADERS = {
    "S.N.|Description of Goods|HSN Code|Qty|UOM|Rate|Amount": "desc=1 hs=2 line_no=0 price=5 qty=3 total=6 uom=4",
    "#|品名 Description|数量 / Quantity|Unit Price (USD)|Total (USD)": "desc=1 line_no=0 price=3 qty=2 total=4",
    "Pos.|Désignation|Qté.|P.U. brut|Remise %|P.U. net|Montant": "desc=1 line_no=0 price=5 qty=2 total=6",
    "Item No|Product Description|Qty Ordered|Qty Shipped|Unit Price|Net Amount|VAT|Gross Amount": "desc=1 line_no=0 price=4 qty=3 total=5",
    "Description|Pcs|Value for Customs|Total": "desc=0 price=2 qty=1 total=3",
    "CTN NO|DESCRIPTION|QTY CTN|CTN|QTY|N.W. (KGS)|G.W. (KGS)": "ctn=3 ctn_no=0 desc=1 gross_wt=6 net_wt=5 qty=4 qty_per_pkg=2",
    "Marks & Nos|Goods|Total Net (KGS)|Gross (KGS)|Colli": "ctn=4 ctn_no=0 desc=1 gross_wt=3 net_wt=2",
    "Pos.|Bezeichnung|Anzahl Kolli|Menge|Preis|Gesamtpreis": "ctn=2 desc=1 line_no=0 price=4 qty=3 total=5",
    "Name|Address|Phone": None,
}


def _from(values, k):
    return F.get(F.array(*(F.lit(v) for v in values)), k.cast("int"))


def _header_roles(s, d):
    """Roles of the columns of each order's printed header, as role=column in the order of roles."""
    header = F.concat(F.lit("| "), F.regexp_replace(_from(HEADERS, F.col("o_orderkey") % len(HEADERS)), r"\|", " | "), F.lit(" |"))
    pages = read(s, d, "orders").select("o_orderkey", F.concat_ws("\n", F.lit("PACKING LIST"), header, F.concat(F.lit("| 1 | Steel bolt "), F.col("o_orderkey").cast("string"), F.lit(" | 4 |"))).alias("text"))
    lines = h.with_roles(t.lines_of(pages, ["o_orderkey"]), packing=True)
    printed = F.array_join(F.transform(F.array_sort(F.map_entries("roles")), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    return lines.select("o_orderkey", printed.alias("roles"))


_PACKING = ("C/NO|Beschreibung|UNIT|PCS/CTN|CTNS|Total Qty|G.W. (KGS)", "Carton No|Goods|Unit|Qty per carton|Cartons|Qty|Gross weight KG")


def _packing_pages(s, d):
    """A packing list for each order: every fifth row lacks its unit's cell, a third of all state a wrong quantity, the last line is a total."""
    x = items(s, d).withColumn("each", F.col("ord") % 4 + 2).withColumn("n", F.col("l_quantity").cast("long"))
    x = x.withColumn("stated", F.col("each") * F.col("n") + F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0))
    text = lambda c: F.col(c).cast("string")
    row = F.concat_ws(" | ", F.concat(F.lit("|"), text("ord"), F.lit("-"), (F.col("ord") + 1).cast("string")), F.concat(F.lit("Part no "), text("l_partkey")), F.when(F.col("ord") % 5 > 0, "PCS"), text("each"), text("n"), text("stated"), F.concat(F.expr("cast(cents / 1000 as decimal(18,3))").cast("string"), F.lit(" |")))
    rows = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("ord", row.alias("line")))).alias("rows"), F.sum("stated").alias("sum"))
    header = F.concat(F.lit("| "), F.regexp_replace(_from(_PACKING, F.col("l_orderkey") % 2), r"\|", " | "), F.lit(" |"))
    total = F.concat(F.lit("|  | GRAND TOTAL |  |  |  | "), text("sum"), F.lit(" |  |"))
    return rows.select("l_orderkey", F.concat_ws("\n", F.lit("PACKING LIST"), header, F.transform("rows", lambda r: r["line"]), total).alias("text"))


def _packing_lines(s, d):
    return t.under_headers(t.lines_of(_packing_pages(s, d), ["l_orderkey"]), ["l_orderkey"], ["line"], packing=True)


def _realigned(s, d):
    """What becomes of rows that are short of a cell: put right where a single place proves itself, else left short."""
    x = t.put_right(_packing_lines(s, d)).where("shift != 'NONE'")
    return x.select("l_orderkey", "line", "shift", F.array_join("cells", "|").alias("cells"))


def _packed(s, d):
    """The goods rows read from each packing list: quantity, unit, grams and packages."""
    x = t.packing_rows(_packing_lines(s, d))
    return x.select("l_orderkey", "line", "description", F.col("qty").cast("long").alias("qty"), "unit", (F.col("gross") * 1000).cast("long").alias("gross_grams"), F.col("cartons").cast("long").alias("cartons"), "carton_no", "shift")


_INVOICE = ("S.N.|Description of Goods|Qty|Rate|Amount", "Pos.|Bezeichnung|Menge|Preis|Gesamtpreis", "No.|品名 Goods|Qty Ordered|Qty Shipped|Unit Price|Taxable Value|Amount")


def _invoice_pages(s, d, header: bool = True):
    """An invoice for each order. Every fourth row misprints its quantity, every ninth prints no whole quotient, and the last line is a total."""
    text = lambda c: F.col(c).cast("string")
    k = F.col("l_orderkey") % 3
    x = items(s, d).withColumn("q", F.col("l_quantity").cast("long")).withColumn("price", F.expr("cents div q"))
    x = x.withColumn("amount", F.col("price") * F.col("q") + F.when((F.col("ord") % 9 == 0) & (F.col("q") > 1) & (F.col("price") > 9), F.col("price") - 1).otherwise(0)).withColumn("printed", F.when(F.col("ord") % 4 == 0, F.col("q") + 3).otherwise(F.col("q")))
    money = lambda c: (F.col(c) / 100).cast("decimal(18,2)").cast("string")
    name = F.concat(F.lit("Part no "), text("l_partkey"))
    # the third layout states 5 % less as taxable value
    taxable = F.expr("cast((amount - amount div 20) / 100 as decimal(18,2))").cast("string")
    row = F.when(k == 2, F.concat_ws(" | ", text("ord"), name, (F.col("q") + 1).cast("string"), text("printed"), money("price"), taxable, money("amount"))).otherwise(F.concat_ws(" | ", text("ord"), name, text("printed"), money("price"), money("amount")))
    rows = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("| "), row, F.lit(" |")).alias("line")))).alias("rows"), F.sum("amount").alias("sum"))
    head = F.concat(F.lit("| "), F.regexp_replace(_from(_INVOICE, k), r"\|", " | "), F.lit(" |"))
    total = F.concat(F.lit("| Total | "), F.repeat(F.lit(" | "), F.when(k == 2, 5).otherwise(3)), (F.col("sum") / 100).cast("decimal(18,2)").cast("string"), F.lit(" |"))
    return rows.select("l_orderkey", F.concat_ws("\n", head if header else F.lit("continued"), F.transform("rows", lambda r: r["line"]), total).alias("text"))


def _confirmed(s, d):
    """The rows that each invoice's own numbers confirm, in cents."""
    lines = t.under_headers(t.lines_of(_invoice_pages(s, d), ["l_orderkey"]), ["l_orderkey"], ["line"])
    x = t.invoice_rows(lines)
    return x.select("l_orderkey", "line", F.col("qty").cast("long").alias("qty"), (F.col("price") * 100).cast("long").alias("price"), (F.col("total") * 100).cast("long").alias("total"), "derived")


def _remembered(s, d):
    """Invoices whose header is missing, read by the remembered layout that confirms most rows; layouts are learned from the orders of even keys."""
    seen = t.under_headers(t.lines_of(_invoice_pages(s, d).where("l_orderkey % 2 = 0"), ["l_orderkey"]), ["l_orderkey"], ["line"])
    name = F.array_join(F.transform(F.array_sort(F.map_entries("roles")), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    seen = seen.where("roles is not null and size(cells) = n_cols").withColumn("layout", name).withColumn("remembered", F.struct("roles", "uom", "n_cols"))
    good = h.rows_of(seen, invoice=True)
    layouts = good.groupBy("layout").agg(F.first("remembered").alias("x"), F.count("*").alias("confirmed")).select("layout", "x.*", "confirmed")
    bare = t.lines_of(_invoice_pages(s, d, header=False).where("l_orderkey % 2 = 1"), ["l_orderkey"])
    x = t.by_memory(bare, ["l_orderkey"], layouts)
    return x.groupBy("l_orderkey").agg(F.min("layout").alias("layout"), F.count("*").alias("rows"), (F.sum("total") * 100).cast("long").alias("total"))


def _carried(s, d):
    """Table lines of documents whose header stands on their first page only: by the header carried on, how many there are of each page."""
    pages = _invoice_pages(s, d).select("l_orderkey", F.posexplode(F.split("text", "\n")).alias("n", "row")).withColumn("page", F.expr("n div 4"))
    pages = pages.groupBy("l_orderkey", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda r: r["row"]), "\n").alias("text"))
    lines = t.under_headers(t.lines_of(pages, ["l_orderkey", "page"]), ["l_orderkey"], ["page", "line"])
    return lines.groupBy("l_orderkey", "page").agg(F.count("*").alias("lines"), F.count_if(F.col("n_cols") == F.size("cells")).alias("fitting"))


def _filled(s, d):
    """Declaration headers whose empty codes and bills of lading are filled from each order's pages."""
    key = F.col("o_orderkey").cast("string")
    code = lambda first: F.concat(F.lit(first), F.lpad(key, 12, "0"))
    k = F.col("o_orderkey")
    one = F.concat_ws("\n", F.concat(F.lit("Shipper: Clerk "), key), F.when(k % 2 == 0, F.concat(F.lit("IEC No: "), code("A"))), F.concat(F.lit("| Consignee | customer "), F.col("o_custkey").cast("string"), F.lit(" |")), F.lit("| EXIM CODE |"), F.concat(F.lit("| "), code("9"), F.lit(" |")), F.lit("Blower Fan 84145900"))
    two = F.concat_ws("\n", F.when(k % 3 == 0, F.concat(F.lit("B/L NO: HLCU"), key)), F.concat(F.lit("Shipped on board date: "), F.date_format("o_orderdate", "dd-MMM-yyyy")), F.lit("EXIM CODE: 7777777777777"))
    o = read(s, d, "orders")
    pages = o.select("o_orderkey", F.lit(1).alias("page"), one.alias("text")).unionByName(o.select("o_orderkey", F.lit(2).alias("page"), two.alias("text")))
    none = F.lit(None).cast("string")
    headers = o.select("o_orderkey", F.when(k % 5 == 0, "KEPT").otherwise(" ").alias("importer_code"), none.alias("exporter_code"), F.when(k % 7 == 0, "HELD").alias("lading"), none.alias("lading_date"))
    return r.backfilled(headers, r.found_in(pages, "o_orderkey"), "o_orderkey").withColumn("notes", F.array_join("notes", " "))


def _honest(s, d):
    """Items read from pages of four lines each: some lines are continuations that print a code alone, and some of their rows claim values all the same."""
    x = items(s, d).withColumn("page", F.expr("ord div 4")).withColumn("code", F.concat(F.lit("PX"), F.lpad(F.col("l_partkey").cast("string"), 5, "0"), F.lit("Z"), F.col("ord").cast("string")))
    bare = F.col("ord") % 3 == 0
    price = F.expr("cast(cents / 100 as decimal(18,2))").cast("string")
    line = F.when(bare, F.concat(F.lit("|  | "), F.col("code"), F.lit(" Lot 7 "), F.when(F.col("ord") % 2 == 0, F.col("cents").cast("string")).otherwise(""), F.lit(" |  |  |"))).otherwise(F.concat(F.lit("| 1 | "), F.col("code"), F.lit(" | 4 | EA | "), price, F.lit(" |")))
    pages = x.groupBy("l_orderkey", "page").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    rows = x.select("l_orderkey", "page", F.col("ord").alias("row"), F.lit(None).cast("string").alias("line_no"), F.col("code").alias("model"), F.lit("goods").alias("description"), F.lit("4").alias("qty"), F.when(F.col("ord") % 5 > 0, price).alias("price"), F.lit(None).cast("string").alias("total"))
    return e.neutralized(rows, pages, "l_orderkey").select("l_orderkey", F.col("row").alias("ord"), "price", "invented")


def _quoted(s, d):
    """Quotes against the text they are said to come from: copied in capitals, with half of the words changed, made up, and of a page that isn't there."""
    x = read(s, d, "documents").where("text is not null").select("doc_id", F.lit(1).alias("page"), "text")
    words = F.slice(F.split("text", " "), 1, 8)
    k = F.col("doc_id") % 4
    quote = F.when(k == 0, F.upper(F.array_join(words, "   "))).when(k == 1, F.array_join(F.transform(words, lambda w, i: F.when(i % 2 == 0, w).otherwise(F.lit("qqqxq"))), " ")).when(k == 2, "qqqxq zzzyz vvvwv").otherwise(F.lit(""))
    quotes = x.select("doc_id", F.when(k == 3, 2).otherwise(1).alias("page"), quote.alias("quote"))
    return e.evidence(quotes, x, "doc_id").select("doc_id", "page", "verdict")


_P = f"""{ITEMS_SQL}, x AS (SELECT *, ord % 4 + 2 AS each, l_quantity::BIGINT AS n, (ord % 4 + 2) * l_quantity::BIGINT + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS stated, ord + 1 AS line FROM items)"""
_I = f"""{ITEMS_SQL}, y AS (SELECT *, l_quantity::BIGINT AS q, cents // l_quantity::BIGINT AS price FROM items), x AS (SELECT *, price * q + CASE WHEN ord % 9 = 0 AND q > 1 AND price > 9 THEN price - 1 ELSE 0 END AS amount, CASE WHEN ord % 4 = 0 THEN q + 3 ELSE q END AS printed FROM y),
m AS (SELECT *, amount - amount // 20 AS taxable, l_orderkey % 3 = 2 AS third FROM x), f AS (SELECT *, printed * price AS product, 2 * abs(printed * price - amount) <= printed + 2 OR third AND 2 * abs(printed * price - taxable) <= printed + 2 AS meets FROM m),
g AS (SELECT *, amount % price = 0 AS whole, third AND 2 * abs(printed * price - (q + 1) * 100) <= printed + 2 OR 2 * abs(printed * price - ord * 100) <= printed + 2 AS other FROM f),
r AS (SELECT l_orderkey, ord, CASE WHEN meets THEN printed ELSE amount // price END AS qty, price, CASE WHEN third THEN taxable ELSE amount END AS total, NOT meets AS derived, third FROM g WHERE meets OR whole AND NOT other)"""
_LAYOUTS = ["desc=1 line_no=0 price=3 qty=2 total=4", "desc=1 line_no=0 price=4 qty=3 taxable=5 total=6"]
QUERIES = {
    "header_roles": (_header_roles, f"SELECT o_orderkey, [{', '.join('NULL' if x is None else repr(x) for x in HEADERS.values())}][o_orderkey % {len(HEADERS)} + 1] AS roles FROM orders"),
    "short_row_realignment": (_realigned, f"""WITH {_P} SELECT l_orderkey, line, CASE WHEN l_partkey % 3 = 0 THEN 'SHORT' ELSE 'REALIGNED' END AS shift,
ord || '-' || (ord + 1) || '|Part no ' || l_partkey || CASE WHEN l_partkey % 3 = 0 THEN '|' ELSE '||' END || each || '|' || n || '|' || stated || '|' || (cents / 1000)::DECIMAL(18,3) AS cells FROM x WHERE ord % 5 = 0"""),
    "packing_rows": (_packed, f"""WITH {_P} SELECT l_orderkey, line, 'Part no ' || l_partkey AS description, stated AS qty, CASE WHEN ord % 5 > 0 THEN 'PCS' END AS unit, cents AS gross_grams, n AS cartons, ord || '-' || (ord + 1) AS carton_no, CASE WHEN ord % 5 = 0 THEN 'REALIGNED' ELSE 'NONE' END AS shift
FROM x WHERE NOT (ord % 5 = 0 AND l_partkey % 3 = 0)"""),
    "invoice_rows": (_confirmed, f"WITH {_I} SELECT l_orderkey, ord::INTEGER AS line, qty, price, total, derived FROM r"),
    "layout_by_memory": (_remembered, f"""WITH {_I} SELECT l_orderkey, CASE WHEN any_value(third) THEN '{_LAYOUTS[1]}' ELSE '{_LAYOUTS[0]}' END AS layout, count(*) AS rows, sum(total)::BIGINT AS total FROM r WHERE l_orderkey % 2 = 1 GROUP BY 1 HAVING count(*) >= {t.LEAST_ROWS}"""),
    "fragment_values": (_honest, f"""WITH {ITEMS_SQL} SELECT l_orderkey, ord, CASE WHEN ord % 5 > 0 AND NOT (ord % 3 = 0 AND ord % 2 = 1) THEN (cents / 100)::DECIMAL(18,2)::VARCHAR END AS price, ord % 5 > 0 AND ord % 3 = 0 AND ord % 2 = 1 AS invented FROM items"""),
    "evidence_check": (_quoted, """WITH x AS (SELECT doc_id, doc_id % 4 AS k, trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')) AS t, string_split(text, ' ')[1:8] AS ws FROM documents WHERE text IS NOT NULL),
q AS (SELECT *, CASE k WHEN 0 THEN array_to_string(ws, ' ') WHEN 1 THEN array_to_string(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ws[i] ELSE 'qqqxq' END), ' ') WHEN 2 THEN 'qqqxq zzzyz vvvwv' ELSE '' END AS raw FROM x),
n AS (SELECT *, trim(regexp_replace(strip_accents(lower(raw)), '\\s+', ' ', 'g')) AS quote FROM q), w AS (SELECT *, list_filter(string_split(quote, ' '), lambda y: length(y) > 2) AS words FROM n)
SELECT doc_id, CASE WHEN k = 3 THEN 2 ELSE 1 END AS page, CASE WHEN k = 3 THEN 'OUTSIDE' WHEN quote = '' OR contains(t, quote[1:40]) OR len(words) > 0 AND 2 * len(list_filter(words, lambda y: contains(t, y))) >= len(words) THEN 'OK' ELSE 'NOT_FOUND' END AS verdict FROM w"""),
    "reference_backfill": (_filled, """WITH x AS (SELECT o_orderkey AS k, lpad(o_orderkey::VARCHAR, 12, '0') AS code, strftime(o_orderdate::DATE, '%d-%b-%Y') AS day FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 5 = 0 THEN 'KEPT' ELSE '9' || code END AS importer_code, CASE WHEN k % 2 = 0 THEN 'A' || code END AS exporter_code, CASE WHEN k % 7 = 0 THEN 'HELD' WHEN k % 3 = 0 THEN 'HLCU' || k END AS lading, day AS lading_date,
concat_ws(' ', CASE WHEN k % 5 <> 0 THEN 'importer_code@1=9' || code END, CASE WHEN k % 2 = 0 THEN 'exporter_code@1=A' || code END, CASE WHEN k % 7 <> 0 AND k % 3 = 0 THEN 'lading@2=HLCU' || k END, 'lading_date@2=' || day) AS notes FROM x"""),
    "page_header_carried": (_carried, f"""WITH {ITEMS_SQL}, l AS (SELECT l_orderkey, ord AS n FROM items UNION ALL SELECT l_orderkey, max(ord) + 1 FROM items GROUP BY 1)
SELECT l_orderkey, (n // 4)::INTEGER AS page, count(*) AS lines, count(*) AS fitting FROM l GROUP BY 1, 2"""),
}
