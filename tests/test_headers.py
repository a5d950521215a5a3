"""Header roles, rows put right and rows confirmed against values worked out by hand."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tradelake.functions import headers as h
from tradelake.operators import tables as t
from tradelake.plans.pages import HEADERS

MORE = {
    "Commodity Code|Goods Description|Menge|Einheit|Einzelpreis netto EUR|Betrag netto": ("desc=1 hs=0 price=4 qty=2 total=5 uom=3", False),
    "C/NO|Description|PCS/CTN|CTNS|Total Qty|UNIT|G.W.|N.W.": ("ctn=3 ctn_no=0 desc=1 gross_wt=6 net_wt=7 qty=4 qty_per_pkg=2 uom=5", True),
    "Product Description|Model|Qty UoM (Size)|Rate|Taxable Value|Amount": ("desc=0 model=1 price=3 qty=2 taxable=4 total=5 uom=2", False),
    "Carton No|Description|Qty|Gross Weight LBS": ("ctn_no=0 desc=1 gross_wt=3 qty=2", True),
    "Marks & Nos|Goods|Colli": (None, False),
    "1|Steel bolt|4": (None, True),
    "": (None, True),
}


@pytest.mark.parametrize("header, want, packing", [(k, v, True) for k, v in HEADERS.items()] + [(k, v, p) for k, (v, p) in MORE.items()])
def test_roles(header, want, packing):
    found = h.header_roles(header.split("|"), packing)
    assert (found and " ".join(f"{k}={v}" for k, v in sorted(found["roles"].items()))) == want


def test_units_and_folding():
    found = h.header_roles("Carton No|Description|Qty (PRS)|Gross Weight LBS|N.W. (KGS)".split("|"), True)
    assert found["units"] == {"gross_wt": "LBS", "net_wt": "KGS"} and found["uom"] == "PRS" and found["n_cols"] == 5
    assert h.folded("Số lượng") == "SO LUONG" and h.folded("品名 Désignation") == "DESIGNATION" and h.folded("Q'TY.") == "QTY" and h.folded(None) == ""


def test_cells_by_hand():
    from tests.test_cells import DECIMALS, RANGES

    for raw, hint, want in DECIMALS:
        assert h.amount(raw, hint == "EU") == (None if want is None else Decimal(want)), (raw, hint)
    assert {k: h.packages(k) for k in RANGES} == RANGES
    assert [h.quantity(x) for x in ("25", "25 EA (1/EA)", "6PCS", "20CM", "1.5", "x", "", None)] == [("25", None), ("25", "EA"), ("6", "PCS"), (None, None), ("1.5", None), (None, None), (None, None), (None, None)]
    assert [h.weight_unit(x) for x in ("12.5 KG", "KG 12.5", "1 240,00", "about 5", "", None)] == ["KG", "KG", "", "about", None, None]


def page(spark, text):
    return spark.createDataFrame([(1, text), (2, None), (3, "no table here")], "doc long, text string")


def read(spark, text, packing=True):
    return t.under_headers(t.lines_of(page(spark, text), ["doc"]), ["doc"], ["line"], packing)


def test_rows_put_right(spark):
    text = """PACKING LIST
| C/NO | Description | UNIT | PCS/CTN | CTNS | Total Qty | G.W. (KGS) |
| 1-4 | Bolt M8 | PCS | 5 | 4 | 20 | 8,5 |
| 5 | Washer | 10 | 3 | 30 | 2.250 |
| 6-7 | Washer | 10 | 3 | 31 | 2 |
| 8 | Nut | PCS | 5 | 1 | 5 |
| Total | | | | | 86 | |"""
    got = {r.line: (r.shift, list(r.cells)) for r in t.put_right(read(spark, text)).collect()}
    assert got[2][0] == "NONE" and got[4][0] == "SHORT"
    assert got[3] == ("REALIGNED", ["5", "Washer", "", "10", "3", "30", "2.250"])
    assert got[5][0] == "REALIGNED" and got[5][1][:6] == ["8", "Nut", "PCS", "5", "1", "5"]  # its last cell is the one missing
    rows = {r.line: r for r in t.packing_rows(read(spark, text)).collect()}
    assert sorted(rows) == [2, 3, 5]
    assert (rows[2].qty, rows[2].unit, rows[2].gross, rows[2].cartons) == (Decimal(20), "PCS", Decimal("8.500"), Decimal(4))
    assert rows[3].unit is None and rows[3].gross == Decimal("2.250") and rows[5].gross is None


def test_cartons_by_rate_or_numbers(spark):
    text = "| C/NO | Goods | Qty per carton | Qty | N.W. |\n| 1-3 | Cup | 4 | 12 | 1 kg |\n| 4-9 | Jug | 5 | 12 | 2 lb |\n| x | Pot | | | 3 foo |\n| | | | 7 | |"
    rows = {r.line: (r.cartons, r.net) for r in t.packing_rows(read(spark, text)).collect()}
    assert rows == {1: (Decimal(3), Decimal("1.000")), 2: (Decimal(6), Decimal("0.907")), }


def test_invoice_rows(spark):
    text = """| No. | Description | Qty | Rate | Amount |
| 1 | Bolt | 4 | 2.50 | 10.00 |
| 2 | Nut | 5 | 2.50 | 10.00 |
| 3 | Rod | 5 | 3.00 | 10.00 |
| 4 | Pin 7 | 3 EA | 1.333 | 4.00 |
| 5 | Cap | 2 | 9.00 | 0 |
| 6 | Free goods | 2 |  | 8.00 |
| Total | | | | 42.00 |"""
    rows = {r.line: (r.qty, r.unit, r.total, r.derived) for r in t.invoice_rows(read(spark, text, False)).collect()}
    assert rows == {
        1: (Decimal(4), None, Decimal(10), False), 2: (Decimal(4), None, Decimal(10), True), 4: (Decimal(3), "EA", Decimal(4), False), 6: (Decimal(2), None, Decimal(8), False),
    }


def test_misread_columns_refuse_the_row(spark):
    text = "| No. | Description | Qty | Rate | Amount | Other |\n| 1 | Bolt | 4 | 3.00 | 9.00 | 12.00 |"
    assert t.invoice_rows(read(spark, text, False)).collect() == []


def test_memory(spark):
    layouts = spark.createDataFrame([("a", {"desc": 0, "qty": 1, "price": 2, "total": 3}, None, 4, 50), ("b", {"desc": 0, "qty": 2, "price": 1, "total": 3}, "PCS", 4, 9)], "layout string, roles map<string,int>, uom string, n_cols int, confirmed long")
    good = "\n".join(f"| Bolt | 2.5{k} | {k + 2} | {2.5 * (k + 2) + k * (k + 2) / 100:.2f} |" for k in range(4))
    few = "\n".join(good.split("\n")[:2])
    both = spark.createDataFrame([(1, good), (2, few), (3, None)], "doc long, text string")
    got = t.by_memory(t.lines_of(both, ["doc"]), ["doc"], layouts).collect()
    # price and quantity can change places, so both layouts confirm all rows: the one that was confirmed more often stands
    assert {(r.doc, r.layout) for r in got} == {(1, "a")} and len(got) == 4
    off = good.replace("| 2.5", "| 2.5 EA | 2.5")  # of another width
    assert t.by_memory(t.lines_of(page(spark, off), ["doc"]), ["doc"], layouts).collect() == []


def test_header_holds_on_over_pages(spark):
    pages = spark.createDataFrame([(1, 1, "| Description | Qty | Rate | Amount |\n| Bolt | 1 | 2 | 2 |"), (1, 2, "| Nut | 2 | 2 | 4 |"), (2, 1, "| Rod | 2 | 2 | 4 |")], "doc long, page long, text string")
    lines = t.under_headers(t.lines_of(pages, ["doc", "page"]), ["doc"], ["page", "line"])
    assert {(r.doc, r.page): r.n_cols for r in lines.collect()} == {(1, 1): 4, (1, 2): 4, (2, 1): None}
    assert t.invoice_rows(lines).count() == 2


def test_lines_are_read_once_and_headers_go_as_text(spark):
    """Header lines and others come from one reading of the pages; short lines alone are looked at for a place."""
    text = "| S.N. | Description of Goods | Qty | Rate | Amount |\n| 1 | Steel bolt | 4 | 2.50 | 10.00 |\n| 2 | Nut | 3.00 | 9.00 |\n| Total |  |  |  | 19.00 |"
    pages = spark.createDataFrame([(1, text), (2, "| 1 | Steel bolt | 4 | 2.50 | 10.00 |")], "doc long, text string")
    lines = t.under_headers(t.lines_of(pages, ["doc"]), ["doc"], ["line"])
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    got = {(r.doc, r.line): (r["shift"], r.roles and r.roles["desc"], len(r.cells)) for r in t.put_right(lines).collect()}
    assert got == {(1, 1): ("NONE", 1, 5), (1, 2): ("SHORT", 1, 4), (1, 3): ("NONE", 1, 5), (2, 0): ("NONE", None, 5)}
    assert [(r.line, r.description, float(r.qty), float(r.total)) for r in t.invoice_rows(lines).collect()] == [(1, "Steel bolt", 4.0, 10.0)]


def test_plain_cells_read_as_before():
    for text, value in (("007", "7"), ("1.234", "1.234"), (" 12 ", "12"), ("1234567.5", "1234567.5"), ("0.50", "0.50")):
        assert h.amount(text) == Decimal(value)
    assert h.amount("1.234", True) == Decimal("1234") and h.weight_unit("12.5") == "" and h.quantity("12") == ("12", None) and h.quantity("²") == (None, None)
