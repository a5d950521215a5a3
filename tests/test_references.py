"""Labelled references and the fields filled from them, by hand."""

from tradelake.operators.references import backfilled, found_in, scan

PAGE = """Exporter: Acme Ltd
IEC: ABCDE1234567890
Consignee
| EXIM NO. | 1234567890123 |
Blower Fan 84145900
Bill of Lading No. MAEU-12/7 B/L Date: 05-Jan-2026
original bill of lading required"""


def hits(text):
    return [(x["kind"], x["party"], x["value"]) for x in scan(1, text)]


def test_scan():
    assert hits(PAGE) == [("CODE", "EXPORTER", "ABCDE1234567890"), ("CODE", "IMPORTER", "1234567890123"), ("LADING", "SHIPMENT", "MAEU-12/7"), ("LADING_DATE", "SHIPMENT", "05-Jan-2026")]
    # the value stands on the next line only where nothing is behind the label
    assert hits("EXIM CODE\n| 9876543210123 |") == [("CODE", "IMPORTER", "9876543210123")] and hits("EXIM CODE pending\n9876543210123") == []
    # the later heading counts, within 12 lines and 320 characters; without one by the label
    assert hits("Buyer x Seller y IEC 1234567890") == [("CODE", "EXPORTER", "1234567890")] and hits("Seller y Buyer x IEC 1234567890") == [("CODE", "IMPORTER", "1234567890")]
    assert hits("Buyer\n" + "-\n" * 13 + "IEC 1234567890")[0][1] == "EXPORTER" and hits("Seller" + " " * 400 + "EXIM 1234567890")[0][1] == "IMPORTER"
    # a code of 13 to 15 comes before a shorter one on the line; short numbers and words are none
    assert hits("EXIM 1234567 1234567890123") == [("CODE", "IMPORTER", "1234567890123")] and hits("EXIM NO 12 ROOM") == [] and hits("exim code: NONE") == []
    assert hits("B/L date 5 Jan 2026") == [("LADING_DATE", "SHIPMENT", "5 Jan 2026")] and hits("surrender bill of lading") == [] and hits("B/L: 05/01/2026") == [] and hits(None) == hits("") == []


def test_backfill(spark):
    pages = spark.createDataFrame([(1, 1, PAGE), (1, 2, "EXIM 5555555555555\nB/L No: LATER1"), (2, 1, None), (3, 1, "B/L date 31-Feb-2026\nB/L dated 01-Mar-2026")], "doc long, page long, text string")
    headers = spark.createDataFrame([(1, "", None, "KEPT", None), (2, None, None, None, None), (3, None, None, None, " "), (4, "a", None, None, None)], "doc long, importer_code string, exporter_code string, lading string, lading_date string")
    got = {r.doc: tuple(r)[1:] for r in backfilled(headers, found_in(pages, "doc"), "doc").collect()}
    assert got == {
        1: ("1234567890123", "ABCDE1234567890", "KEPT", "05-Jan-2026", ["importer_code@1=1234567890123", "exporter_code@1=ABCDE1234567890", "lading_date@1=05-Jan-2026"]), 2: (None,) * 4 + ([],),
        3: (None, None, None, "01-Mar-2026", ["lading_date@1=01-Mar-2026"]), 4: ("a", None, None, None, []),
    }
