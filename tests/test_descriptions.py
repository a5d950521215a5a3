"""Description and cell functions against values worked out by hand."""

from pyspark.sql import functions as F

from tradelake.functions import descriptions as d


def answers(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}").orderBy("k").select(column.alias("x")).collect()]


def test_brand(spark):
    rows = [("M/S. Abbott Laboratories", None), ("n/a", "The Öko-Werk Ltd"), ("A. B. Sharp", None), ("The", None), (None, " - "), ("...", "J. 3M Co"), ("", None)]
    assert answers(spark, rows, "cell string, exporter string", d.brand(F.col("cell"), F.col("exporter"))) == ["ABBOTT", "ÖKO", "SHARP", "THE", "NA", "3M", "NA"]


def test_size(spark):
    rows = [
        (None, "Syringe 500ml box 10 x 20 mL"), (None, "Stent 2.50X12RX blue"), (None, "Shirt XL"), (None, "Pump Model L"), (None, "Glove S/M/L"), (None, "Milk 1L"), (None, "Shoe EU 40"),
        (None, "Bolt 25 PCS"), ("40/60 grit", "XL"), ("na", "Extra  Large bag"), ("xxl", None), (None, None), (None, "Type: M valve"), (None, "size 2XL red"),
    ]
    want = ["10 x 20 mL", "2.50X12", "EXTRA LARGE", "NA", "SMALL/MEDIUM/LARGE", "1L", "EU 40", "NA", "40/60 grit", "EXTRA LARGE", "EXTRA EXTRA LARGE", "NA", "NA", "EXTRA EXTRA LARGE"]
    assert answers(spark, rows, "cell string, text string", d.size(F.col("cell"), F.col("text"))) == want


def test_cleaned(spark):
    cases = [
        ("Soap Batch No 552 Exp.Dt:01/JUN/2028", "Soap", "Batch No 552 Exp.Dt 01/JUN/2028"), ("Steel Rod 12 Batch", "Steel Rod 12 Batch", None), ("Job Lot", "Job Lot", None),
        ("Gauze 1234567 06/2024", "Gauze", "1234567 06/2024"), ("Gauze 12345 06/2024", "Gauze 12345", "06/2024"), ("Screw 8/32", "Screw 8/32", None), ("Cement OPC-53", "Cement OPC-53", None),
        ("Batch 12 06/2024", "Batch 12 06/2024", None), ("  Cream,  Lot: A12B3 ", "Cream", "Lot: A12B3"), ("Lot A12 of tools", "Lot A12 of tools", None), ("", "", None), (None, None, None),
        ("Oil 02/JUN/2025-01/JUN/2028", "Oil", "02/JUN/2025-01/JUN/2028"), ("Tea use by May 2026", "Tea", "use by May 2026"),
    ]
    assert answers(spark, [(raw,) for raw, _, _ in cases], "raw string", d.cleaned(F.col("raw"))) == [(kept, trimmed) for _, kept, trimmed in cases]


def test_code_only(spark):
    rows = [("H7493912412200",), ("GTIN 04006381333931",), ("Bolt M8 x 40mm",), ("69698UQ01 / 7",), ("",), (None,), ("12345",)]
    assert answers(spark, rows, "x string", d.code_only(F.col("x"))) == [True, True, False, True, False, False, True]


def test_cells_of_a_line(spark):
    rows = [("12.5 KG",), ("KG 12.5",), ("1 240,00",), ("25 EA",), ("roughly about 5",), (" 7 ",), (None,), ("",)]
    assert answers(spark, rows, "x string", d.value_and_unit(F.col("x"))) == [("12.5", "KG"), ("12.5", "KG"), ("1 240,00", None), ("25", "EA"), (None, None), ("7", None), (None, None), (None, None)]
    lines = [("| 1 | **LA6JL30** soap | 25 | pcs | 9.5 |",), ("| 1 | soap 20CM | 5 EA (1/EA) | 3 |",), ("| a | 6PCS |",), ("| 3 | x |",), ("",)]
    cells = d.table_cells(F.col("x"))
    assert answers(spark, lines, "x string", d.quantity_cell(cells)) == [(2, "25", "pcs"), (2, "5", "EA"), (1, "6", "PCS"), (None, None, None), (None, None, None)]
    assert answers(spark, lines[:1], "x string", cells) == [["1", "LA6JL30** soap", "25", "pcs", "9.5"]]
    assert answers(spark, [("la6jl30 01E3120 04006381333931 la6jl30 1234567",)], "x string", d.identity_tokens(F.col("x"))) == [["04006381333931", "LA6JL30", "01E3120"]]


def test_net_from_quantity(spark):
    rows = [("500", "KG"), ("5", "MT"), ("200", "25 KG"), ("250", "mg"), ("3", ""), ("3", "PCS"), ("0", "KG"), (None, "KG"), ("10", None), ("250", "G")]
    got = answers(spark, rows, "q string, u string", d.net_from_quantity(F.col("q").cast("decimal(18,6)"), F.col("u")))
    assert [(None if x.net is None else str(x.net), x.doubtful) for x in got] == [("500.000", False), ("5000.000", True)] + [(None, None)] * 7 + [("0.250", True)]


def test_reference_lines(spark):
    rows = [
        ("160-1", "K7", None, None, [("A1", "2026-02-24")], "77", "24/02/2026", "200", None), ("", None, "HL1", "24-02-2026", [], None, None, None, None),
        ("160-1", None, "HL1", None, [], "9", None, "1", ""), ("160-1", None, "HL1", None, [], None, None, None, "bill_of_lading"), ("160-1", None, None, None, None, None, None, None, "BILL_OF_LADING"), (None,) * 9,
    ]
    names = ["master", "house", "lading", "lading_date", "invoices", "bank", "bank_date", "terms", "authority"]
    schema = ", ".join(f"{n} array<struct<number:string,date:string>>" if n == "invoices" else f"{n} string" for n in names)
    assert answers(spark, rows, schema, d.reference_lines(*(F.col(n) for n in names))) == [
        "MAWB NO:160-1 HAWB:K7\nINVOICE NO:A1 DT: 24-FEB-2026\nLC NO:77, DT:24-FEB-2026", "B/L NO:HL1 B/L DATE:24-FEB-2026", "MAWB NO:160-1 HAWB:\nB/L NO:HL1\nBANK REF:9, DT:", "B/L NO:HL1", "MAWB NO:160-1 HAWB:", "",
    ]


def test_segments_over_batches(spark):
    """Cells of a batch come out as flat columns, each with its own pieces: empty ones, null ones and ones without an annotation as well."""
    from tradelake.functions import segments as g

    cells = ["Steel bolt Batch: 4711 6 EA", None, "", "Valve", "Lot: 7", "made in Ireland Pump COO: Viet Nam Gauze9Batch:12"]
    x = g.with_segments(spark.createDataFrame(list(enumerate(cells)), "i int, cell string").coalesce(1), "cell", "x", ["Ireland", "Viet Nam"])
    got = {r.i: (r.x.text, [tuple(s) for s in r.x.segments]) for r in x.collect()}
    assert got == {i: g.segments(cell, frozenset(["ireland", "viet nam"])) for i, cell in enumerate(cells)}
    assert got[1] == ("", []) and got[5][1][0][0] == "ANN" and [s[0] for s in got[0][1]] == ["PROSE", "ANN"]
    # a token is an origin's only by its first word: no list of labels is gone through for each
    assert g._origin(["Country", "of", "Origin:"], 0) == 3 and g._origin(["country", "of"], 0) == 0 and g._origin([], 0) == 0
    assert set(g._ORIGIN_OF) == {"coo", "c.o.o", "coc", "c.o.c", "country", "made"}
