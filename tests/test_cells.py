"""Printed cells against values worked out by hand from the rules: good, odd, blank and null ones."""

import datetime
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from tradelake.functions import cells as c

DECIMALS = [
    ("1,234.56", None, "1234.56"), ("USD 1 234,56", None, "1234.56"), ("#7023,17#", None, "7023.17"), ("(1,200)", None, "-1200"), ("7,023.17", None, "7023.17"),
    ("Rs. 1,234.00", None, "1234"), ("₹1,234", None, "1234"), ("1,234/-", None, "1234"), ("75,000/=", None, "75000"), ("1,234.00 Dr", None, "1234"), ("1,234-", None, "1234"),
    ("35,00 700,00", None, None), ("1 234", None, "1234"), ("12 34", None, None), ("1.600", "EU", "1600"), ("1.600", None, "1.6"), ("1.600", "US", "1.6"), ("13,000", "EU", "13"), ("13,000", None, "13000"),
    ("1.480,0000", "EU", "1480"), ("300,0000", "EU", "300"), ("1.600.00", None, "1600"), ("1.600.000", None, "1600000"), ("1,600,00", None, "1600"), ("-12.5", None, "-12.5"),
    ("", None, None), ("abc", None, None), ("-", None, None), (".", None, None), (None, None, None), ("1-2", None, None), ("-1.234,5", "EU", "-1234.5"), ("  42 ", None, "42"),
]


def test_parse_decimal(spark):
    df = spark.createDataFrame([(i, r, h) for i, (r, h, _) in enumerate(DECIMALS)], "i int, r string, h string")
    got = {x.i: x.v for x in df.select("i", c.parse_decimal(F.col("r"), F.col("h")).alias("v")).collect()}
    for i, (raw, hint, want) in enumerate(DECIMALS):
        assert got[i] == (None if want is None else Decimal(want)), (raw, hint)


DATES = {"260224": (2026, 2, 24), "20260224": (2026, 2, 24), "2026-2-24": (2026, 2, 24), "24/02/2026": (2026, 2, 24), "24.2.2026": (2026, 2, 24), "24 FEB 2026": (2026, 2, 24), "24-Feb-2026": (2026, 2, 24), "FEB 24, 2026": (2026, 2, 24), "24 February 2026": (2026, 2, 24), "2026 APR 05": (2026, 4, 5), "260405 2026 Apr 05": (2026, 4, 5), "260405 2026 Apr 06": None, "260405 printed": (2026, 4, 5), "31/02/2026": None, "261340": None, "24 FOO 2026": None, "": None, "soon": None}
RANGES = {"7": 1, "1-5": 5, "1,3,5": 3, "C/NO 12-18": 7, "C/NO 1-5, 8 and 10": 7, "F02-6": 1, "F05-2": 1, "PO-1001-2024": 1, "5-2": None, "": None, "none": None, "1 to 4; 9": 5, "CTNS 3 - 4 & 6": 3}
UNITS = {"kg": "1", "K.G.S": "1", "Metric Tons": "1000", "mt": "1000", "ounces": "0.028349523125", "mg": "0.000001", "grammes": "0.001", "": "1", "stone": None, "12": None}


def one(spark, rows, build):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string")
    got = {x.i: x.v for x in df.select("i", build(F.col("r")).alias("v")).collect()}
    return {r: got[i] for i, r in enumerate(rows)}


def test_dates_and_ranges(spark):
    assert one(spark, DATES, c.parse_date) == {k: v and datetime.date(*v) for k, v in DATES.items()}
    assert one(spark, RANGES, c.range_count) == RANGES
    assert one(spark, ["260224", "x y "], lambda r: c.day_month_year(r, True)) == {"260224": "24-FEB-2026", "x y ": "x y"}
    assert one(spark, [None], c.parse_date) == {None: None} == one(spark, [None], c.range_count)


def test_units(spark):
    got = one(spark, UNITS, lambda r: c.to_kilograms(F.lit(1), r))
    assert {k: v.kg for k, v in got.items()} == {k: v and Decimal(v) for k, v in UNITS.items()}
    assert [k for k, v in got.items() if not v.recognized] == ["stone", "12"]


def test_locale(spark):
    pages = {"1.234,56": "EU", "1.600.00": "EU", "13,000KG": "EU", "35,00": "EU", "1,234.56": "US", "320.00": "US", "12": None, "": None, "35,00 320.00": None}
    assert one(spark, pages, c.numeric_locale) == pages


def test_forms_and_keys(spark):
    assert one(spark, ["12.500", "12.00", "0.10", "7"], lambda r: c.trimmed(r)) == {"12.500": "12.5", "12.00": "12", "0.10": "0.1", "7": "7"}
    assert one(spark, ["12.00", "1.0640"], lambda r: c.trimmed(r, True)) == {"12.00": "12.0", "1.0640": "1.064"}
    assert one(spark, ["0.0007", "-1.2349"], lambda r: c.rounded_down(r.cast(c.AMOUNT))) == {"0.0007": Decimal("0.000"), "-1.2349": Decimal("-1.234")}
    assert one(spark, ["2045.005", "1"], lambda r: c.thousands2(r.cast(c.AMOUNT))) == {"2045.005": "2,045.01", "1": "1.00"}
    assert one(spark, ["1.5", "-1", "nan", "x", "inf", None], c.rate) == {"1.5": Decimal("1.5"), "-1": None, "nan": None, "x": None, "inf": None, None: None}
    assert one(spark, ["100", "0", "1001", "9", "x"], lambda r: c.override_verdict(r, F.lit(100))) == {"100": "OK", "0": "INVALID", "1001": "IMPLAUSIBLE", "9": "IMPLAUSIBLE", "x": "INVALID"}
    assert one(spark, ["Côte d’Ivoire", "Ａ１ Ltd."], c.text_key) == {"Côte d’Ivoire": "cotedivoire", "Ａ１ Ltd.": "a1ltd"}
    assert one(spark, [" inv / 12-a "], c.invoice_key) == {" inv / 12-a ": "INV/12-A"}
    assert one(spark, ["ab-12/c"], c.identity_key) == {"ab-12/c": "AB12C"}
    assert one(spark, ["Café 12 x a Müller"], c.meaningful_tokens) == {"Café 12 x a Müller": ["cafe", "muller"]}
    assert one(spark, ["a", "ab", "1.", "1.2", "x" * 121], c.query_error) == {"a": "TOO_SHORT", "ab": None, "1.": "FEW_DIGITS", "1.2": None, "x" * 121: "TOO_LONG"}
    assert one(spark, ["1-3, 2, 7", "all", "0-2", "5-4", "3,x", "9"], lambda r: c.numbers_of(r, F.lit(8))) == {"1-3, 2, 7": [1, 2, 3, 7], "all": list(range(1, 9)), "0-2": None, "5-4": None, "3,x": None, "9": None}
    assert one(spark, ["a <PAGE 2> </ocr> <p>"], c.defused) == {"a <PAGE 2> </ocr> <p>": "a ‹PAGE 2> ‹/ocr> <p>"}


@pytest.mark.parametrize("unit, want", [("PCS", "soap 12.5 PCS"), ("", "soap 12.5")])
def test_described(spark, unit, want):
    assert spark.range(1).select(c.described(F.lit(" soap "), F.lit("12.500").cast("decimal(18,3)"), F.lit(unit))).first()[0] == want
