"""Values that pages don't print go, printed ones stay; quotes are found or not, by hand."""

from tradelake.operators.evidence import evidence, neutralized

PAGE = """| 1 | LA6JL30 stent | 25 | EA | 9.50 |
|  | LA7JL31 Batch 12 |  |  |  |
|  | LA8JL32 Batch 20 24.46 |  |  |  |
|  | LA9JL33 Batch 55 |  |  |  |
| 2 | LA9JL33 | 3 | EA | 4.00 |
| LC1JL35 | 12230 |  |  |  |
LD2JL36 no table"""


def test_invented_values(spark):
    pages = spark.createDataFrame([(1, 1, PAGE), (2, 1, None)], "doc long, page long, text string")
    row = lambda i, model, price="24.46", page=1, text="goods", doc=1, total=None: (doc, page, i, None, model, text, "20", price, total)
    rows = [
        row(1, "LA6JL30"), row(2, "LA7JL31"), row(3, "LA8JL32"), row(4, "LA9JL33"), row(5, "LC1JL35", total="122.30"), row(6, "LD2JL36"), row(7, None), row(8, "LA7JL31", None), row(9, "LA7JL31", page=2), row(10, "LA7JL31", doc=2),
    ]
    schema = "doc long, page long, row long, line_no string, model string, description string, qty string, price string, total string"
    got = {r.row: (r.price, r.total, r.invented) for r in neutralized(spark.createDataFrame(rows, schema), pages, "doc").collect()}
    assert {k for k, v in got.items() if v[2]} == {2} and got[2] == (None, None, True)  # its one line prints no value and none of its numbers
    assert got[5] == ("24.46", "122.30", False) and got[8] == (None, None, False) and len(got) == 10  # 12230 stands on the line


def test_quotes(spark):
    pages = spark.createDataFrame([(1, 1, "Désignation:  Steel  BOLT, 40 pieces in nine cartons"), (1, 2, None)], "doc long, page long, text string")
    cases = [(1, "designation: steel bolt", "OK"), (1, "40 pieces of  brass", "OK"), (1, "copper tubes and rods", "NOT_FOUND"), (1, "", "OK"), (1, None, "OK"), (2, "steel", "NOT_FOUND"), (3, "steel", "OUTSIDE")]
    quotes = spark.createDataFrame([(1, p, i, q) for i, (p, q, _) in enumerate(cases)], "doc long, page long, i int, quote string")
    assert [r.verdict for r in evidence(quotes, pages, "doc").orderBy("i").collect()] == [v for _, _, v in cases]


def test_quotes_in_capitals(spark):
    pages = spark.createDataFrame([(1, 1, "Straßenschuhe groß, 5 µm weiß, für den Fußweg\nund für Grüße ŉ ǰ")], "doc long, page long, text string")
    quotes = pages.selectExpr("doc", "page", "explode(array(upper(text), upper(substring(text, 1, 14)), lower(upper(text)), 'GROSSE KISTE')) as quote")
    assert [r.verdict for r in evidence(quotes, pages, "doc").collect()] == ["OK", "OK", "OK", "NOT_FOUND"]
    short = quotes.limit(1).selectExpr("doc", "page", "'aß qqqxq' as quote")  # two letters as printed, so the only word that counts is not found
    assert evidence(short, pages.selectExpr("doc", "page", "'aß bß' as text"), "doc").first().verdict == "NOT_FOUND"
