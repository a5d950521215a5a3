"""What rows claim against what their pages print: invented values of continuation lines, quotes given as evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cells as c, descriptions as d

#: Bars that a table line has at least, and the share of a quote's words that a page must hold.
BARS, SHARE = 4, 0.5


def _digits(text: Column) -> Column:
    """Digits of the numbers in a text, each number's in one (1.920,00 is 192000)."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([0-9][0-9.,]*)"), F.lit(1)), lambda x: F.translate(x, ".,", ""))


def neutralized(rows: DataFrame, pages: DataFrame, document: str) -> DataFrame:
    """rows with price and total nulled where their page proves them invented, and `invented`.

    rows: document, page, row (its name), line_no, model, description, qty, price, total, as read. pages: document, page, text. A row is met by
    the table lines of its page that hold one of its codes (part and trade numbers of its number and model, trade numbers of
    its description), by an index of the page's codes. Its values go only if it meets lines, none of these prints a quantity or an amount, and no
    number that it claims stands on them. Rows without values, without codes or without lines stay.
    """
    key = [document, "page", "row"]
    named = F.array_distinct(F.concat(d.identity_tokens(F.concat_ws(" ", "line_no", "model")), F.filter(d.identity_tokens(F.coalesce("description", F.lit(""))), lambda x: x.rlike("^0[0-9]{12,13}$"))))
    valued = rows.where("price is not null or total is not null")
    asked = valued.select(*key, _digits(F.concat_ws(" ", "qty", "price", "total")).alias("claimed"), F.explode(named).alias("code"))
    lines = pages.select(document, "page", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") - F.length(F.translate("line", "|", "")) >= BARS)
    lines = lines.withColumn("at", d.quantity_cell(d.table_cells(F.col("line")))["at"])
    prints = F.col("at").isNotNull() | F.col("line").rlike(r"[0-9][.,][0-9]{2}(?![0-9])")
    index = lines.select(document, "page", prints.alias("prints"), _digits(F.col("line")).alias("numbers"), F.explode(d.identity_tokens(F.col("line"))).alias("code"))
    met = asked.join(index, [document, "page", "code"]).groupBy(*key).agg(F.bool_or(F.col("prints") | F.arrays_overlap("claimed", "numbers")).alias("proved"))
    invented = met.where("not proved").select(*key, F.lit(True).alias("invented"))
    out = rows.join(invented, key, "left").withColumn("invented", F.coalesce("invented", F.lit(False)))
    return out.withColumns({x: F.when(~F.col("invented"), F.col(x)) for x in ("price", "total")})


def plain(text: Column) -> Column:
    """Lower case without marks, single blanks."""
    return F.trim(F.regexp_replace(F.lower(c.unaccented(text)), r"\s+", " "))


def folded(text: Column) -> Column:
    """Plain text in capitals, as a quote may print it: ß is SS."""
    return c.unaccented(F.upper(text))


def evidence(quotes: DataFrame, pages: DataFrame, document: str) -> DataFrame:
    """quotes (document, page, quote and more) with `verdict`: OK, OUTSIDE (the document has no such page) or NOT_FOUND.

    A quote is found if the page holds it, its first 40 characters, or half of its words of three letters and more, as scans differ
    from print. A quote without anything in it is OK on a page that exists. Characters and letters are counted as the quote prints them.
    """
    texts = pages.select(document, "page", folded(plain(F.coalesce("text", F.lit("")))).alias("_page"))
    both = quotes.join(texts, [document, "page"], "left").withColumn("_quote", plain(F.coalesce("quote", F.lit(""))))
    words = F.filter(F.split("_quote", " "), lambda w: F.length(w) > 2)
    held = F.size(F.filter(words, lambda w: F.contains(F.col("_page"), folded(w))))
    found = (F.col("_quote") == "") | F.contains(F.col("_page"), folded(F.substring("_quote", 1, 40))) | (F.size(words) > 0) & (held >= F.size(words) * SHARE)
    return both.withColumn("verdict", F.when(F.col("_page").isNull(), "OUTSIDE").when(found, "OK").otherwise("NOT_FOUND")).drop("_page", "_quote")
