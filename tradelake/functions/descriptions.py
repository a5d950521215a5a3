"""Column functions for descriptions and table cells: names, sizes, trailing annotations, quantities, totals lines, declaration text."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

from . import cells as c

# Cell texts that mean that nothing is there.
NOTHING = ("", "n/a", "na", "n.a", "n.a.", "nil", "none", "null", "tbd", "tba", "?", "??", "0", "not applicable", "not available")
# Words before a trading name that are no part of it.
BEFORE_NAMES = ("m/s", "ms", "mrs", "messrs", "messers", "mssrs", "the", "pt", "cv", "ud", "pt.", "m/s.", "sdn", "bhd", "shri", "sri", "sh")
# Units that measure a product, and marks of sizing systems. Counts and packages are no sizes.
SIZE_UNITS = ("GB TB MB KB MAH KWH KW MHZ GHZ HZ INCHES INCH MM CM KM ML MG KG LBS LB OZ CC CL FT IN W V A L G M " + "\" '").split()
SIZE_SYSTEMS = ("EU", "UK", "US")
# Sizes in letters, spelled out.
LETTER_SIZES = {
    "XS": "EXTRA SMALL", "S": "SMALL", "M": "MEDIUM", "L": "LARGE", "XL": "EXTRA LARGE", "XXL": "EXTRA EXTRA LARGE", "2XL": "EXTRA EXTRA LARGE",
    "XXXL": "EXTRA EXTRA EXTRA LARGE", "3XL": "EXTRA EXTRA EXTRA LARGE", "4XL": "EXTRA EXTRA EXTRA EXTRA LARGE",
}
# Phrases of sizes in the order in which they are tried.
SIZE_PHRASES = {
    "EXTRA EXTRA EXTRA LARGE": "EXTRA EXTRA EXTRA LARGE", "EXTRA EXTRA LARGE": "EXTRA EXTRA LARGE", "DOUBLE EXTRA LARGE": "EXTRA EXTRA LARGE", "EXTRA SMALL": "EXTRA SMALL", "EXTRA LARGE": "EXTRA LARGE",
    "FREE SIZE": "FREE SIZE", "ONE SIZE": "ONE SIZE", "SMALL": "SMALL", "MEDIUM": "MEDIUM", "LARGE": "LARGE",
}
# Words after which a letter names a version, not a size.
DESIGNATORS = "model type grade class series version mark mk cat category variant rev revision".split()
# Words that may begin a trailing annotation, and those that may stand inside one.
ANNOTATION_STARTS = "batch batches lot lots mfg mfd manufacture manufactured manufacturing exp expiry expiration expires expiring serial mrp best use packed packing".split()
MONTH_WORDS = "jan feb mar apr may jun jul aug sep sept oct nov dec january february march april june july august september october november december".split()
ANNOTATION_WORDS = ANNOTATION_STARTS + MONTH_WORDS + "no nos number code dt date dates of by on before shelf life sr mm end".split()
# Labels of codes.
CODE_LABELS = ("GTIN", "SKU", "EAN", "UPC", "MPN", "CFN", "ASIN")
# Units of count and packages, as quantity columns print them.
COUNT_UNITS = (
    "EA EACH PC PCS PIECE PIECES NO NOS NR UN UNT UNIT UNITS PK PKT PKG PKGS PACK PACKS PKTS BX BOX BOXES CS CASE CASES CTN CTNS CARTON CARTONS "
    "BDL BUNDLE BUNDLES BALE BALES DRUM DRUMS PLT PALLET PALLETS BAG BAGS SAC SACHET SACHETS POUCH JAR JARS CAN CANS BTL BOTTLE BOTTLES TUBE TUBES "
    "VIAL VIALS AMP AMPS AMPOULE ROLL ROLLS RL REAM REAMS SHT SHEET SHEETS COIL COILS SET SETS KIT KITS PR PRS PAIR PAIRS DZ DZN DOZ DOZEN GRS GROSS "
    "STK STUCK STUECK PCE PZ PZS UD UDS UNID ADET PAAR PAIRE STUKS BUAH CAI"
).split()
# Printed units whose reading as a mass is open to doubt.
DOUBTFUL_UNITS = ("MT", "T", "G")
# Names of the bank reference by payment code.
BANK_NAMES = {"200": "LC NO", "400": "TT REF", "700": "CAD REF", "906": "DA REF", "600": "DAP REF", "999": "FOC"}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def printed(cell: Column) -> Column:
    """The cell with single spaces, or null where it is null, empty or says that nothing is there."""
    text = _squeezed(cell)
    return F.when(~F.lower(F.regexp_replace(text, r"^[ .\-_*]+|[ .\-_*]+$", "")).isin(*NOTHING), text)


def brand(cell: Column, exporter: Column) -> Column:
    """The first word that names something, in capitals, of the cell, else of the exporter, else NA.

    Courtesies, legal forms and single letters are passed over; if nothing else is there, the first word counts.
    """

    def name(raw):
        text = printed(raw)
        bare = lambda token: F.lower(F.regexp_replace(token, r"^[.,;:'\"()\[\]]+|[.,;:'\"()\[\]]+$", ""))
        telling = F.filter(F.split(text, " "), lambda token: (bare(token) != "") & ~bare(token).isin(*BEFORE_NAMES) & ~bare(token).rlike(r"^\p{L}$"))
        words = F.filter(F.transform(telling, lambda token: F.regexp_extract(token, r"[\p{L}\p{N}]+", 0)), lambda w: w != "")
        return F.upper(F.coalesce(F.get(words, F.lit(0)), _filled(F.regexp_extract(text, r"[\p{L}\p{N}]+", 0))))

    return F.coalesce(name(cell), name(exporter), F.lit("NA"))


def _coded(tokens: Column, code) -> Column:
    """One letter for each token, by code(token), in one text: what follows can look for forms in that."""
    return F.array_join(F.transform(tokens, code), "")


def _at(codes: Column, tokens: Column, form: str) -> Column:
    """The tokens, joined, where the codes first have that form; null without."""
    return _filled(F.array_join(F.slice(tokens, F.greatest(F.regexp_instr(codes, F.lit(form)), F.lit(1)), F.length(F.regexp_extract(codes, form, 0))), ""))


def measured_size(text: Column) -> Column:
    """The first pack or dimension (10 x 20 mm), else the first measured value (500 ml, EU 40); null without one."""
    def code(token):
        upper = F.upper(token)
        kinds = F.when(token == " ", " ").when(token.rlike("^[0-9]"), "n").when(upper.isin("X", "×"), "x").when(upper.isin(*SIZE_UNITS), "u").when(upper.isin(*SIZE_SYSTEMS), "s")
        return kinds.when(token.rlike("^[A-Za-z]{1,3}$"), "t").when(token.rlike("^[A-Za-z]"), "w").otherwise(".")

    # numbers, words and signs; a form ends before a blank or sign, a dimension also before a short word
    tokens = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?|[A-Za-z]+|\s|[^A-Za-z0-9\s])"), F.lit(1))
    ends = "(?![a-z])"
    pack = rf"n ?x ?n(?: ?x ?n)?(?: ?u{ends}|(?=[tus]{ends})|{ends})"
    measure = rf"n ?[us]{ends}|s ?n{ends}"
    return c.let(tokens, lambda t: c.let(_coded(t, code), lambda k: _squeezed(F.coalesce(_at(k, t, pack), _at(k, t, measure)))))


def worded_size(text: Column) -> Column:
    """A size in words or letters, spelled out: phrases first, then a list (S/M/L), then a letter that names no version."""
    upper = F.upper(text)
    words = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(upper, r"\bX-\s*(LARGE|SMALL)", "EXTRA $1"), "[^A-Z0-9]+", " "), F.lit(" "))
    phrase = c.let(words, lambda w: F.coalesce(*(F.when(w.contains(f" {p} "), F.lit(out)) for p, out in SIZE_PHRASES.items())))
    tokens = F.filter(F.split(F.regexp_replace(upper, r"\s*/\s*", "/"), "[^A-Z0-9/-]+"), lambda t: F.btrim(t, F.lit("-")) != "")
    listed = lambda t: t.contains("/") & F.forall(F.split(t, "/"), lambda x: x.isin(*LETTER_SIZES))
    spelled = F.array_join(F.transform(F.split(F.get(F.filter(tokens, listed), F.lit(0)), "/"), lambda x: _lookup(LETTER_SIZES, x)), "/")

    def single(t):
        alone = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: F.get(t, i - 1).isin(*LETTER_SIZES) & ~F.coalesce(F.lower(F.get(t, i - 2)).isin(*DESIGNATORS), F.lit(False)))
        return F.when(F.size(t) > 0, _lookup(LETTER_SIZES, F.get(t, F.get(alone, F.lit(0)) - 1)))

    return F.coalesce(phrase, spelled, c.let(tokens, single))


def size(cell: Column, description: Column) -> Column:
    """The size of a filled cell (as it stands if no form fits), else one found in the description, else NA."""
    own, text = printed(cell), printed(description)
    return F.when(own.isNotNull(), F.coalesce(measured_size(own), worded_size(own), own)).otherwise(F.coalesce(measured_size(text), worded_size(text), F.lit("NA")))


def _is_date(core: Column) -> Column:
    """Whether a token is one date or several, by the parts between its separators.

    Day, month and year in numbers or with the month's name, year first or last; a month with a year of this or
    the last century, in either order or written together (MAY2026).
    """
    def kind(part):
        lower = F.lower(part)
        name, year = F.regexp_extract(lower, "^[a-z]*", 0), F.regexp_extract(part, "[0-9]*$", 0)
        century, number = F.substring(year, 1, 2).isin("19", "20"), part.try_cast("int")
        month = number.between(1, 12)
        figures = F.when(F.length(part) == 1, F.when(month, "s").otherwise("z")).when(F.length(part) == 2, F.when(month, "b").otherwise("a")).when(F.length(part) == 3, "c").when(F.length(part) == 4, F.when(century, "y").otherwise("e"))
        named = F.when(name.isin(*MONTH_WORDS), F.when(year == "", "m").when((F.length(year) == 4) & century, "q"))
        return F.coalesce(F.when(part.rlike("^[0-9]+$"), figures), F.when(F.length(name) + F.length(year) == F.length(part), named), F.lit("x"))

    day, any_year = "[szab]", "[abcey]"
    forms = f"{day}(?:m|{day}){any_year}|[ye]{day}{day}|my|q|[sb]y|y[sb]"
    return _coded(F.split(core, r"\s*[-–/.]\s*"), kind).rlike(f"^(?:{forms})+$")


def _is_value(core: Column) -> Column:
    """A number with one sign inside at most, or a code of letters and digits."""
    figures = F.translate(core, ".,", "")
    number = figures.rlike("^[0-9]+$") & (F.length(core) - F.length(figures) <= 1)
    return number | core.rlike("[0-9]") & core.rlike("[A-Za-z]") & (F.regexp_replace(core, "[A-Za-z0-9/.-]", "") == "")


#: Letters of tokens: date, number of six digits or more, other value, word that begins an annotation, other word of one, separator, anything else.
DATE, NUMBER, VALUE, BEGIN, WITHIN, DASH, OTHER = "DNVBWSX"


def _annotation_code(token: Column) -> Column:
    def judged(core):
        words = F.filter(F.split(F.lower(token), "[^a-z]+"), lambda p: p != "")
        inside = lambda w: (F.size(w) > 0) & F.forall(w, lambda p: p.isin(*ANNOTATION_WORDS))
        word = c.let(words, lambda w: F.when(inside(w), F.when(F.exists(w, lambda p: p.isin(*ANNOTATION_STARTS)), BEGIN).otherwise(WITHIN)))
        value = F.when(_is_value(core), F.when((F.length(core) >= 6) & core.rlike("^[0-9]+$"), NUMBER).otherwise(VALUE))
        return F.coalesce(F.when(F.btrim(token, F.lit("-/.,;:()|")) == "", DASH), F.when(_is_date(core), DATE), word, value, F.lit(OTHER))

    return c.let(F.btrim(token, F.lit("().,;:[]{}|")), judged)


def cleaned(raw: Column) -> Column:
    """struct(kept, trimmed): a description without the batch, lot or date annotation at its end, and that annotation or null.

    The annotation begins at the first trigger word or date from which on every token is a label word, value,
    date or separator, at least one of them a value or date. A date takes along numbers of six digits or more
    before it. A description is never emptied: one that is annotation alone stays. Null gives nulls.

    Each token is judged once and becomes a letter; the annotation is then looked for in the letters.
    """
    text = _squeezed(raw)

    def parted(tokens):
        def cut_at(codes):
            tail = F.regexp_extract(codes, f"^(?:.*{OTHER})?([^{OTHER}]*)$", 1)
            body = F.regexp_extract(tail, f"([{BEGIN}{DATE}].*)$", 1)
            found = body.rlike(f"[{DATE}{NUMBER}{VALUE}]")
            before = F.substr(codes, F.lit(1), F.length(codes) - F.length(body))
            taken = F.when(body.startswith(DATE), F.length(F.regexp_extract(before, f"[{NUMBER}{DASH}]*$", 0))).otherwise(0)
            return F.when(found, F.length(before) - taken)

        def made(at):
            kept = F.rtrim(F.array_join(F.slice(tokens, F.lit(1), F.coalesce(at, F.lit(0))), " "), F.lit(" \t\r\n/,-;:|.("))
            cut = F.coalesce(at > 0, F.lit(False)) & (kept != "")
            return F.struct(F.when(cut, kept).otherwise(text).alias("kept"), F.when(cut, F.array_join(F.slice(tokens, F.coalesce(at, F.lit(0)) + 1, F.size(tokens)), " ")).alias("trimmed"))

        return c.let(c.let(_coded(tokens, _annotation_code), cut_at), made)

    # a label glued to its number (Batch:552) is two tokens
    return c.let(F.split(F.regexp_replace(text, r"(?<=[A-Za-z])[.:](?=[0-9])", " "), " "), parted)


def _code_tokens(text: Column) -> Column:
    """Runs of capitals, digits and hyphens."""
    return F.filter(F.transform(F.regexp_extract_all(F.upper(text), F.lit("([A-Z0-9-]+)"), F.lit(1)), lambda x: F.btrim(x, F.lit("-"))), lambda x: x != "")


def _trade_number(token: Column) -> Column:
    """A zero and 12 or 13 more digits."""
    return token.startswith("0") & F.length(token).between(13, 14) & (F.translate(token, "0123456789", "") == "")


def _part_number(token: Column) -> Column:
    """Five characters or more, letters and digits among them."""
    return (F.length(token) >= 5) & token.rlike("[A-Z]") & token.rlike("[0-9]")


def code_only(description: Column) -> Column:
    """Whether a description that isn't empty holds no run of two letters beside item codes and their labels."""
    names = F.exists(_code_tokens(description), lambda x: x.rlike("[A-Z]{2}") & ~_part_number(x) & ~x.isin(*CODE_LABELS))
    return F.coalesce((F.trim(description) != "") & ~names, F.lit(False))


def value_and_unit(cell: Column) -> Column:
    """struct(value, unit) of `12.5 KG`, `KG 12.5` or `1 240,00`; nulls where the cell is anything else."""
    number, unit = r"(\d{1,3}(?:[  ]\d{3})+(?:[.,]\d+)?|\d[\d.,]*)", r"([A-Za-z]{1,8}\.?)"
    text = F.trim(cell)
    behind, before = rf"^{number}\s*{unit}?$", rf"^{unit}\s*{number}$"
    return F.struct(
        F.when(text.rlike(behind), F.regexp_extract(text, behind, 1)).when(text.rlike(before), F.regexp_extract(text, before, 2)).alias("value"),
        F.when(text.rlike(behind), _filled(F.regexp_extract(text, behind, 2))).when(text.rlike(before), F.regexp_extract(text, before, 1)).alias("unit"),
    )


def table_cells(line: Column) -> Column:
    """The cells of a printed table line, without outer bars, blanks and stars."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*+|\*+$", "")))


_COUNTED = frozenset(COUNT_UNITS)


def quantity(cell: str | None) -> tuple[str | None, str | None]:
    """(number, unit) of a cell that is a number, or a number and a unit of count with or without a short bracket behind."""
    if cell and cell.isascii() and cell.isdigit():
        return cell, None
    found = re.fullmatch(r"([0-9]+(?:[.,][0-9]+)*)\s*([^()]*?)\s*(\([^()]{0,24}\))?", (cell or "").strip())
    if not found or found[2] and found[2].upper() not in _COUNTED or found[3] and not found[2]:
        return None, None
    return found[1], found[2] or None


def first_quantity(cells: Sequence[str]) -> tuple[int | None, str | None, str | None]:
    """(place, number, unit): the first number cell with a unit cell after it, else the first cell that is both."""
    read = [quantity(x) for x in cells]
    for i, (number, unit) in enumerate(read[:-1]):
        if number and not unit and number.count(".") + number.count(",") < 2 and cells[i + 1].upper() in _COUNTED:
            return i, number, cells[i + 1]
    return next(((i, number, unit) for i, (number, unit) in enumerate(read) if unit), (None, None, None))


def quantity_cell(cells: Column) -> Column:
    """struct(at, qty, unit): the first number cell with a unit cell after it, else the first merged one (`25 EA (1/EA)`, `6PCS`).

    at counts from 0 and is null without one.
    """
    @F.pandas_udf("struct<at:int,qty:string,unit:string>")
    def found(lines: pd.Series) -> pd.DataFrame:
        rows = [first_quantity(list(x)) if x is not None else (None, None, None) for x in lines]
        return pd.DataFrame({"at": pd.array([r[0] for r in rows], "Int32"), "qty": [r[1] for r in rows], "unit": [r[2] for r in rows]})

    return found(cells)


def identity_tokens(text: Column) -> Column:
    """Distinct trade item numbers and part numbers of a text, in capitals, letters and digits only; those that begin with a letter come before those with a digit."""
    forms = (_trade_number, lambda x: _part_number(x) & x.rlike("^[A-Z]"), lambda x: _part_number(x) & x.rlike("^[0-9]"))
    return c.let(_code_tokens(text), lambda t: F.array_distinct(F.transform(F.concat(*(F.filter(t, form) for form in forms)), lambda x: F.translate(x, "-", ""))))


def net_from_quantity(quantity: Column, unit: Column) -> Column:
    """struct(net decimal(18,3), doubtful): the net weight of a line sold by weight; nulls if its unit is none of mass.

    A unit with a digit in it is a pack size and a blank one means pieces: neither is read. Nor is a weight
    that rounds to nothing.
    """
    text = F.upper(F.trim(unit))
    net = F.round(c.to_kilograms(quantity, text)["kg"], 3).cast("decimal(18,3)")
    stated = (quantity > 0) & ~text.rlike(r"\d") & c.mass_unit(text).isNotNull() & (net > 0)
    return F.struct(F.when(stated, net).alias("net"), F.when(stated, F.regexp_replace(text, "[^A-Z]", "").isin(*DOUBTFUL_UNITS)).alias("doubtful"))


def transport_kind(master: Column, house: Column, lading: Column, authority: Column) -> Column:
    """BL if the authority is a bill of lading or there is only a bill's number, else AWB."""
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    by_sea = (F.upper(F.coalesce(authority, F.lit(""))) == "BILL_OF_LADING") | ~blank(lading) & blank(master) & blank(house)
    return F.when(by_sea, "BL").otherwise("AWB")


def bank_name(terms: Column) -> Column:
    return F.coalesce(_lookup(BANK_NAMES, F.trim(terms)), F.lit("BANK REF"))


def reference_lines(master: Column, house: Column, lading: Column, lading_date: Column, invoices: Column, bank: Column, bank_date: Column, terms: Column, authority: Column) -> Column:
    """The references of a declaration, a line each: transport, invoices (array of struct(number, date), in order), bank.

    A bill of lading takes the place of the air waybill's line on a BL shipment and stands below it otherwise.
    """
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    text = lambda x: F.coalesce(x, F.lit(""))
    bill = F.when(given(lading), F.concat(F.lit("B/L NO:"), lading, F.when(given(lading_date), F.concat(F.lit(" B/L DATE:"), c.day_month_year(lading_date, True))).otherwise("")))
    air = F.when(given(master) | given(house), F.trim(F.concat(F.lit("MAWB NO:"), text(master), F.lit(" HAWB:"), text(house))))
    by_sea = (transport_kind(master, house, lading, authority) == "BL") & (bill.isNotNull() | air.isNull())
    rows = F.transform(invoices, lambda v: F.concat(F.lit("INVOICE NO:"), v["number"], F.lit(" DT: "), c.day_month_year(v["date"], True)))
    paid = F.when(given(bank), F.concat(bank_name(terms), F.lit(":"), bank, F.lit(", DT:"), c.day_month_year(bank_date, True)))
    return F.concat_ws("\n", F.when(~by_sea, air), bill, rows, paid)
