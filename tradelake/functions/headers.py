"""Which column of a printed table plays which role, by the words of its header cells.

Header cells are folded to plain capitals. Each role lists phrases; a cell is a candidate for every role of which it
holds a phrase. A role takes its best candidate by the preferences below (not the ordered but the shipped quantity,
not the gross but the net amount), and a column wanted by two roles goes to the one named first in ABOVE.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import cells as c, descriptions as d

# Header phrases by role, after folding. "=" is the whole header, "^" its beginning, otherwise whole words within it.
PHRASES = {
    "qty": "QTY QUANTITY QNTY QUANT PCS PIECES NO_OF_PCS NO_OF_PIECES NO_OF_UNITS ^MENGE ^ANZAHL ^STUCKZAHL QUANTITE CANTIDAD QUANTITA ^AANTAL HOEVEELHEID QUANTIDADE ^MIKTAR ^SO_LUONG =JUMLAH KUANTITAS ^ANTAL ^ANTALL ^MAARA ^ILOSC ^MNOZSTVI MENNYISEG CANTITATE ^KOLICINA =CANT =KOL =QTE =HOURS =UNITS",
    "uom": "=UM =U_M =U_OM =UOM =UNIT =UNITS UOM MEASURE ^EINHEIT =STK =UNITE =UNIDAD =UNITA =EENHEID =UNIDADE =BIRIM =DON_VI =SATUAN =ENHET =ENHED =YKS =JM =MJ =ME =EM =MED =JED =BASIS =U =UD =UN",
    "price": "UNIT_PRICE UNIT_COST UNIT_RATE U_PRICE ^PRICE ^RATE ^COST RATE_PER PRICE_EACH PRICE_PER =P_U EINZELPREIS STUCKPREIS ^PREIS PRIX_UNITAIRE ^PRIX PRECIO_UNITARIO ^PRECIO PREZZO_UNITARIO ^PREZZO PRIJS_PER ^PRIJS ^PRECO BIRIM_FIYAT ^FIYAT ^DON_GIA HARGA_SATUAN ENHETSPRIS YKSIKKOHINTA ^CENA EGYSEGAR PRET_UNITAR CIJENA VALOR_UNIT VALOR_UNITARIO ^PU UNIT_CHARGE ^CHARGE PER_HOUR ^TARIF VERRECHNUNGSPREIS",
    "total": "^TOTAL LINE_TOTAL EXT_PRICE EXTENDED_PRICE EXT_AMOUNT EXTENDED_AMOUNT ^AMOUNT ^AMT ^VALUE GROSS_AMOUNT GROSS_VALUE NET_AMOUNT LINE_AMOUNT LINE_VALUE SUB_TOTAL SUBTOTAL FOB_VALUE CIF_VALUE FOB_AMOUNT CIF_AMOUNT EXW_VALUE DAP_VALUE ^BETRAG GESAMTPREIS GESAMTBETRAG ^GESAMT ^MONTANT =IMPORTE =IMPORTO =BEDRAG ^VALOR ^TUTAR ^THANH_TIEN TOTAL_HARGA ^BELOPP BELOP ^YHTEENSA WARTOSC ^CELKEM ^ERTEK VALOARE ^IZNOS",
    "taxable": "TAXABLE ASSESSABLE ASSESSED",
    "desc": "DESCRIPTION DESCR PARTICULAR PARTICULARS COMMODITY GOODS PRODUCT_NAME ITEM_NAME ARTICLE_NAME MATERIAL_NAME TRADE_NAME NATURE_OF_GOODS MERCHANDISE NOMENCLATURE DESIGNATION BEZEICHNUNG BESCHREIBUNG LIBELLE MARCHANDISE MERCANCIA ^ARTICULO OMSCHRIJVING BENAMING ACIKLAMA CINSI BESKRIVELSE BESKRIVNING ^MO_TA TEN_HANG HANG_HOA URAIAN NAMA_BARANG BENAMNING NIMIKE MEGNEVEZES DENUMIRE ^NAZIV ARTIKELNAME SERVICES_RENDERED",
    "model": "MODEL PRODUCT CFN MATERIAL_NUMBER MATERIAL_CODE =MATERIAL PART SKU ARTICLE ITEM_CODE CAT_NO CATALOG_NO CATALOGUE_NO REF PN P_N OEM STYLE DRAWING PATTERN SERIES STOCK_CODE STOCK_NO SPEC_CODE TYPE_NO DESIGN_NO ARTIKEL_NR REFERENCE_NO",
    "brand": "BRAND TRADE_MARK TRADEMARK TRADE_NAME MAKE MAKER VENDOR PRODUCER MANUFACTURER MANUFACTURED_BY",
    "size": "SIZE DIMENSION DIMENSIONS MEASUREMENT DIAMETER CAPACITY VOLUME SPECIFICATION",
    "line_no": "ITEM_NUMBER ITEM_NO LINE SERIAL SERIAL_NO ^S_NO ^SNO ^SL ^SR ^SN =S_N =NO =POS =NR =SIRA =STT =LP =POR =RIVI =LINJE",
    "hs": "HS HS_CODE HSN HTS TARIFF TARIFF_CODE TARIFF_NO CUSTOMS_CODE COMMODITY_CODE GOODS_CODE TARIC CN_CODE CODE_SH CODIGO_SA CODICE_HS GN_CODE =NCM =GTIP MA_HS KODE_HS KOD_CN VAMTARIFA TARIFNI",
    "coo": "COUNTRY_OF_ORIGIN COO ORIGIN MADE_IN",
    "gross_wt": "GROSS_WT GROSS_WEIGHT GROSS_WGT BRUTTO BRUTO BRUT BRUTTOGEWICHT LORDO GW G_W",
    "net_wt": "NET_WT NET_WEIGHT NET_WGT NETT_WEIGHT NETTO NETO NETTOGEWICHT POIDS_NET LIQUIDO NW N_W",
    "wt_any": "^WEIGHT ^WT ^WGT ^MASS ^TOTAL_WEIGHT ^ITEM_WEIGHT ^TTL_WEIGHT",
    "ctn": "CTN CTNS CARTON CARTONS CASE CASES PKG PKGS PACKAGE PACKAGES BOXES PACK PACKS PALLET PALLETS BALES CHESTS DRUMS BUNDLES BAGS ROLLS COILS CRATES SACKS KOLLI KOLI KOLLO PACKSTUCKE COLIS COLLI BULTO BULTOS CAJAS FARDOS",
    "ctn_no": "C_NO CTN_NO CTN_NOS CARTON_NO CARTON_NOS CARTON_NUMBER CASE_NO CASE_NOS BOX_NO PALLET_NO PKG_NO PACKAGE_NO MARKS_NOS MARKS_AND_NOS MARKS_AND_NUMBERS COLLI_NR KOLLI_NR COLIS_NO",
    "pkg_type": "PACKAGE_TYPE PACKING_TYPE PACK_TYPE TYPE_OF_PACKAGE TYPE_OF_PACKING KIND_OF_PACKAGE",
    "batch": "BATCH LOT",
    "expiry": "EXPIRY EXPIRATION EXP_DATE EXP_DT =EXP USE_BY BEST_BEFORE",
}
# Words that qualify a header.
ORDERED, SHIPPED = {"ORDERED", "ORDER", "ORD", "BESTELLT", "COMMANDEE"}, {"SHIPPED", "SHIP", "DELIVERED", "INVOICED", "BILLED", "DESPATCHED", "DISPATCHED", "GELIEFERT", "LIVREE"}
GROSS, NET = {"GROSS", "BRUT", "BRUTO", "BRUTTO", "INCL", "INCLUDING", "TTC"}, {"NET", "NETT", "NETTO", "NETO", "EXCL", "EXCLUDING", "HT"}
DISCOUNTABLE = {"LIST", "CATALOGUE", "CATALOG"}
PACKAGES = set(PHRASES["ctn"].split()) | {"BOX", "PALLET", "KARTON", "DOZEN"}
COUNTED_WITH = {"QTY", "WEIGHT", "WT", "WGT", "MASS", "QUANTITY", "PCS", "PIECES", "UNITS", "ITEMS", "LINES", "CTN", "CTNS", "CARTONS", "CASES", "BOXES", "PACKAGES", "PKGS", "GW", "NW"}
PER_UNIT = {"UNIT", "PER", "EACH"}
# Letters that have no decomposition, and what headers write for them.
LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i", "&": " AND ", "#": " NO "}
MASS_WORDS = {w for words in c.SPELLINGS.values() for w in words.split() if len(w) > 1}
#: Of two roles with one column, the first keeps it.
ABOVE = (
    ("qty", "total"), ("taxable", "total"), ("desc", "model"), ("desc", "line_no"), ("desc", "size"), ("desc", "brand"), ("hs", "desc"), ("hs", "model"), ("price", "net_wt"), ("total", "net_wt"),
    ("taxable", "net_wt"), ("price", "gross_wt"), ("total", "gross_wt"), ("taxable", "gross_wt"), ("price", "wt_any"), ("total", "wt_any"), ("gross_wt", "wt_any"), ("net_wt", "wt_any"), ("qty", "size"), ("uom", "size"),
    ("qty_per_pkg", "qty"), ("qty_per_pkg", "ctn"), ("ctn_no", "ctn"), ("pkg_type", "ctn"), ("uom", "ctn"), ("size", "ctn"), ("qty", "ctn"), ("gross_wt", "ctn"), ("net_wt", "ctn"), ("wt_any", "ctn"), ("price", "ctn"), ("total", "ctn"), ("hs", "ctn"),
    ("price", "uom"), ("batch", "model"), ("brand", "desc"),
)
MAP = "roles map<string,int>, units map<string,string>, uom string, n_cols int"


def folded(cell: str | None) -> str:
    """A header cell in plain capitals: marks and other scripts go, dots and apostrophes close up, other signs part words."""
    text = "".join(LETTERS.get(x, x) for x in cell or "")
    text = "".join(x for x in unicodedata.normalize("NFKD", text) if x.isascii() or x.isspace() or not unicodedata.combining(x))
    text = re.sub(r"[.'’]", "", "".join(x if x.isascii() else " " for x in text).upper())
    return " ".join(re.findall("[A-Z0-9]+", text))


def _phrases(role: str) -> list[tuple[str, str]]:
    return [(p[0], p[1:].replace("_", " ")) if p[0] in "=^" else ("", p.replace("_", " ")) for p in PHRASES[role].split()]


_BY_ROLE = {role: _phrases(role) for role in PHRASES}


def _holds(text: str, role: str) -> bool:
    padded = f" {text} "
    return any(text == p if sign == "=" else padded.startswith(f" {p} ") if sign == "^" else f" {p} " in padded for sign, p in _BY_ROLE[role])


def _readings(cell: str | None) -> list[str]:
    """The folded cell, and the halves of a bilingual one (parted by a slash with spaces)."""
    halves = re.split(r"\s/\s", cell or "")
    return [x for x in dict.fromkeys([folded(cell), *(map(folded, halves) if len(halves) > 1 else [])]) if x]


def _candidate(text: str, role: str) -> bool:
    words = set(text.split())
    if not _holds(text, role):
        return False
    if role == "qty":  # a number of packages, or a number in each of them, is no quantity of goods
        return not words & PACKAGES or bool(words & {"PCS", "PIECES"} and not words & PER_UNIT)
    if role == "total":
        return not (words & COUNTED_WITH and words & {"TOTAL", "GROSS", "NET"})
    if role in ("gross_wt", "net_wt", "wt_any"):
        return not words & PER_UNIT
    if role == "desc":
        return "CODE" not in words
    if role == "brand":
        return not words & {"PART", "MODEL", "CODE", "NUMBER", "NO"}
    return True


def _per_package(text: str) -> bool:
    """Quantity in each package: QTY CTN, QTY PER CARTON, PCS/CTN."""
    words = text.split()
    return bool(set(words) & {"QTY", "QUANTITY", "PCS", "PIECES", "UNITS"} and set(words) & PACKAGES and "NO" not in words and words[0] not in PACKAGES | {"TOTAL"})


def _preference(role: str, text: str, also: set[str]) -> tuple:
    """Smaller is better; the place in the row decides between equals."""
    words = set(text.split())
    if role == "qty":
        return ("uom" in also, bool(words & ORDERED), not words & SHIPPED if words & (ORDERED | SHIPPED) else False)
    if role in ("price", "total"):
        return (bool(words & GROSS), bool(words & DISCOUNTABLE) and not words & NET)
    if role == "ctn":
        return ("ctn_no" in also, "pkg_type" in also)
    return ()


def header_roles(cells: list[str], packing: bool = False) -> dict | None:
    """Roles and their columns of a header row, or None if it is none.

    A header has a description and a quantity; on a packing list a number of cartons or a weight will do. Roles that
    no column plays are left out. units: mass units that weight headers name; uom: the unit that the quantity's header names.
    """
    readings = [_readings(x) for x in cells]
    texts = [r[0] if r else "" for r in readings]
    wanted = {role: [i for i, rs in enumerate(readings) if any(_candidate(x, role) for x in rs)] for role in PHRASES}
    per_package = [i for i, x in enumerate(texts) if _per_package(x)]
    counts = [i for i in wanted["ctn"] if i not in per_package and i not in wanted["ctn_no"]]
    # a header that may be a number of packages is a rate only beside one that counts them, or where it says so
    wanted["qty_per_pkg"] = [i for i in per_package if counts or "PER" in texts[i].split()]
    wanted["ctn"] = [i for i in wanted["ctn"] if i not in wanted["qty_per_pkg"]]
    wanted["qty"] = [i for i in wanted["qty"] if i not in wanted["qty_per_pkg"]]
    for i, text in enumerate(texts):  # what names a unit of mass is a weight, and other money never is
        words = set(text.split())
        massive = words & MASS_WORDS and words & (NET | GROSS)
        for role in ("total", "price", "taxable"):
            if massive and i in wanted[role]:
                wanted[role].remove(i)
        for role, signs in (("net_wt", NET), ("gross_wt", GROSS)):
            if massive and words & signs and i not in wanted[role]:
                wanted[role].append(i)
            if i in wanted[role] and any(i in wanted[x] for x in ("total", "price", "taxable")):
                wanted[role].remove(i)
    also = [{role for role, at in wanted.items() if i in at} for i in range(len(cells))]
    order = {role: sorted(at, key=lambda i: (*_preference(role, texts[i], also[i]), i)) for role, at in wanted.items()}
    roles = {role: at[0] for role, at in order.items() if at}
    if "total" in roles and roles.get("price", roles["total"]) == roles["total"]:  # two amounts: the rate stands first
        later = [i for i in sorted(wanted["total"]) if i > roles["total"] and not set(texts[i].split()) & GROSS]
        if later:
            roles["price"], roles["total"] = roles["total"], later[0]
    for _ in ABOVE:  # a column taken away may free the next candidate, which may be taken as well
        moved = False
        for winner, loser in ABOVE:
            if winner in roles and roles.get(loser) == roles[winner]:
                rest = [i for i in order.get(loser, []) if i not in roles.values()]
                roles.pop(loser)
                if rest and loser in ("qty", "ctn", "total", "model"):
                    roles[loser] = rest[0]
                moved = True
        if not moved:
            break
    if "desc" not in roles or not ("qty" in roles or packing and roles.keys() & {"ctn", "gross_wt", "net_wt", "wt_any"}):
        return None
    named = lambda role: next((w for w in texts[roles[role]].split() if w in MASS_WORDS), None)
    units = {role: named(role) for role in ("gross_wt", "net_wt", "wt_any") if role in roles and named(role)}
    uom = None
    if "qty" in roles and "uom" not in roles:
        uom = next((w for w in texts[roles["qty"]].split() if w in d.COUNT_UNITS), None)
    return {"roles": roles, "units": units, "uom": uom, "n_cols": len(cells)}


@lru_cache(maxsize=1 << 14)
def _known(cells: tuple[str, ...], packing: bool) -> dict | None:
    """header_roles of headers met before: vendors print the same ones on all their pages."""
    return header_roles(list(cells), packing)


def could_be_header(cells: Column) -> Column:
    """Three cells or more, words in two at least, and none in which a digit stands before any letter, as in numbers, quantities and ranges."""
    words = F.filter(cells, lambda x: x.rlike("[A-Za-z]|[^\\x00-\\x7F]"))
    return F.coalesce((F.size(cells) >= 3) & (F.size(words) >= 2) & ~F.exists(cells, lambda x: x.rlike("^[^A-Za-z]*[0-9]")), F.lit(False))


def with_roles(lines: DataFrame, packing: bool = False, every: bool = False) -> DataFrame:
    """Lines (with cells) that could be a header, with roles, units, uom and n_cols; nulls where they make none. every: the other lines too, with nulls."""
    rows = lines.withColumn("_could", could_be_header(F.col("cells")))
    rows = rows if every else rows.where("_could")
    names = lines.columns
    kinds = (pa.map_(pa.string(), pa.int32()), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            could = batch.column("_could")
            found: list[dict] = [{}] * batch.num_rows
            for i, x in zip(pc.indices_nonzero(could).to_pylist(), batch.column("cells").filter(could).to_pylist(), strict=True):
                found[i] = _known(tuple(x), packing) or {}
            pairs = lambda k: [list(x[k].items()) if k in x else None for x in found]
            values = (pairs("roles"), pairs("units"), [x.get("uom") for x in found], [x.get("n_cols") for x in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=[*names, "roles", "units", "uom", "n_cols"])

    return rows.mapInArrow(read, f"{_of(lines)}, {MAP}")


# --- rows under a header

_PLAIN = re.compile(r"[0-9]+(?:\.[0-9]+)?").fullmatch


@lru_cache(maxsize=1 << 16)
def amount(raw: str | None, eu: bool = False) -> Decimal | None:
    """A printed amount, read as cells.parse_decimal reads it (held against the same values in the tests), for use row by row."""
    text = (raw or "").strip(" ")
    if not eu and _PLAIN(text):
        return Decimal(text)
    found = re.search("[0-9](?:.*[0-9])?", text, re.DOTALL)
    if not found:
        return None
    lead, parts = text[: found.start()], re.sub(r"[^0-9\s.,-]", "", found[0]).split()
    if len(parts) > 1:
        last = re.split("[.,]", parts[-1])
        if not (len(parts[0]) <= 3 and parts[0].isdigit() and all(len(x) == 3 and x.isdigit() for x in parts[1:-1]) and len(last[0]) == 3 and (len(last) == 1 or len(last) == 2 and 1 <= len(last[1]) <= 2)):
            return None
    number = ("0." if re.search(r"(?:^|[^A-Za-z])\.$", lead) else "") + "".join(parts)
    if not re.fullmatch("[0-9.,]+", number):
        return None
    groups, signs = re.split("[.,]", number), re.sub("[0-9]", "", number)
    dots, commas, tail = signs.count("."), signs.count(","), len(groups[-1])
    even = 1 <= len(groups[0]) <= 3 and all(len(x) == 3 for x in groups[1:-1])
    whole = "".join(groups)
    if commas == 1 and signs[-1] == "," and tail <= (6 if eu and even else 2) or len(signs) > 1 and not (dots and commas) and even and tail == 2:
        number = f"{whole[: len(whole) - tail]}.{groups[-1]}"
    elif not dots or not commas and even and tail == 3 and (eu or len(signs) > 1):
        number = whole
    elif dots == 1:
        number = number.replace(",", "")
    else:
        return None
    value = Decimal(number)
    return -value if (text.startswith("(") and text.endswith(")")) != ("-" in lead) else value


def weight_unit(cell: str | None) -> str | None:
    """The unit printed with a number before or behind it, "" without one; null where the cell is anything else."""
    text = (cell or "").strip()
    if _PLAIN(text):
        return ""
    found = re.fullmatch(r"([A-Za-z]{1,8}\.?)?\s*[0-9][0-9., \u00a0\u202f]*\s*([A-Za-z]{1,8}\.?)?", text)
    return None if not found or found[1] and found[2] else (found[1] or found[2] or "")


def packages(cell: str | None) -> int | None:
    """Packages that carton numbers name: 1-5, 8 and 10 are seven; a part is a range only behind a word for packages or none."""
    total = 0
    for part in re.split("[,;]", re.sub(r"(?i)\s(and|&)\s", ",", cell or "").upper()):
        ends = re.search(r"([0-9]+)\s*(?:-|–|—|THROUGH|THRU|TO)\s*([0-9]+)\s*$", re.sub("N0(?![0-9])", "NO", part))
        word = re.sub(r"[ /.#\t]", "", re.sub("N0(?![0-9])", "NO", part)[: ends.start()]) if ends else None
        if ends and (not word or word in c.PACKAGE_WORDS):
            total += max(0, int(ends[2]) - int(ends[1]) + 1)
        else:
            total += bool(re.search("[0-9]", part))
    return total or None


_COUNTED = frozenset(d.COUNT_UNITS)
quantity = d.quantity


def realigned(cells: list[str], roles: dict[str, int], n_cols: int, eu: bool = False) -> list[str] | None:
    """A row that is short by one or two cells with a blank put in where its own numbers prove it, else None.

    Every inner place is tried, the row being filled up at its end. One fits if quantity per package x packages =
    quantity, the description has words, and a filled unit cell holds a unit. It counts only as the single one to fit.
    """
    proved = [roles.get(x) for x in ("qty_per_pkg", "ctn", "qty")]
    if None in proved or not 1 <= n_cols - len(cells) <= 2:
        return None
    hits = []
    for k in range(1, len(cells) + 1):
        row = [*cells[:k], "", *cells[k:], *[""] * (n_cols - len(cells) - 1)]
        rate, boxes, qty = (amount(row[i], eu) for i in proved)
        unit = row[roles["uom"]].strip() if "uom" in roles else ""
        good = all(x is not None and x > 0 for x in (rate, boxes, qty)) and (rate * boxes).quantize(CENT, ROUND_HALF_UP) == qty.quantize(CENT, ROUND_HALF_UP)
        if good and ("desc" not in roles or re.search("[A-Za-z]{2}", row[roles["desc"]])) and (not unit or unit.upper() in _COUNTED):
            hits.append(row)
    return hits[0] if len(hits) == 1 else None


@lru_cache(maxsize=1 << 12)
def _header(text: str) -> dict:
    """roles, units and uom of a header as told(...) prints it: those of one document are all the same."""
    return json.loads(text)


def told(*names: str) -> Column:
    """A header's columns as one text, which lines hand to Python in the place of maps."""
    return F.to_json(F.struct(*names))


def _of(lines: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)


def put_right(lines: DataFrame) -> DataFrame:
    """Lines with `shift`: NONE, REALIGNED (cells are those put right), or SHORT (by one or two cells, and no single place proved)."""
    short = F.coalesce((F.col("n_cols") - F.size("cells")).between(1, 2), F.lit(False))
    asked = lines.withColumn("_short", short).withColumn("_h", F.when(F.col("_short") & F.col("roles").isNotNull(), told("roles", "n_cols")))
    names = lines.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right: list = [None] * batch.num_rows
            some = batch.column("_h").is_valid()
            for i, row, header in zip(pc.indices_nonzero(some).to_pylist(), batch.column("cells").filter(some).to_pylist(), batch.column("_h").filter(some).to_pylist(), strict=True):
                right[i] = realigned(row, _header(header)["roles"], _header(header)["n_cols"])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in (*names, "_short")), pa.array(right, pa.list_(pa.string()))], names=[*names, "_short", "_right"])

    out = asked.mapInArrow(work, f"{_of(lines)}, _short boolean, _right array<string>")
    shift = F.when(F.col("_right").isNotNull(), "REALIGNED").when(F.col("_short"), "SHORT").otherwise("NONE")
    return out.select(*(F.coalesce("_right", x).alias(x) if x == "cells" else F.col(f"`{x}`") for x in lines.columns), shift.alias("shift"))


# Words of totals lines.
TOTALS_WORDS = "TOTAL TOTALS TOTAAL TOTALE TOTAUX TOTALT SUBTOTAL SOMME SUMME SUMA GESAMT GESAMTBETRAG GESAMTSUMME ENDBETRAG NETTOBETRAG TOPLAM GENEL TONG CONG JUMLAH IMPORTE RAZEM CELKEM OSSZESEN UKUPNO SKUPAJ LOPPUSUMMA YHTEENSA".split()
TOTALS_WITH = "GRAND SUB NET GROSS PAGE OF THE THIS AMOUNT VALUE WEIGHT WT QTY QUANTITY CARTONS CTNS PACKAGES PKGS INVOICE CIF FOB USD EUR KGS KG PCS IN".split()


def totals_label(cell: str | None) -> bool:
    """Whether a cell is a totals line's label: a totals word and at most words that go with it."""
    words = set(re.findall("[A-Z]+", (cell or "").upper()))
    return bool(words & _TOTALS) and words <= _TOTALS | set(TOTALS_WITH)


_TOTALS = set(TOTALS_WORDS)
_FACTORS = {word: Decimal(c.KILOGRAMS[code]) for code, words in c.SPELLINGS.items() for word in words.split()}


@lru_cache(maxsize=1 << 12)
def _factor(unit: str) -> Decimal | None:
    """Kilograms of a printed unit, None where it isn't known."""
    return _FACTORS.get(re.sub("[^A-Z]", "", unit.upper()))


CENT, HALF_CENT, GRAM = Decimal("0.01"), Decimal("0.005"), Decimal("0.001")


class Row:
    """The cells of a line by role."""

    def __init__(self, line: dict):
        self.line, self.roles = line, line["roles"] if isinstance(line["roles"], dict) else dict(line["roles"])
        self._printed: tuple | None = None

    def text(self, role: str) -> str | None:
        i, cells = self.roles.get(role), self.line["cells"]
        return (cells[i] or "").strip() or None if i is not None and i < len(cells) else None

    def number(self, role: str) -> Decimal | None:
        return amount(self.text(role))

    def quantity(self) -> Decimal | None:
        return amount(self.printed()[0])

    def printed(self) -> tuple[str | None, str | None]:
        """The quantity's number and unit as its cell prints them."""
        if self._printed is None:
            self._printed = quantity(self.text("qty"))
        return self._printed

    def description(self) -> str | None:
        """The goods' name, None where the line has none."""
        text = self.text("desc")
        return text if text and re.search("[A-Za-z]{2}", text) and not totals_label(text) else None

    def unit(self) -> str | None:
        unit = self.printed()[1] or self.text("uom") or self.line["uom"]
        return unit and unit.upper()

    def weight(self, role: str) -> Decimal | None:
        """Kilograms; a printed unit that isn't known gives none."""
        value, unit = self.number(role), weight_unit(self.text(role))
        if value is None or unit is None:
            return None
        factor = _factor(unit or dict(self.line["units"] or {}).get(role) or "KG")
        return None if factor is None else (value * factor).quantize(GRAM, ROUND_HALF_UP)


def packing_row(line: dict) -> dict | None:
    """description, qty, unit, gross, net, weight (kg), cartons, carton_no of a packing list's line, None where it is no goods row.

    Columns are read by their header alone. Cartons are the count column's, else quantity by quantity per package
    if that is whole, else the number of packages that the carton numbers name.
    """
    row = Row(line)
    name, qty, each = row.description(), row.quantity(), row.number("qty_per_pkg")
    gross, net, weight = (row.weight(x) for x in ("gross_wt", "net_wt", "wt_any"))
    cartons = row.number("ctn")
    if cartons is None and qty is not None and each and each > 0 and qty % each == 0:
        cartons = qty / each
    if cartons is None:
        named = packages(row.text("ctn_no"))
        cartons = None if named is None else Decimal(named)
    if name is None or all(x is None for x in (qty, gross, net, weight, cartons)):
        return None
    return {"description": name, "qty": qty, "unit": row.unit(), "gross": gross, "net": net, "weight": weight, "cartons": None if cartons is None else cartons.quantize(CENT, ROUND_HALF_UP), "carton_no": row.text("ctn_no")}


def invoice_row(line: dict) -> dict | None:
    """description, qty, unit, price, total, derived of an invoice's line, None where its own numbers don't confirm it.

    Quantity x price must meet the amount, or the taxable value, within half a cent a piece and a cent. The taxable
    value is the line's total where both are printed. Where they don't meet but another number of the row meets the printed
    quantity, the columns are misread and the row is none; otherwise, if amount by price is whole, that is the quantity (derived).
    """
    row = Row(line)
    name, printed, price = row.description(), row.quantity(), row.number("price")
    product_value, taxable = row.number("total"), row.number("taxable")
    total = product_value if taxable is None else taxable
    if name is None or not printed or printed <= 0 or not total or total <= 0:
        return None
    qty = printed
    if price is not None:
        near = lambda v: v is not None and abs(printed * price - v) <= printed * HALF_CENT + CENT
        if not near(product_value) and not near(taxable):
            others = {amount(x) for x in line["cells"] if not re.search("[A-Za-z]", x)} - {None, printed, price, product_value, taxable}
            if price <= 0 or not product_value or product_value <= 0 or product_value % price or any(v > 0 and near(v) for v in others):
                return None
            qty = product_value / price
    return {"description": name, "qty": qty, "unit": row.unit(), "price": price, "total": total, "derived": qty != printed}


_NUMBER = pa.decimal128(18, 4)
PACKING = {"description": pa.string(), "qty": _NUMBER, "unit": pa.string(), "gross": pa.decimal128(18, 3), "net": pa.decimal128(18, 3), "weight": pa.decimal128(18, 3), "cartons": pa.decimal128(18, 2), "carton_no": pa.string()}
INVOICE = {"description": pa.string(), "qty": _NUMBER, "unit": pa.string(), "price": _NUMBER, "total": _NUMBER, "derived": pa.bool_()}


#: By precision and scale: where a number is too large for a column, and the least step in it.
_LIMITS = {(18, k): (Decimal(10) ** (17 - k), Decimal(1).scaleb(-k)) for k in range(18)}


def _fitted(value, kind: pa.DataType):
    """A decimal rounded to its column's places, null where it is too large for it."""
    if not isinstance(value, Decimal):
        return value
    limit, unit = _LIMITS[kind.precision, kind.scale]
    return value.quantize(unit, ROUND_HALF_UP) if abs(value) < limit else None


def rows_of(lines: DataFrame, invoice: bool) -> DataFrame:
    """Lines under their header that are goods rows, with what the row's cells say, without the cells."""
    judge, kinds = (invoice_row, INVOICE) if invoice else (packing_row, PACKING)
    used = [x for x in ("roles", "units", "uom") if x in lines.columns]
    kept = [f for f in lines.schema.fields if f.name not in ("cells", "roles", "units", "uom", "n_cols")]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge({"units": None, "uom": None} | _header(head) | {"cells": row}) for row, head in zip(batch.column("cells").to_pylist(), batch.column("_h").to_pylist(), strict=True)]
            at = pa.array([i for i, x in enumerate(found) if x is not None], pa.int64())
            values = [pa.array([_fitted(x[k], t) for x in found if x is not None], t) for k, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(at) for f in kept), *values], names=[*(f.name for f in kept), *kinds])

    of = lambda t: f"decimal({t.precision},{t.scale})" if pa.types.is_decimal(t) else "boolean" if pa.types.is_boolean(t) else "string"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{k} {of(t)}" for k, t in kinds.items())])
    return lines.select(*(f"`{f.name}`" for f in kept), "cells", told(*used).alias("_h")).mapInArrow(decide, schema)
