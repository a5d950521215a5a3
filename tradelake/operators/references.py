"""Labelled references on printed pages: registration codes with the party they belong to, bills of lading; empty fields filled from them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import cells as c

# Headings of parties, and words behind a label that are no value.
IMPORTER = ("consignee", "buyer", "importer", "bill to", "billed to", "sold to", "ship to", "messrs", "m/s", "delivery to")
EXPORTER = ("exporter", "shipper", "seller", "supplier", "beneficiary", "manufacturer", "from")
NO_VALUE = frozenset("NO NUMBER CODE N/A NA NIL NONE DATE TBA".split())
NO_LADING = NO_VALUE | frozenset("COPY ORIGINAL SURRENDER TELEX DRAFT".split())
# Labels of a bill of lading by their words, words before and behind them.
LADINGS = (("b/l",), ("bl",), ("bill", "of", "lading"), ("sea", "waybill"), ("seawaybill",), ("mbl",), ("hbl",), ("obl",), ("consignment", "note"), ("lorry", "receipt"), ("railway", "receipt"), ("truck", "receipt"))
ON_BOARD = (("shipped", "on", "board"), ("on", "board"))
CODE_WORDS = frozenset("code no number regd reg".split())
DATE_WORDS = frozenset("date dt dated".split())
#: A heading counts within so many lines and characters before a label.
LINES_BACK, CHARACTERS_BACK = 12, 320
HITS = "page long, line int, kind string, party string, label string, value string, quote string"


class Words:
    """The words of a line, with their places; bars and stars of tables part words as blanks do."""

    def __init__(self, line: str):
        self.line = re.sub(r"[|*]", " ", line)
        self.at = [(m.start(), m.end()) for m in re.finditer(r"\S+", self.line)]
        self.raw = [self.line[a:b] for a, b in self.at]
        self.low = [w.lower().strip(":.#=-(),;") for w in self.raw]

    def label(self, i: int, phrases: Sequence[Sequence[str]]) -> int:
        """Words of the longest of the phrases that begins at i, 0 without; b.l and b/l are one."""
        plain = [w.replace("b.l", "b/l") for w in self.low[i : i + 3]]
        return max((len(p) for p in phrases if tuple(plain[: len(p)]) == tuple(p)), default=0)

    def values(self, i: int) -> list[str]:
        """What stands from word i on, free of signs around it."""
        return [w for w in (x.strip(" .,;:-#=()") for part in self.raw[i:] for x in part.split(":")) if w]


def _code_label(words: Words, i: int) -> int:
    """Words of a registration code's label at i: EXIM or IEC with what follows, IE code, importer-exporter code."""
    low = words.low
    first = low[i].replace(".", "")
    n = 0
    if first in ("exim", "iec"):
        n = 1
        if first == "iec" and low[i + 1 : i + 2] == ["pan"]:  # IEC (PAN based)
            n += 2
    elif first == "ie" and low[i + 1 : i + 2] == ["code"]:
        n = 2
    elif re.fullmatch(r"importer\s*[-/]?\s*exporter", low[i]) and low[i + 1 : i + 2] == ["code"]:
        n = 2
    elif first == "importer" and low[i + 1 : i + 3] == ["exporter", "code"]:
        n = 3
    while n and low[i + n : i + n + 1] and low[i + n] in CODE_WORDS:
        n += 1
    return n


def _value(own: list[str], after: list[str], fits, refused: frozenset[str]) -> str | None:
    """The first value of the label's own line that fits, or of the next line where nothing stands behind the label."""
    for value in own or after:
        if value.upper() not in refused and any(x.isdigit() for x in value) and fits(value):
            return value
    return None


def _party(label: str, before: str) -> str:
    window = before[-CHARACTERS_BACK:].lower()
    place = {party: max(window.rfind(h) for h in headings) for party, headings in (("IMPORTER", IMPORTER), ("EXPORTER", EXPORTER))}
    if max(place.values()) < 0:  # shippers print their own IEC; a buyer's EXIM is printed because it is asked for
        return "EXPORTER" if label.lower().startswith("i") else "IMPORTER"
    return "IMPORTER" if place["IMPORTER"] > place["EXPORTER"] else "EXPORTER"


def _date_in(words: list[str]) -> str | None:
    """The first date of a line: one word, or three with a month's name."""
    for i in range(len(words)):
        if re.fullmatch(r"\d{1,4}[-/.](?:\d{1,2}|[A-Za-z]{3,9})[-/.]\d{2,4}", words[i]):
            return words[i]
        three = words[i : i + 3]
        if len(three) == 3 and any(x[:3].upper() in c.MONTHS and x.isalpha() for x in three[:2]) and sum(x.isdigit() for x in three) == 2:
            return " ".join(three)
    return None


def scan(page: int, text: str | None) -> list[dict]:
    """The labelled references of a page, in order. A label's value stands behind it, else, if its line ends there, on the next line."""
    lines = [Words(x) for x in (text or "").splitlines()]
    out: list[dict] = []
    for n, words in enumerate(lines):
        after = lines[n + 1].values(0) if n + 1 < len(lines) else []
        i = 0
        while i < len(words.raw):
            found = None
            k = _code_label(words, i)
            if k:
                own = words.values(i + k)
                value = _value(own, after, lambda v: v.isalnum() and v.isascii() and 13 <= len(v) <= 15, NO_VALUE) or _value(own, after, lambda v: bool(re.fullmatch("[A-Za-z0-9][A-Za-z0-9-]{6,19}", v)), NO_VALUE)
                label = " ".join(words.raw[i : i + k]).strip(":.#=- ")
                before = "\n".join(x.line for x in lines[max(0, n - LINES_BACK) : n]) + words.line[: words.at[i][0]]
                found = value and ("CODE", _party(label, before), label, value)
            else:
                lading, board = words.label(i, LADINGS), words.label(i, ON_BOARD)
                k = lading or board
                if k and words.low[i + k : i + k + 1] and words.low[i + k] in DATE_WORDS:
                    value = _date_in(words.values(i + k + 1) or after)
                    found, k = value and ("LADING_DATE", "SHIPMENT", "B/L date", value), k + 1
                elif lading:
                    label = " ".join(words.raw[i : i + k]).strip(":.#=- ")
                    while words.low[i + k : i + k + 1] and words.low[i + k] in ("no", "number", ""):
                        k += 1
                    own = words.values(i + k)
                    value = _value(own[:1], after, lambda v: bool(re.fullmatch("[A-Za-z0-9][A-Za-z0-9/-]{3,29}", v)), NO_LADING)
                    found = value and not _date_in([value]) and ("LADING", "SHIPMENT", label, value)
            if found:
                out.append(dict(zip(("page", "line", "kind", "party", "label", "value", "quote"), (page, n, *found, words.line.strip()[:120]), strict=True)))
            i += max(1, k)
    return out


def found_in(pages: DataFrame, document: str) -> DataFrame:
    """document, page, line, kind (CODE, LADING, LADING_DATE), party, label, value, quote of every labelled reference. Null texts have none."""
    kind = pages.schema[document]
    types = (pa.int64(), pa.int32(), *[pa.string()] * 5)
    names = [x.split()[0] for x in HITS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(page, text) for page, text in zip(batch.column("page").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            at = pa.array([i for i, hits in enumerate(rows) for _ in hits], pa.int64())
            flat = [x for hits in rows for x in hits]
            yield pa.RecordBatch.from_arrays([batch.column(document).take(at), *(pa.array([x[c_] for x in flat], t) for c_, t in zip(names, types, strict=True))], names=[document, *names])

    return pages.select(document, F.col("page").cast("long").alias("page"), "text").mapInArrow(work, f"`{document}` {kind.dataType.simpleString()}, {HITS}")


def backfilled(headers: DataFrame, hits: DataFrame, document: str) -> DataFrame:
    """headers with empty importer_code, exporter_code, lading and lading_date filled by a document's first reference of each, and notes.

    Nothing that stands is overwritten; blank is empty. Only lading dates that can be read count. A note for each field filled, in
    the order of the fields: field@page=value.
    """
    fields = {"importer_code": ("CODE", "IMPORTER"), "exporter_code": ("CODE", "EXPORTER"), "lading": ("LADING", "SHIPMENT"), "lading_date": ("LADING_DATE", "SHIPMENT")}
    usable = hits.where((F.col("kind") != "LADING_DATE") | c.parse_date(F.col("value")).isNotNull())
    first = usable.groupBy(document, "kind", "party").agg(F.min(F.struct("page", "line", "value")).alias("hit"))
    wide = first.groupBy(document).agg(*(F.max(F.when((F.col("kind") == k) & (F.col("party") == p), F.col("hit"))).alias(f"_{name}") for name, (k, p) in fields.items()))
    both = headers.join(wide, document, "left")
    empty = lambda name: F.coalesce(F.trim(name), F.lit("")) == ""
    notes = F.array_compact(F.array(*(F.when(empty(name) & F.col(f"_{name}").isNotNull(), F.concat(F.lit(f"{name}@"), F.col(f"_{name}.page"), F.lit("="), F.col(f"_{name}.value"))) for name in fields)))
    others = [x for x in headers.columns if x not in fields]
    return both.select(*others, *(F.when(empty(name), F.col(f"_{name}.value")).otherwise(F.col(name)).alias(name) for name in fields), notes.alias("notes"))
