"""A reviewer's log of changes to a job's items, folded in order: what stands at the end, and which changes were refused."""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fields that may be edited, and what a value of theirs must be.
FIELDS = ("description", "quantity", "uom", "total_price", "country_of_origin", "gross_weight", "net_weight", "carton_count")
#: Fields in which an empty value takes the pin away.
PINS = ("gross_weight", "net_weight", "carton_count")
STEP = Decimal("0.01")
LOG = ("seq", "kind", "item_id", "sn", "field", "value", "revision")
ITEMS_OUT = "item_id string, sn int, origin string, fields map<string,string>"
LOG_OUT = "seq long, verdict string, revision int"


class Refused(Exception):
    """A change that is not made; its text is the code."""


def numbers_of(text: str, most: int) -> list[int]:
    """"1-3, 7" or "all" as sorted serial numbers, each from 1 to `most`."""
    text = (text or "").strip().lower()
    if not text:
        raise Refused("SN_RANGE_EMPTY")
    if text == "all":
        return list(range(1, most + 1))
    found: set[int] = set()
    for part in filter(None, map(str.strip, text.split(","))):
        ends = [x.strip() for x in part.split("-")]
        if len(ends) > 2 or not all(x.isascii() and x.isdigit() for x in ends):
            raise Refused("SN_RANGE_INVALID")
        low, high = int(ends[0]), int(ends[-1])
        if low > high:
            raise Refused("SN_RANGE_INVALID")
        if low < 1 or high > most:
            raise Refused("SN_RANGE_OUT_OF_BOUNDS")
        found.update(range(low, high + 1))
    if not found:
        raise Refused("SN_RANGE_EMPTY")
    return sorted(found)


def _decimal(text: str) -> Decimal | None:
    try:
        value = Decimal(text.strip().replace(",", ""))
    except InvalidOperation:
        return None
    return value if value.is_finite() else None


def checked(field: str, value: str | None, held: dict[str, str]) -> str | None:
    """The value to store, None to take a pin away; held: the item's fields."""
    text = (value or "").strip()
    if field not in FIELDS:
        raise Refused("ITEM_FIELD_NOT_EDITABLE")
    if field in PINS and not text:
        return None
    if field == "description":
        if not text:
            raise Refused("DESCRIPTION_REQUIRED")
        return text[:400]
    if field in ("uom", "country_of_origin"):
        return text.upper()[:20] if field == "uom" else text[:80]
    number = _decimal(text)
    if number is None or number <= 0:
        raise Refused(f"{field.upper()}_INVALID")
    if field == "carton_count" and number % STEP:
        raise Refused("CARTON_COUNT_OFF_LATTICE")
    gross = number if field == "gross_weight" else _decimal(held.get("gross_weight", ""))
    net = number if field == "net_weight" else _decimal(held.get("net_weight", ""))
    if field in ("gross_weight", "net_weight") and gross is not None and net is not None and net >= gross:
        raise Refused("NET_NOT_BELOW_GROSS")
    return format(number, "f")


class Job:
    """The items of one job in order, with the reviewer's fields, and the number of changes made."""

    def __init__(self, source: Sequence[str]):
        self.order = list(source)
        self.fields: dict[str, dict[str, str]] = {}
        self.seen = set(source)
        self.revision = 0
        self.derived = False  # whether a change made since the last COMPUTE stales what was derived
        self.added = 0

    def _sn(self, item: str) -> int:
        if item not in self.order:
            raise Refused("ITEM_NOT_FOUND")
        return self.order.index(item) + 1

    def apply(self, kind: str, item: str | None, sn: str | None, field: str | None, value: str | None, revision: int | None) -> None:
        """Makes one change or refuses it whole. revision: the number the reviewer last saw, null: not checked."""
        if revision is not None and revision != self.revision:
            raise Refused("REVISION_STALE")
        if kind == "ADD":
            at = int(sn) if (sn or "").strip().isdigit() else 0
            if not 1 <= at <= len(self.order) + 1:
                raise Refused("INSERTION_SN_OUT_OF_RANGE")
            self.added += 1
            new = item or f"man:{self.added}"
            if new in self.seen:
                raise Refused("ITEM_ID_DUPLICATE")
            self.seen.add(new)
            self.order.insert(at - 1, new)
            if value:
                self.fields[new] = {"description": value.strip()[:400]}
        elif kind == "DELETE":
            if (sn or "").strip() != str(self._sn(item)):
                raise Refused("CONFIRMATION_SN_MISMATCH")
            if len(self.order) == 1:
                raise Refused("LAST_ITEM_UNDELETABLE")
            self.order.remove(item)
            self.fields.pop(item, None)
        elif kind == "EDIT":
            self._sn(item)
            held = self.fields.get(item, {})
            stored = checked(field or "", value, held)
            self.fields[item] = {k: v for k, v in held.items() if k != field} | ({field: stored} if stored is not None else {})
        elif kind == "BULK":
            items = [self.order[n - 1] for n in numbers_of(sn or "", len(self.order))]
            stored = {x: checked(field or "", value, self.fields.get(x, {})) for x in items}  # all or none
            for x, v in stored.items():
                self.fields[x] = {k: y for k, y in self.fields.get(x, {}).items() if k != field} | ({field: v} if v is not None else {})
        elif kind == "COMPUTE":
            self.derived = True
            return
        else:
            raise Refused("KIND_UNKNOWN")
        self.revision += 1
        self.derived = False


def replayed(items: DataFrame, log: DataFrame, job: str) -> DataFrame:
    """job, items (in order, with sn from 1), log (each change's verdict and the revision after it), revision, derived.

    items: job, item_id, place (order in the source). log: job, seq, kind (ADD, DELETE, EDIT, BULK, COMPUTE), item_id, sn, field, value,
    revision. Changes come in the order of seq. One that breaks a rule is refused whole and told by its code; the others
    are OK. derived: whether what was computed from the job still holds, as every change after COMPUTE stales it. Items
    keep their identity, so an overlay survives any order of the rows; a deleted one takes its fields along and never
    comes back. A job's items and log are in one task; jobs without a log or without items are given as well.
    """
    rows = items.groupBy(job).agg(F.array_sort(F.collect_list(F.struct("place", "item_id"))).alias("source"))
    fields = [F.col(c).cast(t).alias(c) for c, t in zip(LOG, ("long", "string", "string", "string", "string", "string", "int"), strict=True)]
    changes = log.select(job, F.struct(*fields).alias("change")).groupBy(job).agg(F.array_sort(F.collect_list("change")).alias("changes"))
    both = rows.join(changes, job, "full")
    kind = items.schema[job].dataType.simpleString()

    def fold(batches):
        for batch in batches:
            keys, out = batch.column(job), {"items": [], "log": [], "revision": [], "derived": []}
            for source, changes_ in zip(batch.column("source").to_pylist(), batch.column("changes").to_pylist(), strict=True):
                own = [x["item_id"] for x in source or []]
                state, told = Job(own), []
                for x in changes_ or []:
                    try:
                        state.apply(*(x[c] for c in LOG[1:]))
                        verdict = "OK"
                    except Refused as refusal:
                        verdict = str(refusal)
                    told.append({"seq": x["seq"], "verdict": verdict, "revision": state.revision})
                first = set(own)
                out["items"].append([{"item_id": x, "sn": n, "origin": "source" if x in first else "manual", "fields": list(state.fields.get(x, {}).items())} for n, x in enumerate(state.order, 1)])
                out["log"].append(told)
                out["revision"].append(state.revision)
                out["derived"].append(state.derived)
            item = pa.struct([("item_id", pa.string()), ("sn", pa.int32()), ("origin", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])
            told = pa.struct([("seq", pa.int64()), ("verdict", pa.string()), ("revision", pa.int32())])
            kinds = (pa.list_(item), pa.list_(told), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=[job, *out])

    inner = lambda text: re.sub(r"(\w+) (?=\w)", r"\1:", text)
    return both.mapInArrow(fold, f"{job} {kind}, items array<struct<{inner(ITEMS_OUT)}>>, log array<struct<{inner(LOG_OUT)}>>, revision int, derived boolean")
