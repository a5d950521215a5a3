"""Segments, attribution, cartons, bounded shares, matches with a margin and overlays against slow versions and hand values."""

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tradelake.functions.segments import segments, unglued, with_segments
from tradelake.operators import apportion as a
from tradelake.operators.attribution import attributed
from tradelake.operators.matching import with_margin
from tradelake.operators.overlay import replayed

LANDS = frozenset({"ireland", "mexico", "united states"})
CELLS = {
    "STENT RX40034X ONYX Batch: 0013039750 6 EA COO: Ireland": ["P:STENT RX40034X ONYX", "A:Batch: 0013039750 6 EA COO: Ireland"],
    "Soap AL10Batch:552 COO:Ireland": ["P:Soap AL10", "A:Batch: 552 COO: Ireland"], "BATCH MIXER 400 Job Lot": ["P:BATCH MIXER 400 Job Lot"], "232720182 3 EA Catheter 6F": ["A:232720182 3 EA", "P:Catheter 6F"],
    "Made in Mexico CATHETER LA 6F": ["A:Made in Mexico", "P:CATHETER LA 6F"], "PIPE123456": ["P:PIPE123456"], "Widget Lot No: 12, 13 / EXP 2026-01 (QTY) 5 EA Gauze": ["P:Widget", "A:Lot No: 12, 13 / EXP 2026-01 (QTY) 5 EA", "P:Gauze"],
    "Made in Atlantis pot": ["P:Made in Atlantis pot"], "Cotton BATCH / EXPIRY DATE: 1234 Made in United States Tariff Code": ["P:Cotton", "A:BATCH / EXPIRY DATE: 1234 Made in United States", "P:Tariff Code"],
    "CATHETER123456789 Lot: 5": ["P:CATHETER 123456789", "A:Lot: 5"], "Batch:": ["A:Batch:"], "": [], None: [],
}


def test_segments(spark):
    for cell, want in CELLS.items():
        text, parts = segments(cell, LANDS)
        assert [f"{k[0]}:{x}" for k, _, _, x in parts] == want
        assert "".join(text[i:j] for _, i, j, _ in parts) == text
        assert text.replace(" ", "") == "".join((cell or "").split())
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(CELLS)], "i int, x string")
    rows = with_segments(rows, "x", "s", list(LANDS)).orderBy("i").collect()
    assert [[f"{p.kind[0]}:{p.text}" for p in r.s.segments] for r in rows] == list(CELLS.values())


def test_unglue_only_adds_spaces():
    rng = random.Random(3)
    pieces = ["AL10", "Batch:", "batch", "Lot#", ":", "5", "COO:", "Ireland", " ", "PIPE", "1234567", "(", "EA", "x", "Serial", "#"]
    for _ in range(2000):
        text = "".join(rng.choices(pieces, k=rng.randrange(0, 9)))
        assert unglued(text).replace(" ", "") == text.replace(" ", "")
        out, parts = segments(text, LANDS)
        assert "".join(out[i:j] for _, i, j, _ in parts) == out


MOVES = [(1, "AB100X", "Bolt AB100X Batch: 77 4 EA Valve CD200Y", 4), (1, "CD200Y", "CD200Y", 4), (1, None, None, None)]
REFUSED = [
    [(1, "AB100X", "Bolt AB100X Lot: 7 Valve CD200Y", 4), (1, "CD200Y", "Valve of its own CD200Y", 4)],  # has a name
    [(1, "AB100X", "Bolt AB100X Lot: 7 Valve CD200Y", 4), (3, "CD200Y", "CD200Y", 4)],  # two pages off
    [(1, "AB100X", "Bolt AB100X Lot: 7 Valve CD200Y", 4), (1, "CD200Y", "CD200Y", 4), (1, "CD200Y", "CD200Y", 4)],  # two rows of that model
    [(1, "AB100X", "Valve CD200Y Lot: 7 Bolt AB100X", 4), (1, "CD200Y", "CD200Y", 4)],  # against the order
    [(1, "AB100X", "Bolt AB100X Lot: 7 Valve CD200Y", 4), (1, "EF300Z", "Pump EF300Z Lot: 7 Rod CD200Y", 4), (1, "CD200Y", "CD200Y", 4)],  # claimed twice
    [(1, "ZZ999Z", "Bolt AB100X Lot: 7 Valve CD200Y", 4), (1, "CD200Y", "CD200Y", 4)],  # no run of its own
]
NAMELESS = [(1, "EF300Z", "", 5), (1, "GH400W", "GH400W", 5), (1, "AB100X", "Batch: 12 3 EA Bolt AB100X", 2)]
LINES = [(1, "Copper pipe EF300Z Lot: 7 5 EA"), (1, "Thank you"), (9, "Rod GH400W")]


def test_attribution(spark):
    documents = [MOVES, *REFUSED, NAMELESS, NAMELESS]
    rows = [(doc, i, p, m, x, None if q is None else Decimal(q)) for doc, rs in enumerate(documents) for i, (p, m, x, q) in enumerate(rs, 1)]
    lines = [(7, *x) for x in LINES] + [(8, *x) for x in [*LINES, (2, "Copper tube EF300Z")]]
    table = spark.createDataFrame(rows, "doc long, row long, page long, model string, description string, qty decimal(18,4)")
    got = {}
    for r in attributed(table, spark.createDataFrame(lines, "doc long, page long, text string"), "doc", list(LANDS)).orderBy("doc", "row").collect():
        got.setdefault(r.doc, []).append((r.description, r.change, r.confirmed))
    assert got[0] == [("Bolt AB100X", "GAVE", False), ("Valve CD200Y", "RECEIVED", True), ("", "NONE", False)]
    for doc, rows in enumerate(REFUSED, 1):
        assert got[doc][0] == (rows[0][2], "UNRESOLVED", False)
        assert all(text == row[2] for (text, _, _), row in zip(got[doc], rows))
    assert got[7] == [("Copper pipe EF300Z", "HARVESTED", True), ("GH400W", "MISSING", False), ("Bolt AB100X", "LEAD_CUT", False)]
    assert got[8][0] == ("", "MISSING", False)  # two lines name its model


# --- cartons and shares


def hamilton(total, basis):
    weights = basis if sum(basis) > 0 else [1] * len(basis)
    ideal = [Fraction(total) * w / sum(weights) for w in weights]
    out = [int(x) for x in ideal]
    for i in sorted(range(len(out)), key=lambda i: (out[i] - ideal[i], i))[: total - sum(out)]:
        out[i] += 1
    return out


def floored(total, basis, floors):
    out = hamilton(total, basis)
    if any(x < f for x, f in zip(out, floors)):
        out = [f + x for f, x in zip(floors, hamilton(total - sum(floors), basis))]
    return out


def slow_cartons(total, basis, pins, printed):
    n = len(basis)
    free = [i for i in range(n) if pins[i] is None]
    pinned = sum(p for p in pins if p is not None)
    if not free:
        return pins, "OK" if pinned == total else "PINS_MISS_TOTAL"
    if len(free) < n and total - pinned < len(free):
        return [1 if p is None else p for p in pins], "PINS_EXCEED"
    if total < n:
        return [1] * n if len(free) == n else [1 if p is None else p for p in pins], "TOO_SMALL"
    base = floored(total, basis, [1] * n)
    out = [b if p is None else p for b, p in zip(base, pins)]
    taken = sum(p - b for b, p in zip(base, pins) if p is not None)
    left = taken
    guesses = sorted((i for i in free if printed[i] is None), key=lambda i: (-base[i], i))
    if taken > 0 and guesses:
        room = [i for i in guesses if base[i] > 1]
        k = min(10, len(room), taken)
        while k < len(room) and sum(base[i] - 1 for i in room[:k]) < taken:
            k += 1
        take = min(taken, sum(base[i] - 1 for i in room[:k]))
        if take:
            for i, m in zip(room[:k], hamilton(take, [base[i] - 1 for i in room[:k]])):
                out[i] -= m
        left -= take
    elif taken < 0 and guesses:
        chosen = guesses[: min(10, -taken)]
        for i, m in zip(chosen, hamilton(-taken, [base[i] for i in chosen])):
            out[i] += m
        left = 0
    stated = [i for i in free if printed[i] is not None]
    if left:
        target = sum(base[i] for i in stated) - left
        if not stated or target < len(stated):
            return out, "PINS_EXCEED"
        for i, x in zip(stated, floored(target, [base[i] for i in stated], [1] * len(stated))):
            out[i] = x
    return out, "OK"


def test_cartons_by_slow_version(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for job in range(1500):
        n = rng.randrange(1, 25)
        basis = [rng.choice([0, 1, 5, 40, 300]) if job % 3 else rng.randrange(1, 60) for _ in range(n)]
        total = rng.choice([rng.randrange(0, 30), rng.randrange(n, 400), rng.randrange(1000, 90_000)])
        share = rng.choice([0, 0.2, 0.6, 1])
        pins = [rng.choice([1, 5, 80, total // n + rng.randrange(0, 9)]) if rng.random() < share else None for _ in range(n)]
        printed = [rng.randrange(1, 99) if rng.random() < rng.choice([0, 0.5, 1]) else None for _ in range(n)]
        rows += [(job, i, basis[i], total, pins[i], printed[i]) for i in range(n)]
        want[job] = slow_cartons(total, basis, pins, printed)
    df = spark.createDataFrame(rows, "job long, i long, basis long, total long, pin long, printed long")
    got = {}
    for r in sorted(a.cartons(df, ["job"], ["i"], "basis", "total", "pin", "printed", "units").collect(), key=lambda r: (r.job, r.i)):
        got.setdefault(r.job, ([], r.verdict))[0].append(r.units)
    wrong = [(j, got[j], want[j]) for j in want if (got[j][0], got[j][1]) != (list(want[j][0]), want[j][1])]
    assert not wrong, wrong[:3]
    ok = {r[0]: r[3] for r in rows if want[r[0]][1] == "OK"}
    assert len(ok) > 400 and all(sum(got[j][0]) == total for j, total in ok.items())


def test_bounds(spark):
    rng = random.Random(7)
    rows, jobs = [], {}
    for job in range(4000):
        n = rng.randrange(1, 9)
        basis, floors = [rng.randrange(0, 50) for _ in range(n)], [rng.choice([0, 0, 1, 7]) for _ in range(n)]
        caps = [rng.choice([None, rng.randrange(0, 60)]) for _ in range(n)]
        jobs[job] = (rng.randrange(0, 160), basis, floors, caps)
        rows += [(job, i, basis[i], jobs[job][0], floors[i], caps[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "job long, i long, basis long, total long, floor long, cap long")
    got = {}
    for r in sorted(a.with_bounds(df, ["job"], ["i"], "basis", "total", "floor", "cap", "share").collect(), key=lambda r: (r.job, r.i)):
        got.setdefault(r.job, []).append(r.share)
    split = 0
    for job, (total, basis, floors, caps) in jobs.items():
        held, want = {}, None
        while sum(floors) <= total and len(held) < len(basis):  # pass by pass
            free = [i for i in range(len(basis)) if i not in held]
            shares = floored(total - sum(held.values()), [basis[i] for i in free], [floors[i] for i in free])
            over = [i for i, x in zip(free, shares) if caps[i] is not None and x > caps[i]]
            if not over:
                want = [held.get(i) if i in held else shares[free.index(i)] for i in range(len(basis))]
                break
            if any(caps[i] < floors[i] for i in over):
                break
            held |= {i: caps[i] for i in over}
        assert got[job] == (want or [None] * len(basis)), (job, jobs[job])
        if want:
            split += 1
            assert sum(want) == total and all(f <= x and (c is None or x <= c) for x, f, c in zip(want, floors, caps))
    assert split > 1500


def test_margin(spark):
    rng = random.Random(5)
    rows = [(job, l, r, rng.choice([None, *range(30, 100)])) for job in range(300) for l in range(rng.randrange(1, 6)) for r in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "job long, l long, r long, score long")
    got = {(x.job, x.l): (x.r, x.score, x.verdict, x.confidence) for x in with_margin(df, "job", "l", "r", "score", 8, 90).collect()}
    want = {}
    for job in range(300):
        pairs = sorted(((-s, l, r) for j, l, r, s in rows if j == job and s is not None))
        taken, done = set(), {}
        for s, l, r in pairs:
            if l in done or r in taken:
                continue
            rivals = [-s2 for s2, l2, r2 in pairs if l2 == l and r2 != r and r2 not in taken]
            if -s - max(rivals, default=0) < 8:
                done[l] = (r, -s, "AMBIGUOUS", None)
            else:
                done[l] = (r, -s, "MATCHED", min(-s, 90))
                taken.add(r)
        want |= {(job, l): done.get(l, (None, None, "TAKEN", None)) for _, l, _ in pairs}
    assert got == want
    # the rival of a pair counts only while it is free, and a frozen side gets nothing later
    few = spark.createDataFrame([(1, 1, 1, 90), (1, 1, 2, 88), (1, 2, 2, 95), (2, 1, 1, 60), (2, 1, 2, 58)], "job long, l long, r long, score long")
    assert {(x.job, x.l): x.verdict for x in with_margin(few, "job", "l", "r", "score", 8, 90).collect()} == {(1, 1): "MATCHED", (1, 2): "MATCHED", (2, 1): "AMBIGUOUS"}


# --- overlays


def slow_replay(items, log):
    """One change after another on plain lists."""
    order, fields, revision, told, known, derived, added = list(items), {}, 0, [], set(items), False, 0
    for kind, item, sn, field, value, seen in log:
        code = None
        if seen is not None and seen != revision:
            code = "REVISION_STALE"
        elif kind == "ADD":
            if not (sn or "").isdigit() or not 1 <= int(sn) <= len(order) + 1:
                code = "INSERTION_SN_OUT_OF_RANGE"
            else:
                added += 1
                new = item or f"man:{added}"
                if new in known:
                    code = "ITEM_ID_DUPLICATE"
                else:
                    known.add(new)
                    order.insert(int(sn) - 1, new)
                    fields[new] = {"description": value} if value else {}
        elif kind == "DELETE":
            if item not in order:
                code = "ITEM_NOT_FOUND"
            elif sn != str(order.index(item) + 1):
                code = "CONFIRMATION_SN_MISMATCH"
            elif len(order) == 1:
                code = "LAST_ITEM_UNDELETABLE"
            else:
                order.remove(item)
                fields.pop(item, None)
        elif kind in ("EDIT", "BULK"):
            chosen = [item] if kind == "EDIT" else order if sn == "all" else order[int(sn.split("-")[0]) - 1 : int(sn.split("-")[-1])] if sn else []
            if kind == "EDIT" and item not in order:
                code = "ITEM_NOT_FOUND"
            elif kind == "BULK" and not sn:
                code = "SN_RANGE_EMPTY"
            elif kind == "BULK" and sn != "all" and int(sn.split("-")[0]) > int(sn.split("-")[-1]):
                code = "SN_RANGE_INVALID"
            elif kind == "BULK" and sn != "all" and int(sn.split("-")[-1]) > len(order):
                code = "SN_RANGE_OUT_OF_BOUNDS"
            elif field == "colour":
                code = "ITEM_FIELD_NOT_EDITABLE"
            elif field == "quantity" and (value is None or Decimal(value) <= 0):
                code = "QUANTITY_INVALID"
            elif field in ("gross_weight", "net_weight") and value:
                for x in chosen:
                    held = fields.get(x, {}) | {field: value}
                    if {"gross_weight", "net_weight"} <= held.keys() and Decimal(held["net_weight"]) >= Decimal(held["gross_weight"]):
                        code = "NET_NOT_BELOW_GROSS"
            if code is None:
                for x in chosen:
                    fields.setdefault(x, {})
                    fields[x].pop(field, None)
                    if value:
                        fields[x][field] = value
        elif kind == "COMPUTE":
            derived = True
            told.append(("OK", revision))
            continue
        if code is None:
            revision, derived = revision + 1, False
        told.append((code or "OK", revision))
    return [(x, fields.get(x) or {}) for x in order], told, derived


def test_overlay_by_slow_version(spark):
    rng = random.Random(11)
    items, log, want = [], [], {}
    for job in range(250):
        own = [f"src:{k}" for k in range(rng.randrange(1, 6))]
        moves = []
        for _ in range(rng.randrange(0, 25)):
            kind = rng.choice(["ADD", "DELETE", "EDIT", "EDIT", "BULK", "COMPUTE"])
            field, value = rng.choice([("quantity", "5"), ("quantity", "-1"), ("gross_weight", "9"), ("net_weight", "3"), ("net_weight", "12"), ("gross_weight", None), ("country_of_origin", "Nepal"), ("colour", "red")])
            sn = rng.choice(["1", "2", "3", "7", "0"]) if kind != "BULK" else rng.choice(["all", "1-2", "2-1", "9", ""])
            item = rng.choice([*own, "gone", None]) if kind != "ADD" else rng.choice([None, "man:x"])
            moves.append((kind, item if kind != "BULK" else None, sn, field, value if kind != "ADD" else rng.choice([None, "new one"]), rng.choice([None, None, None, 1])))
        items += [(job, x, k) for k, x in enumerate(own)]
        log += [(job, k, *m) for k, m in enumerate(moves)]
        want[job] = slow_replay(own, moves)
    rng.shuffle(log)
    got = replayed(spark.createDataFrame(items, "job long, item_id string, place long"), spark.createDataFrame(log, "job long, seq long, kind string, item_id string, sn string, field string, value string, revision int"), "job").collect()
    assert {r.job: ([(i.item_id, dict(i.fields)) for i in r.items], [(v.verdict, v.revision) for v in r.log], r.derived) for r in got} == want
    assert all([i.sn for i in r.items] == list(range(1, len(r.items) + 1)) for r in got)
