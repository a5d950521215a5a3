"""Conversations brought into the form (s?(ua)+)? by the cheapest edits, by weighted CYK parsing over spans of rows.

The grammar is in Chomsky normal form. A nonterminal [p, q] derives a span that leads from state p to state q of
the wanted form (0 begin, 1 after the system turn, 2 after a user turn, 3 after an answer): [p, q] -> [p, r] [r, q],
or one row's edit, with insertions on both sides (the insertion closure). A span's cell holds the least (cost,
audit) of each nonterminal. Since each nonterminal names both its ends, every split of a span gives the same cell, so one
split a span is enough: spans of 1, 2, 4, ... rows are combined bottom-up. Of equal cost no audit of a span begins
another (what follows would be insertions, which cost), so the least audits of parts make the least audit of the whole.

Rows are sorted over range partitions by (conv_id, turn, role, text). A conversation that lies inside a partition is
parsed there at once. One that touches a partition's border or is very long is 'open': each of its partitions gives one
cell, the cells are combined, and each partition then applies its part of the chosen edits. So a conversation of any
share of the table is spread over tasks; only its audit (one byte an edit, eleven nonterminals) and the stream of its
bytes through SHA-256, which has no parallel form, pass one task each.

Results for unusual input: a null role or text is one space, so a null text is blank and a null role is illegal
until edited; a null conv_id is a conversation of its own; null turns come first and do not count for gaps; rows of
one turn are ordered by role and text; repeated rows are duplicates. Texts are of any length. An empty table gives no
rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import scratch

BLANKS = " \t\n\x0b\x0c\r"
RULED_DELETE, RULED_REROLE, RULED_INSERT, CUT_SHORT = 3, 2, 2, 1
NAMES = {"u": "user", "a": "assistant"}
#: The state after a turn of that initial, by the state before.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
GIVEN = {0: "u", 1: "u", 2: "a", 3: "u"}  # the turn that may be put in at a state
#: A conversation of more rows or bytes within a partition is treated as open.
MOST_ROWS, MOST_BYTES = 20_000, 1 << 24
SALTS = 16
Cell = dict[tuple[int, int], tuple[int, str]]


def _least(cell: Cell, key: tuple[int, int], value: tuple[int, str]) -> None:
    if key not in cell or value < cell[key]:
        cell[key] = value


def combined(left: Cell, right: Cell) -> Cell:
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            more = right.get((r, q))
            if more:
                _least(out, (p, q), (cost + more[0], audit + more[1]))
    return out


def _inserted() -> Cell:
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    step = dict(cell)
    for p, given in GIVEN.items():
        step[p, MOVES[p, given]] = (RULED_INSERT, "I")
    for _ in range(3):
        cell = combined(cell, step)
    return cell


INSERTED = _inserted()


def leaf(symbol: str) -> Cell:
    """The cell of one row: x must be deleted; s, u, a by its role's initial, else o; capitals if its text is cut short."""
    cell: Cell = {(p, p): (RULED_DELETE, "D") for p in range(4)}
    if symbol != "x":
        more = CUT_SHORT if symbol.isupper() else 0
        for p in range(4):
            if (p, symbol.lower()) in MOVES:
                _least(cell, (p, MOVES[p, symbol.lower()]), (more, "K"))
            _least(cell, (p, MOVES[p, GIVEN[p]]), (RULED_REROLE + more, "R"))
    return combined(combined(INSERTED, cell), INSERTED)


def parsed(symbols: str) -> Cell:
    """The cell of the span of rows that the symbols stand for."""
    return _short(symbols) if len(symbols) <= 32 else _split(symbols)


def _split(symbols: str) -> Cell:
    if len(symbols) < 2:
        return leaf(symbols) if symbols else INSERTED
    half = 1 << (len(symbols) - 1).bit_length() - 1
    return combined(parsed(symbols[:half]), parsed(symbols[half:]))


@lru_cache(maxsize=1 << 16)
def _short(symbols: str) -> Cell:
    return _split(symbols)


def chosen(cell: Cell) -> tuple[int, str, int]:
    """(cost, audit, last state) of the cheapest edits of a whole conversation."""
    return min((*cell[0, q], q) for q in (0, 3) if (0, q) in cell)


class Share:
    """What one task has of a conversation: rows in order, their faults, and sums that join with those of the next share."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.symbols: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None  # role initials
        self.least = self.most = None  # turns

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> None:
        """`copies` equal rows; seen: an earlier row has this role and text."""
        if copies and turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        body = text.rstrip(BLANKS)
        for _ in range(copies):
            self.rows.append((role, text))
            self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
            self.last = role[:1]
            self.first = self.last if self.first is None else self.first
            if not body:
                self.blank, symbol = self.blank + 1, "x"
            elif seen:
                self.duplicate, symbol = self.duplicate + 1, "x"
            else:
                symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
                if body[-1] not in ".!?":
                    self.truncated, symbol = self.truncated + 1, symbol.upper()
            self.symbols.append(symbol)
            seen = True


def applied(rows: list[tuple[str, str]], audit: str, state: int) -> list[dict]:
    """The turns that the edits make of the rows, from a state on."""
    out, at = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit != "K":
            role = NAMES[GIVEN[state]]
        state = MOVES[state, role[:1]]
        out.append({"role": role, "text": text})
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows dropped (no copies), emptied, stripped of their ends, repeated or given to the user by crc32(conv_id:turn) % 20."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.encode(F.concat(one("conv_id"), F.lit(":"), one("turn")), "UTF-8")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), lot.alias("lot"))
    text = F.when(F.col("lot").isin(0, 1), "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("lot") == 0, 0).when(F.col("lot") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def undamaged(turns: DataFrame) -> DataFrame:
    """The operator's input from plain rows (conv_id, turn, role, text)."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role"), one("text"), F.lit(1).cast("long").alias("copies"))


FAULTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "array<struct<role:string,text:string>>"
TURNS_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
ORDER = ("conv_id", "turn", "role", "text")


def _gaps(least: int | None, most: int | None, turns: int) -> int:
    return 0 if least is None else most - least + 1 - turns


def first_pass(rows: DataFrame) -> DataFrame:
    """Written: results of the conversations that lie inside a range partition (part null), and the rows of the open ones."""
    equal = rows.groupBy(*ORDER).agg(F.sum("copies").alias("copies"))
    ranged = equal.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*ORDER)
    closed_fields = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kinds = [*((c, pa.int64()) for c in closed_fields), ("audit", pa.string()), ("turns", TURNS_TYPE), ("part", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[dict] = []
        held: list[tuple] = []
        at, opened, size = None, True, 0

        def close(last: bool) -> None:
            if opened or last:
                out.extend({"conv_id": at[0], "part": part, "turn": t, "role": r, "text": x, "copies": n} for t, r, x, n in held)
                return
            share, seen = Share(), set()
            for turn, role, text, copies in held:
                share.add(turn, role, text, copies, (role, text) in seen)
                if copies:
                    seen.add((role, text))
            cost, audit, _ = chosen(parsed("".join(share.symbols)))
            out.append({
                "conv_id": at[0], "gaps": _gaps(share.least, share.most, share.turns), "blank": share.blank, "duplicate": share.duplicate, "truncated": share.truncated,
                "illegal": share.illegal, "cost": cost, "audit": audit, "turns": applied(share.rows, audit, 0),
            })

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in out], k) for c, k in kinds], names=[c for c, _ in kinds])

        written = 0
        for batch in batches:
            for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in (*ORDER, "copies")), strict=True):
                if at is None or conv_id != at[0]:
                    if at is not None:
                        close(False)
                        opened, held, size = False, [], 0
                    at = (conv_id,)
                held.append(tuple(row))
                size += len(row[2])
                if opened or len(held) > MOST_ROWS or size > MOST_BYTES:  # known to be open: its rows go on at once
                    opened, written = True, written + size
                    close(True)
                    held, size = [], 0
                if len(out) >= 4096 or written > MOST_BYTES:
                    yield batch_of()
                    out, written = [], 0
        if at is not None:
            close(True)
        if out:
            yield batch_of()

    schema = f"{FAULTS}, turns {TURNS}, part long, turn long, role string, text string, copies long"
    return scratch.written(ranged.mapInArrow(run, schema))


def _shares(rows: DataFrame, emit, schema: str) -> DataFrame:
    """emit(rows of one (conv_id, part), in order) for each; a row: conv_id, part, turn, role, text, copies, seen, p, q."""
    fields = ("conv_id", "part", "turn", "role", "text", "copies", "seen", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield from emit(held)
                    held = []
                held.append(row)
        if held:
            yield from emit(held)

    return rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", *ORDER[1:]).mapInArrow(run, schema)


def _share(rows: list[tuple]) -> Share:
    share = Share()
    for _, _, turn, role, text, copies, seen, _, _ in rows:
        share.add(turn, role, text, copies, seen)
    return share


CELL = "array<struct<p:int,q:int,cost:long,audit:string>>"
CELL_TYPE = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
SUMS = ("blank", "duplicate", "truncated", "illegal", "turns", "least", "most")


def _same(a: DataFrame, b: DataFrame, *on: str) -> Column:
    """Rows of one conversation (null too) that agree in the columns on."""
    out = a["conv_id"].eqNullSafe(b["conv_id"])
    for c in on:
        out = out & (a[c] == b[c])
    return out


def second_pass(opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of open conversations: their results, and their turns in pieces (conv_id, part, seq, turns)."""
    firsts = opened.where("copies > 0").groupBy("conv_id", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("conv_id", "role", "text", F.col("first.turn").alias("first"), F.lit(True).alias("again"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    salted = opened.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)))
    known = salted.join(firsts, _same(salted, firsts, "role", "text", "salt"), "left")
    seen = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("first").eqNullSafe(salted["turn"])
    rows = scratch.written(known.select(*(salted[c] for c in ("conv_id", "part", "turn", "role", "text", "copies")), seen.alias("seen")))

    def cells(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        share = _share(held)
        cell = [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in parsed("".join(share.symbols)).items()]
        sums = [pa.array([getattr(share, c)], pa.int64()) for c in SUMS]
        yield pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), pa.array([held[0][1]], pa.int64()), *sums, pa.array([share.first], pa.string()), pa.array([share.last], pa.string()), pa.array([cell], CELL_TYPE)], names=["conv_id", "part", *SUMS, "first", "last", "cell"])

    sums_schema = ", ".join(f"{c} long" for c in SUMS)
    free = rows.withColumns({"p": F.lit(None).cast("int"), "q": F.lit(None).cast("int")})
    parts = _shares(free, cells, f"conv_id long, part long, {sums_schema}, first string, last string, cell {CELL}")

    def whole(table: pa.Table) -> pa.Table:
        shares = sorted(table.to_pylist(), key=lambda r: r["part"])
        given = [{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in r["cell"]} for r in shares]
        # prefix cells from state 0, then the states between shares from behind: a state fits if its part makes up the whole
        reached: list[dict[int, tuple[int, str]]] = [{0: (0, "")}]
        for cell in given:
            step = combined({(0, q): v for q, v in reached[-1].items()}, cell)
            reached.append({q: v for (_, q), v in step.items()})
        cost, audit, q = min((*reached[-1][q], q) for q in (0, 3) if q in reached[-1])
        states = [q]
        for cell, before in zip(given[::-1], reached[-2::-1], strict=True):
            states.append(min((before[p][0] + cell[p, states[-1]][0], before[p][1] + cell[p, states[-1]][1], p) for p in before if (p, states[-1]) in cell)[2])
        states.reverse()
        filled = [r for r in shares if r["first"] is not None]
        dated = [r for r in shares if r["least"] is not None]
        illegal = sum(r["illegal"] for r in shares) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(filled, filled[1:], strict=False))
        turns = sum(r["turns"] for r in shares) - sum(a["most"] == b["least"] for a, b in zip(dated, dated[1:], strict=False))
        gaps = _gaps(dated[0]["least"], dated[-1]["most"], turns) if dated else 0
        numbers = [gaps, *(sum(r[c] for r in shares) for c in SUMS[:3]), illegal, cost]
        ends = [{"part": r["part"], "p": p, "q": q} for r, p, q in zip(shares, states, states[1:], strict=False)]
        columns = {"conv_id": pa.array([shares[0]["conv_id"]], pa.int64())} | {c: pa.array([x], pa.int64()) for c, x in zip(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), numbers, strict=True)}
        return pa.table(columns | {"audit": pa.array([audit], pa.string()), "ends": pa.array([ends], pa.list_(pa.struct([("part", pa.int64()), ("p", pa.int32()), ("q", pa.int32())])))})

    results = scratch.written(parts.groupBy("conv_id").applyInArrow(whole, f"{FAULTS}, ends array<struct<part:long,p:int,q:int>>"))
    ends = results.select("conv_id", F.explode("ends").alias("end")).select("conv_id", "end.*")

    def turned(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        share, p, q = _share(held), held[0][7], held[0][8]
        turns = applied(share.rows, parsed("".join(share.symbols))[p, q][1], p)
        seq = first = size = 0
        for i, x in enumerate(turns, 1):
            size += len(x["text"]) + len(x["role"])
            if size > 1 << 20 or i - first == 4096 or i == len(turns):
                columns = [pa.array([held[0][0]], pa.int64()), pa.array([held[0][1]], pa.int64()), pa.array([seq], pa.int64()), pa.array([turns[first:i]], TURNS_TYPE)]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "seq", "turns"])
                seq, first, size = seq + 1, i, 0

    placed = rows.join(ends, _same(rows, ends, "part"), "inner").select(*(rows[c] for c in rows.columns), "p", "q")
    return results.drop("ends"), _shares(placed, turned, f"conv_id long, part long, seq long, turns {TURNS}")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faults, cost and audit of each conversation, and its turns after the edits in pieces (conv_id, part, seq, turns).

    rows: conv_id, turn, role, text, copies, as `undamaged` or `damaged` give them. Pieces are in the order of
    part and seq; conversations that end up empty have none.
    """
    table = first_pass(rows)
    done = table.where("part is null")
    faults, pieces = second_pass(table.where("part is not null").select("conv_id", "part", "turn", "role", "text", "copies"))
    names = [c.split()[0] for c in FAULTS.split(", ")]
    inside = done.where(F.size("turns") > 0).select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("seq"), "turns")
    return done.select(*names).unionByName(faults), inside.unionByName(pieces)


def _printed(turns: str) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def _hashed(pieces: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of pieces, streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = state = None
        for batch in batches:
            for conv_id, text in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if at is None or at[0] != conv_id:
                    if at:
                        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])
                    at, state = (conv_id,), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(text.encode())
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    text = pieces.select("conv_id", "part", "seq", _printed("turns").alias("text"))
    return text.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, "conv_id long, repaired_sha256 string")


def digest(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of damaged conversations."""
    table = first_pass(damaged(turns))
    names = [c.split()[0] for c in FAULTS.split(", ")]
    done = table.where("part is null").select(*names, F.sha2(F.encode(_printed("turns"), "UTF-8"), 256).alias("repaired_sha256"))
    faults, pieces = second_pass(table.where("part is not null").select("conv_id", "part", "turn", "role", "text", "copies"))
    hashed = _hashed(pieces).withColumnRenamed("conv_id", "_conv")
    more = faults.join(hashed, faults["conv_id"].eqNullSafe(hashed["_conv"]), "left").drop("_conv")
    empty = hashlib.sha256(b"").hexdigest()
    return done.unionByName(more.select(*names, F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")))
