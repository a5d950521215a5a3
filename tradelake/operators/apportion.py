"""Exact-sum allocation: totals in whole units (cents, grams) split over the items of a group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def _wide(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)")


def largest_remainder(df: DataFrame, group: Sequence[str], order: Sequence[str], basis: str, total: str, out: str) -> DataFrame:
    """Adds `out`: each item's whole share of its group's `total` in proportion to `basis`.

    Shares are rounded down; what is left goes, a unit each, to the largest remainders (ties by `order`).
    Groups whose basis isn't positive split equally. The shares of a group add up to its total.
    """
    every = Window.partitionBy(*group)
    weighed = df.withColumn("_sum", F.sum(_wide(basis)).over(every)).withColumn("_n", F.count("*").over(every))
    share = F.when(F.col("_sum") > 0, _wide(basis)).otherwise(F.lit(1).cast("decimal(38,0)"))
    whole = F.when(F.col("_sum") > 0, _wide("_sum")).otherwise(_wide("_n"))
    weighed = weighed.withColumn("_b", share.cast("decimal(18,0)")).withColumn("_w", whole.cast("decimal(18,0)")).withColumn("_t", F.col(total).cast("decimal(18,0)"))
    weighed = weighed.withColumn("_down", F.expr("(_t * _b) div _w")).withColumn("_rest", F.expr("(_t * _b) % _w"))
    rank = F.row_number().over(every.orderBy(F.desc("_rest"), *order))
    left = F.col("_t") - F.sum("_down").over(every)
    return weighed.withColumn(out, (F.col("_down") + (rank <= left).cast("int")).cast("long")).drop("_sum", "_n", "_b", "_w", "_t", "_down", "_rest")


def with_floors(df: DataFrame, group: Sequence[str], order: Sequence[str], basis: str, total: str, floor: str, out: str) -> DataFrame:
    """As largest_remainder, where no share is under `floor`: where the plain split is, floors are given first and the rest is split.

    A group whose floors exceed its total has no split: its shares are null.
    """
    every = Window.partitionBy(*group)
    plain = largest_remainder(df, group, order, basis, total, "_plain")
    floors = plain.withColumn("_left", F.col(total) - F.sum(floor).over(every))
    over = largest_remainder(floors, group, order, basis, "_left", "_over")
    fits = F.min((F.col("_plain") >= F.col(floor)).cast("int")).over(every) == 1
    share = F.when(F.col("_left") < 0, None).when(fits, F.col("_plain")).otherwise(F.col(floor) + F.col("_over"))
    return over.withColumn(out, share.cast("long")).drop("_plain", "_left", "_over")


def residual_to_largest(df: DataFrame, group: Sequence[str], order: Sequence[str], basis: str, total: str, out: str) -> DataFrame:
    """Adds `out`: shares rounded half up to whole units; what they miss or exceed goes to the largest basis (the first at a tie)."""
    every = Window.partitionBy(*group)
    weighed = df.withColumn("_sum", F.sum(basis).over(every)).withColumn("_n", F.count("*").over(every))
    b, w = F.when(F.col("_sum") > 0, F.col(basis)).otherwise(F.lit(1)), F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(F.col("_n"))
    weighed = weighed.withColumn("_b", b.cast("decimal(18,0)")).withColumn("_w", w.cast("decimal(18,0)")).withColumn("_t", F.col(total).cast("decimal(18,0)"))
    weighed = weighed.withColumn("_near", F.expr("(2 * _t * _b + _w) div (2 * _w)"))
    first = F.row_number().over(every.orderBy(F.desc(basis), *order)) == 1
    missing = F.col("_t") - F.sum("_near").over(every)
    return weighed.withColumn(out, (F.col("_near") + F.when(first, missing).otherwise(0)).cast("long")).drop("_sum", "_n", "_b", "_w", "_t", "_near")


def running_split(df: DataFrame, group: Sequence[str], order: Sequence[str], basis: str, total: str, out: str) -> DataFrame:
    """Adds `out`: shares rounded down in order, the last item takes what remains."""
    every = Window.partitionBy(*group)
    ordered = every.orderBy(*order)
    down = F.expr(f"(cast({total} as decimal(18,0)) * cast({basis} as decimal(18,0))) div greatest(1, _sum)")
    shared = df.withColumn("_sum", F.sum(basis).over(every).cast("decimal(18,0)")).withColumn("_down", down)
    before = F.coalesce(F.sum("_down").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.lead(F.lit(1)).over(ordered).isNull()
    return shared.withColumn(out, F.when(last, F.col(total) - before).otherwise(F.col("_down")).cast("long")).drop("_sum", "_down")


def with_ceilings(df: DataFrame, group: Sequence[str], order: Sequence[str], basis: str, total: str, ceiling: str, out: str) -> DataFrame:
    """As largest_remainder, where no share is over `ceiling`: what capped items leave goes to the others in proportion.

    Items reach their ceilings in the order of ceiling over basis, so running sums tell which do, without passes.
    A group whose ceilings can't take its total has no split: its shares are null.
    """
    every = Window.partitionBy(*group)
    weighed = df.withColumn("_b", F.when(F.sum(_wide(basis)).over(every) > 0, F.col(basis)).otherwise(F.lit(1)).cast("decimal(18,0)"))
    ordered = every.orderBy(F.try_divide(F.col(ceiling).cast("double"), F.col("_b").cast("double")).asc_nulls_last(), *order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    basis_left = F.sum("_b").over(every) - F.coalesce(F.sum("_b").over(before), F.lit(0))
    total_left = F.col(total) - F.coalesce(F.sum(_wide(ceiling)).over(before), F.lit(0))
    weighed = weighed.withColumn("_bl", basis_left.cast("decimal(18,0)")).withColumn("_tl", total_left.cast("decimal(18,0)"))
    weighed = weighed.withColumn("_full", F.expr(f"cast({ceiling} as decimal(18,0)) * _bl < _b * _tl"))
    room = F.sum(F.when(F.col("_b") > 0, _wide(ceiling))).over(every)
    taken = F.coalesce(F.sum(F.when(F.col("_full"), _wide(ceiling))).over(every), F.lit(0))
    weighed = weighed.withColumn("_room", room).withColumn("_rest_total", F.greatest(F.lit(0), F.col(total) - taken)).withColumn("_open", F.when(F.col("_full"), 0).otherwise(F.col("_b")))
    split = largest_remainder(weighed, group, order, "_open", "_rest_total", "_split")
    share = F.when(F.col("_room") < F.col(total), None).when(F.col("_full"), F.col(ceiling)).otherwise(F.col("_split"))
    return split.withColumn(out, share.cast("long")).drop("_b", "_bl", "_tl", "_full", "_room", "_rest_total", "_open", "_split")


#: Items that take up a pin's difference at first.
MOST_DONORS = 10


def cartons(df: DataFrame, group: Sequence[str], order: Sequence[str], basis: str, total: str, pin: str, printed: str, out: str) -> DataFrame:
    """Adds `out` (units of 0.01 package, sums exact), `verdict` and `change` to items of jobs.

    pin: a reviewer's units, null without, kept as given. printed: the units that a packing list prints, null for items that are
    estimated. Without pins the total is split in proportion to `basis`, a unit each at least. What pins add or free against that
    split is taken by estimated items, the largest first: ten at most, not more than there are units, but further ones when those lack
    room above one unit. What is left then rescales the printed items as a set.

    verdict: OK; PINS_MISS_TOTAL (all items pinned and another sum); PINS_EXCEED (no room for the others, which
    stay at a unit, or nothing to take the rest); TOO_SMALL (the total is under a unit an item: all stay at one).
    change: PIN, DONOR, RESCALED, or NONE.
    """
    every = Window.partitionBy(*group)
    n, pins = F.count(F.lit(1)).over(every), F.count(pin).over(every)
    x = with_floors(df.withColumn("_one", F.lit(1).cast("long")), group, order, basis, total, "_one", "_base")
    x = x.withColumn("_kind", F.when(F.col(pin).isNotNull(), "PIN").when(F.col(printed).isNull(), "ESTIMATE").otherwise("PRINTED"))
    pinned = F.coalesce(F.sum(pin).over(every), F.lit(0))
    verdict = (
        F.when((pins == n) & (pinned != F.col(total)), "PINS_MISS_TOTAL").when(pins == n, "OK").when((pins > 0) & (F.col(total) - pinned < n - pins), "PINS_EXCEED").when(F.col("_base").isNull(), "TOO_SMALL").otherwise("OK")
    )
    x = x.withColumn("verdict", verdict).withColumn("_free", (F.col("verdict") == "OK") & (pins < n)).withColumn("_taken", F.coalesce(F.sum(F.col(pin) - F.col("_base")).over(every), F.lit(0)))
    same = Window.partitionBy(*group, "_kind")
    ranked = same.orderBy(F.desc("_base"), *order)
    x = x.withColumn("_rank", F.row_number().over(ranked)).withColumn("_room", F.col("_base") - 1).withColumn("_upto", F.sum("_room").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
    able = F.when(F.col("_taken") > 0, F.sum((F.col("_room") > 0).cast("int")).over(same)).otherwise(F.count(F.lit(1)).over(same))
    enough = F.coalesce(F.min(F.when(F.col("_upto") >= F.col("_taken"), F.col("_rank"))).over(same), able)
    few = F.least(F.lit(MOST_DONORS), able, F.abs("_taken"))
    last = F.when(F.col("_taken") > 0, F.least(able, F.greatest(few, enough))).otherwise(few)
    donor = (F.col("_kind") == "ESTIMATE") & F.col("_free") & (F.col("_taken") != 0)
    x = x.withColumn("_last", last).withColumn("_donor", donor & (F.col("_rank") <= F.col("_last")))
    donors = Window.partitionBy(*group, "_donor")
    x = x.withColumn("_move", F.when(F.col("_donor"), F.least(F.abs("_taken"), F.when(F.col("_taken") > 0, F.sum("_room").over(donors)).otherwise(F.abs("_taken")))).otherwise(0))
    x = x.withColumn("_by", F.when(~F.col("_donor"), 0).when(F.col("_taken") > 0, F.col("_room")).otherwise(F.col("_base")))
    x = largest_remainder(x, [*group, "_donor"], ["_rank"], "_by", "_move", "_moves")
    moved = F.coalesce(F.max(F.when(F.col("_donor"), F.col("_move"))).over(every), F.lit(0))
    x = x.withColumn("_remain", F.when(F.col("_free"), F.col("_taken") - F.signum("_taken") * moved).otherwise(0).cast("long"))
    rescaled = (F.col("_kind") == "PRINTED") & (F.col("_remain") != 0)
    x = x.withColumn("_set", rescaled)
    x = x.withColumn("_target", F.when(F.col("_set"), F.sum("_base").over(Window.partitionBy(*group, "_set")) - F.col("_remain")).otherwise(F.sum("_one").over(Window.partitionBy(*group, "_set"))).cast("long"))
    x = with_floors(x, [*group, "_set"], order, "_base", "_target", "_one", "_share")
    blocked = F.col("_free") & (F.col("_remain") != 0) & F.coalesce(F.max(F.col("_set") & F.col("_share").isNotNull()).over(every), F.lit(False)).eqNullSafe(F.lit(False))
    x = x.withColumn("_stuck", blocked)
    value = (
        F.when(F.col("_kind") == "PIN", F.col(pin)).when(F.col("verdict").isin("PINS_EXCEED", "TOO_SMALL"), F.lit(1)).when(F.col("_donor"), F.col("_base") - F.signum("_taken") * F.col("_moves"))
        .when(F.col("_set"), F.coalesce("_share", "_base")).otherwise(F.col("_base"))
    )
    change = F.when(F.col("_kind") == "PIN", "PIN").when(F.col("_donor") & (F.col("_moves") != 0), "DONOR").when(F.col("_set") & F.col("_share").isNotNull(), "RESCALED").otherwise("NONE")
    done = x.withColumn(out, value.cast("long")).withColumn("change", change).withColumn("verdict", F.when(F.col("_stuck"), "PINS_EXCEED").otherwise(F.col("verdict")))
    return done.select(*df.columns, out, "verdict", "change")


def _whole_shares(total: int, basis: list[int]) -> list[int]:
    """total in proportion to basis, rounded down, the rest by largest remainders; equal where the basis is nothing."""
    weights = basis if sum(basis) > 0 else [1] * len(basis)
    whole = sum(weights)
    parts = [divmod(total * w, whole) for w in weights]
    out = [a for a, _ in parts]
    for i in sorted(range(len(parts)), key=lambda i: (-parts[i][1], i))[: total - sum(out)]:
        out[i] += 1
    return out


def _bounded(total: int, basis: list[int], floors: list[int], ceilings: list[int | None]) -> list[int] | None:
    if sum(floors) > total:
        return None
    out: list[int | None] = [None] * len(basis)
    open_ = list(range(len(basis)))
    while open_:
        left = total - sum(x for x in out if x is not None)
        shares = _whole_shares(left, [basis[i] for i in open_])
        least = [floors[i] for i in open_]
        if any(s < f for s, f in zip(shares, least, strict=True)):
            shares = [f + s for f, s in zip(least, _whole_shares(left - sum(least), [basis[i] for i in open_]), strict=True)]
        over = {i for i, s in zip(open_, shares, strict=True) if ceilings[i] is not None and s > ceilings[i]}
        if any(ceilings[i] < floors[i] for i in over):
            return None
        if not over:
            for i, s in zip(open_, shares, strict=True):
                out[i] = s
            return out
        for i in over:
            out[i] = ceilings[i]
        open_ = [i for i in open_ if i not in over]
    return None


def with_bounds(df: DataFrame, group: Sequence[str], order: Sequence[str], basis: str, total: str, floor: str, ceiling: str, out: str) -> DataFrame:
    """Adds `out`: shares of a group's total in proportion to `basis`, none under `floor`, none over `ceiling` (null: without one).

    In passes: items whose share is over their ceiling are held at it and the others share what is left, until none
    is over. A floor binds as in with_floors. A group that its floors exceed, or whose ceilings can't take its total, has no split:
    its shares are null. A group's items (four numbers each) are in one task; null floors are 0.
    """
    numbers = {"_total": F.col(total), "_basis": F.coalesce(F.greatest(F.col(basis), F.lit(0)), F.lit(0)), "_floor": F.coalesce(F.col(floor), F.lit(0)), "_ceiling": F.col(ceiling)}
    item = F.struct(*(F.col(x).alias(f"_{k}") for k, x in enumerate(order)), *(v.cast("long").alias(k) for k, v in numbers.items()), F.struct(*(F.col(f"`{x}`") for x in df.columns)).alias("_row"))
    groups = df.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("items")).select("items")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            flat, out = items.flatten(), []
            values = [flat.field(k).to_pylist() for k in ("_total", "_basis", "_floor", "_ceiling")]
            at = 0
            for n in items.value_lengths().to_pylist():
                totals, bases, floors, ceilings = (x[at : at + n] for x in values)
                out.append(_bounded(totals[0], bases, floors, ceilings) or [None] * n)
                at += n
            yield pa.RecordBatch.from_arrays([items, pa.array(out, pa.list_(pa.int64()))], names=["items", "shares"])

    schema = f"items {groups.schema['items'].dataType.simpleString()}, shares array<bigint>"
    each = groups.mapInArrow(split, schema).select(F.explode(F.arrays_zip("items", "shares")).alias("x"))
    return each.select("x.items._row.*", F.col("x.shares").alias(out))
