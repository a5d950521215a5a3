"""Printed pages read as tables: lines, headers carried forward, short rows put right, rows confirmed, layouts remembered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import descriptions as d, headers as h

#: Rows that a remembered layout must confirm on a page.
LEAST_ROWS = 3


def lines_of(pages: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """keys, line (from 0), cells of the table lines of pages; other lines have none. Null texts have no lines."""
    lines = pages.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "_text")).where(F.col("_text").contains("|"))
    return lines.select(*keys, "line", d.table_cells(F.col("_text")).alias("cells")).where(F.exists("cells", lambda x: x != ""))


def under_headers(lines: DataFrame, document: Sequence[str], order: Sequence[str], packing: bool = False) -> DataFrame:
    """Table lines that are no header, with roles, units, uom and n_cols of the last header of their document before them, nulls without one.

    Only lines that could be a header are looked at by the solver; a header holds on over the document's pages.
    """
    read = h.with_roles(lines, packing, every=True)
    every = read.select(*lines.columns, F.struct("roles", "units", "uom", "n_cols").alias("_h"), F.col("roles").isNotNull().alias("_own"))
    upto = Window.partitionBy(*document).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("_last", F.last(F.when(F.col("_own"), F.col("_h")), ignorenulls=True).over(upto))
    return every.where(~F.col("_own")).select(*lines.columns, "_last.*")


def put_right(lines: DataFrame) -> DataFrame:
    """Lines under a header with `shift`, short ones put right where their numbers prove the place."""
    return h.put_right(lines)


def packing_rows(lines: DataFrame) -> DataFrame:
    """The goods rows of packing lists under their headers; rows that are short and not put right are left out."""
    return h.rows_of(put_right(lines.where("roles is not null")).where("shift != 'SHORT'"), invoice=False)


def invoice_rows(lines: DataFrame) -> DataFrame:
    """The goods rows of invoices that their own numbers confirm, under their headers."""
    return h.rows_of(lines.where("roles is not null and size(cells) = n_cols"), invoice=True)


def by_memory(lines: DataFrame, page: Sequence[str], layouts: DataFrame) -> DataFrame:
    """page, layout, and the invoice rows of pages without a header, each read by the remembered layout that confirms most rows.

    lines: page, line, cells. layouts: layout (name), roles, uom, n_cols, confirmed. A layout is tried on lines of its width alone,
    so a page meets as many layouts as are remembered for its widths. The best has most confirmed rows on the page (LEAST_ROWS at least),
    then most ever, then the first name. Pages that none reads are left out.
    """
    tried = lines.withColumn("n_cols", F.size("cells")).join(layouts.select("layout", "roles", "uom", "n_cols", F.col("confirmed").alias("_ever")), "n_cols")
    read = h.rows_of(tried, invoice=True).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*page, "layout")))
    best = Window.partitionBy(*page).orderBy(F.desc("_n"), F.desc("_ever"), "layout")
    return read.where(F.col("_n") >= LEAST_ROWS).withColumn("_rank", F.dense_rank().over(best)).where("_rank = 1").drop("_n", "_rank", "_ever")
