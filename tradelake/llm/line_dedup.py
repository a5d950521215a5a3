"""Removal of lines that stand on many sites.

Each line's hash gets a HyperLogLog sketch of the sites (sources) it is seen on, merged by aggregation.
Lines whose estimate is clear of the threshold are decided by it; for those within MARGIN standard
errors of it, the distinct sites are counted exactly. Lines at or above the threshold are boilerplate
and all their occurrences go. No line's rows are gathered.

Results for unusual input: null texts have no lines and stay null; lines without a character other
than space stay; a null source is no site. Two lines are equal when their bytes are (their 64-bit
hash and length here). Rows with a null doc_id stay as they are; rows of one doc_id are cut each by its
own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import anchors, scratch

#: Distinct sites from which a line is boilerplate.
SITES = 10
LG_K = 12
#: Standard errors (1.04 / sqrt(2 ** LG_K)) within which the estimate doesn't decide.
MARGIN = 4


def lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """doc_id, sig, at (number of the line, from 0), h, size, site for each line with a character other than space."""
    each = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"), F.col(f"`{site}`").alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return each.where(F.trim("line") != "").select(*anchors.ROW, "at", F.xxhash64("line").alias("h"), F.octet_length("line").alias("size"), "site")


def boilerplate(each: DataFrame, sites: int = SITES) -> DataFrame:
    """h, size, n_sites of the lines on at least `sites` sites (n_sites: exact if near the threshold, else the estimate)."""
    sketches = each.where("site is not null").groupBy("h", "size").agg(F.hll_sketch_agg(F.col("site").cast("string"), LG_K).alias("sketch"))
    seen = scratch.written(sketches.select("h", "size", F.hll_sketch_estimate("sketch").alias("n")).where(F.col("n") >= sites * (1 - MARGIN * 1.04 / 2 ** (LG_K / 2)) - 1))
    margin = sites * MARGIN * 1.04 / 2 ** (LG_K / 2) + 1
    near = seen.where(F.abs(F.col("n") - sites) <= margin).select("h", "size")
    exact = each.join(near, ["h", "size"], "left_semi").where("site is not null").select("h", "size", "site").distinct().groupBy("h", "size").agg(F.count("*").alias("n_sites"))
    return seen.where(F.col("n") > sites + margin).select("h", "size", F.col("n").alias("n_sites")).unionByName(exact.where(F.col("n_sites") >= sites))


def removed_lines(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """doc_id, sig, gone (numbers of its boilerplate lines), a written table; a document's list is bounded by its text."""
    each = scratch.written(lines(docs, site))
    common = scratch.written(boilerplate(each, sites))
    return scratch.written(each.join(common, ["h", "size"], "left_semi").groupBy(*anchors.ROW).agg(F.collect_set("at").alias("gone")))


def _cut(docs: DataFrame, sites: int, site: str) -> DataFrame:
    """_row (the row of docs), text and n_removed (lines) of each row after its boilerplate lines have gone."""
    gone = removed_lines(docs, sites, site)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"), F.struct(*(f"`{c}`" for c in docs.columns)).alias("_row"))
    out = anchors.with_lists(rows, gone)
    text = F.when(F.col("gone").isNull(), F.col("_row.text")).otherwise(F.array_join(F.filter(F.split("_row.text", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n"))
    return out.select("_row", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def cut(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """The rows and columns of docs without their boilerplate lines (text, and n_chars where there is such a column)."""
    fields = []
    for c in docs.columns:
        if c == "text":
            fields.append(F.col("text"))
        elif c == "n_chars":
            fields.append(F.when(F.col("n_removed") == 0, F.col("_row.n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)).alias("n_chars"))
        else:
            fields.append(F.col(f"_row.`{c}`").alias(c))
    return _cut(docs, sites, site).select(*fields)


def digest(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the remaining text, null as empty)."""
    out = _cut(docs.select("doc_id", "text", "source"), sites, "source")
    n_lines = F.coalesce(F.size(F.split("_row.text", "\n", -1)), F.lit(0)).cast("long")
    return out.select("_row.doc_id", n_lines.alias("n_lines"), "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS idx
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT line FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= {SITES}
), k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.line IS NOT NULL) AS n_removed,
    string_agg(l.line, chr(10) ORDER BY idx) FILTER (WHERE b.line IS NULL) AS kept
  FROM l LEFT JOIN b ON l.line = b.line GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
