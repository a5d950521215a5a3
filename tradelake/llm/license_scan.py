"""License texts found by phrases and by an exact set-similarity join of text blocks with templates. DataFrame operations only.

A block is a line, or a line with the next one or two (a wrapped notice). A template matches a block that holds at least PERCENT of the template's distinct
words. The join orders the templates' words by their number in all texts, the rarest first; a block
that reaches the threshold must hold one of a template's first words (prefix filter), must have enough
words of templates at all (length filter), and from the place of the shared word in either order enough
must remain (positional filter). What passes is counted exactly. Templates are a fixed list, so they
and their words' counts are broadcast.

Results for unusual input: null texts count as empty: no words, no places, empty labels, score 0.
Repeated rows, rows of one doc_id and rows without one are scored each by its own text. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import scratch

PERCENT = 75
#: Lines in a block at most.
LINES = 3
# The phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Short public license notices.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-notice": "licensed under cc by 4 0",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "isc-notice": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-notice": "released under the mit license",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
W = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
NOT_W = r"[\x00-/:-@\[-`{-\x7F]"
#: Before and after a whole word. The one before takes a character, which is cheaper than to look behind at each.
HEAD, TAIL = rf"(?:^|{NOT_W})", rf"(?!{W})"


def phrase(words: str) -> str:
    return rf"{HEAD}(?i:{f'{NOT_W}+'.join(words.split())}){TAIL}"


ANY = rf"{HEAD}(?i:{'|'.join(f'{NOT_W}+'.join(p.split()) for p in PHRASES)}){TAIL}"


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased (other letters as they are)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(text, upper, lower), F.lit(f"({W}+)"), F.lit(1))


def phrases(docs: DataFrame) -> DataFrame:
    """doc_id, sig, n_words, n_base, first_word, last_word, base (array of labels), for each row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("sig"), text.alias("text"), F.regexp_count(text, F.lit(f"{W}+")).cast("long").alias("n_words"), F.regexp_count(text, F.lit(ANY)).cast("long").alias("n_base"))
    has = F.col("n_base") > 0
    count = lambda part: F.regexp_count(part, F.lit(f"{W}+")).cast("long")
    labels = F.array_sort(F.array_compact(F.array(*(F.when(F.col("text").rlike(phrase(p)), F.lit(label)) for p, label in PHRASES.items()))))
    return rows.select(
        "doc_id", "sig", "n_words", "n_base",
        F.when(has, count(F.element_at(F.split("text", ANY, 2), 1))).alias("first_word"),
        F.when(has, count(F.regexp_extract("text", f"(?s)^(.*){ANY}", 1))).alias("last_word"),
        F.when(has, labels).otherwise(F.array().cast("array<string>")).alias("base"),
    )


def matches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """row (doc_id, sig), block (number), label, containment of every block and template that reach the threshold."""
    spark = docs.sparkSession
    vocabulary = sorted({w for x in TEMPLATES.values() for w in x.split()})
    every = docs.select(F.explode(F.split("text", f"{NOT_W}+")).alias("w")).select(F.lower("w").alias("w"))
    counted = every.where(F.col("w").isin(vocabulary)).groupBy("w").count()
    seen = {r.w: r["count"] for r in counted.collect()}  # one row for each word of the fixed templates
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    firsts, sets = [], []
    for label, words in TEMPLATES.items():
        own = sorted(set(words.split()), key=place.get)
        need = -(-percent * len(own) // 100)
        sets.append((label, own, need))
        firsts += [(w, label, i, len(own), need) for i, w in enumerate(own[: len(own) - need + 1])]
    first_words = sorted({w for w, *_ in firsts})
    templates = F.broadcast(spark.createDataFrame(sets, "label string, own array<string>, need int"))
    prefix = F.broadcast(spark.createDataFrame(firsts, "w string, label string, i int, n int, need int"))
    some = rf"{HEAD}(?i:{'|'.join(first_words)}){TAIL}"
    lines = F.split("text", "\n", -1)
    joined = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LINES), F.size(lines) - i + 1)), lambda k: F.array_join(F.slice(lines, i, k), "\n")))
    row = F.struct("doc_id", F.xxhash64("text").alias("sig")).alias("row")
    blocks = docs.where(F.col("text").rlike(some)).select(row, F.posexplode(F.flatten(joined)).alias("block", "line")).where(F.col("line").rlike(some))
    ordered = F.filter(F.array(*(F.lit(w) for w in order)), lambda w: F.array_contains("words", w))
    blocks = blocks.withColumn("words", F.array_distinct(words_of(F.col("line")))).select("row", "block", ordered.alias("words"))
    met = blocks.select("row", "block", "words", F.posexplode("words").alias("j", "w")).join(prefix, "w")
    met = met.where((F.size("words") >= F.col("need")) & (1 + F.least(F.size("words") - F.col("j") - 1, F.col("n") - F.col("i") - 1) + F.least("i", "j") >= F.col("need")))
    pairs = met.select("row", "block", "words", "label").distinct().join(templates, "label")
    shared = F.size(F.array_intersect("words", "own"))
    return pairs.where(shared >= F.col("need")).select("row", "block", "label", (shared / F.size("own")).alias("containment"))


def digest(docs: DataFrame) -> DataFrame:
    found = matches(docs).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = phrases(docs).withColumn("row", F.struct("doc_id", "sig")).join(scratch.written(found), "row", "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _phrase_sql() -> str:
    cases = []
    for p, label in PHRASES.items():
        test = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(p.split()))
        cases.append(f"WHEN {test} THEN '{label}'")
    return " ".join(cases)


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), w AS (
  SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM d
), p AS (
  SELECT r, i - 1 AS idx, CASE {_phrase_sql()} END AS label FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), b AS (
  SELECT r, count(*) AS n_base, min(idx) AS first_word, max(idx) AS last_word, list(DISTINCT label) AS base FROM p WHERE label IS NOT NULL GROUP BY r
), t(label, own) AS (
  VALUES {", ".join(f"('{label}', list_distinct(string_split('{x}', ' ')))" for label, x in TEMPLATES.items())}
), s AS (
  SELECT r, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL
), k AS (
  SELECT r, unnest(flatten(list_transform(range(1, len(ls) + 1), lambda i: list_transform(range(1, least({LINES}, len(ls) - i + 1) + 1), lambda n: array_to_string(ls[i:i + n - 1], chr(10)))))) AS block FROM s
), l AS (
  SELECT r, list_distinct(regexp_extract_all(translate(block, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS ws FROM k
), m AS (
  SELECT r, list(DISTINCT label) AS more, max(k / n) AS best
  FROM (SELECT r, label, len(list_intersect(ws, own))::DOUBLE AS k, len(own) AS n FROM l, t) WHERE 100 * k >= {PERCENT} * n GROUP BY r
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""
