"""Secrets in texts, told from widely copied examples by how many owners and repositories of the corpus hold them.

Each text is scanned for base spans (assignments, access keys, long hex runs) and for further candidates: tokens in
providers' forms, private key blocks, and long runs that mix letters and digits, as far as they lie apart from
base spans (and mixed runs apart from the other candidates). A candidate's value is hashed (SHA-256) and the hashes are counted over the whole corpus by distinct owner
and distinct repository. A value that stands with OWNERS owners or more, or in over REPOSITORIES repositories, is a
copied example; the others look live. Further candidates become spans only if they look live; base spans always stay, and
carry the verdict as well.

Results for unusual input: null and empty texts have no spans. Rows of one doc_id are scanned each alone and count as one
repository of their owner; a null owner or doc_id counts as one owner or repository. Repeated rows have equal results.
Long texts are scanned whole. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import scratch

OWNERS, REPOSITORIES = 3, 20
SALTS = 16


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base kinds in the contract's order: pattern, group that holds the value, least length of it.
BASE = {"assign": (ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
#: Kinds of the method.
MORE = {
    "provider": r"gh[oprsu]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}",
    "private": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x0A\x0D]*",
    "mixed": r"[A-Za-z0-9+/_-]{24,}",
}
KINDS = [*BASE, *MORE]
#: A mixed run holds at least so many digits and so many letters.
MIXED = 6
# long hex runs are found as such: shorter ones would fail anyway, and are as many as words
_SCANS = [(kind, re.compile(r"[0-9a-f]{24,}" if kind == "hex" else pattern), group, least) for kind, (pattern, group, least) in BASE.items()]
_MORE = [(kind, re.compile(pattern)) for kind, pattern in MORE.items()]
_MIXED = re.compile(MORE["mixed"])
SPAN = "struct<kind:string,start:long,end:long,value:string,base:boolean>"
SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("base", pa.bool_())]))


class Apart:
    """Spans of a text; clear() tells whether another one overlaps none of them."""

    def __init__(self, spans_):
        self.spans = sorted(spans_)
        self.ends = list(accumulate((b for _, b in self.spans), max))  # the furthest end of a span and those before it

    def clear(self, start: int, end: int) -> bool:
        before = bisect_left(self.spans, (end,))
        return not before or self.ends[before - 1] <= start


def spans(text: str) -> list[dict]:
    """Base spans and candidates of a text, by start, then kind; value: the SHA-256 of what the span keeps secret."""
    found = []
    for kind, pattern, group, least in _SCANS:
        found += [(m.start(), kind, m.end(), m[group], True) for m in pattern.finditer(text) if len(m[group]) >= least]
    taken = Apart((a, b) for a, _, b, _, _ in found)
    shaped = [(m.start(), kind, m.end(), m[0], False) for kind, pattern in _MORE if kind != "mixed" for m in pattern.finditer(text)]
    found += [x for x in shaped if taken.clear(x[0], x[2])]
    taken = Apart((a, b) for a, _, b, _, _ in found + shaped)
    for m in _MIXED.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= MIXED and sum(c.isalpha() for c in m[0]) >= MIXED and taken.clear(*m.span()):
            found.append((m.start(), "mixed", m.end(), m[0], False))
    found.sort(key=lambda x: (x[0], KINDS.index(x[1])))
    return [{"kind": k, "start": a, "end": b, "value": hashlib.sha256(v.encode()).hexdigest(), "base": own} for a, k, b, v, own in found]


def scanned(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Written: doc_id, owner, repository, sig, spans of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([spans(x) if x else [] for x in batch.column("text").to_pylist()], SPANS_TYPE)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "owner", "repository", "sig")), found], names=["doc_id", "owner", "repository", "sig", "spans"])

    text = F.coalesce("text", F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.xxhash64(text).alias("sig"), text.alias("text"))
    return scratch.written(given.mapInArrow(run, f"doc_id long, owner string, repository string, sig long, spans array<{SPAN}>"))


def ownership(found: DataFrame) -> DataFrame:
    """value, owners, repositories of every candidate value; a hot value is counted in parts before it meets."""
    held = found.select(F.explode("spans.value").alias("value"), F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repository", F.lit("\0")).alias("repository")).distinct()
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def findings(docs: DataFrame, owner: str = "source", repository: str = "doc_id", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """doc_id, spans, copied: each row's candidates, and the values among them that are copied examples (an array)."""
    found = scanned(docs, owner, repository)
    copied = ownership(found).where((F.col("owners") >= owners) | (F.col("repositories") > repositories))
    copied = copied.select("value", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    some = found.where(F.size("spans") > 0).withColumn("row", F.struct("doc_id", "sig"))
    met = some.select("row", F.explode(F.array_distinct("spans.value")).alias("value")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    marks = met.join(copied, ["value", "salt"]).groupBy("row").agg(F.collect_set("value").alias("copied"))
    marked = some.join(marks, "row", "left").select("doc_id", "spans", F.coalesce("copied", F.array().cast("array<string>")).alias("copied"))
    return marked.unionByName(found.where(F.size("spans") == 0).select("doc_id", "spans", F.array().cast("array<string>").alias("copied")))


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live (spans that look live) of each row."""
    live = lambda s: ~F.array_contains("copied", s["value"])
    rows = findings(docs).select(
        "doc_id", "copied", F.filter("spans", lambda s: s["base"]).alias("base"), F.filter("spans", lambda s: s["base"] | live(s)).alias("all"),
    )
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *map(number, BASE), F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"),
        F.size(F.filter("all", live)).cast("long").alias("n_live"),
    )


def _sql_spans() -> str:
    """Places of the matches: the pieces between them, and they themselves, add up to the text."""
    parts = []
    for kind, pattern in ({k: p for k, (p, _, _) in BASE.items()} | MORE).items():
        literal = pattern.replace("'", "''")
        group, least = BASE[kind][1:] if kind in BASE else (0, 0)
        parts.append(
            f"SELECT r, '{kind}' AS kind, {KINDS.index(kind)} AS k, unnest(regexp_extract_all(t, '{literal}')) AS m, unnest(regexp_extract_all(t, '{literal}', {group})) AS v, "
            f"unnest(list_transform(string_split_regex(t, '{literal}')[:-2], lambda x: length(x))) AS gap, generate_subscripts(regexp_extract_all(t, '{literal}'), 1) AS i, {least} AS least FROM d"
        )
    return " UNION ALL ".join(parts)


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT r, kind, k, v, least, length(m) AS n, sum(gap + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM ({_sql_spans()})
), c AS (
  SELECT r, kind, k, v, (e - n)::BIGINT AS s, e::BIGINT AS e FROM m
  WHERE length(v) >= least AND (kind <> 'mixed' OR (length(regexp_replace(v, '[^0-9]', '', 'g')) >= {MIXED} AND length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= {MIXED}))
), a AS (
  SELECT * FROM c WHERE k < {len(BASE)} UNION ALL
  SELECT * FROM c WHERE k >= {len(BASE)} AND NOT EXISTS (SELECT 1 FROM c b WHERE b.r = c.r AND b.k < CASE WHEN c.kind = 'mixed' THEN c.k ELSE {len(BASE)} END AND b.s < c.e AND c.s < b.e)
), o AS (
  SELECT v FROM a JOIN d USING (r) GROUP BY v
  HAVING count(DISTINCT coalesce(source, chr(1))) >= {OWNERS} OR count(DISTINCT (coalesce(source, chr(1)), coalesce(doc_id::VARCHAR, 'none'))) > {REPOSITORIES}
), f AS (
  SELECT r, a.v IN (SELECT v FROM o) AS copied, kind, k, s, e, kind || ':' || s || ':' || e AS x FROM a
), g AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(x, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS base, string_agg(x, ',' ORDER BY s, k) FILTER (k < {len(BASE)} OR NOT copied) AS spans, count(*) FILTER (NOT copied) AS n_live
  FROM f GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live
FROM d LEFT JOIN g USING (r)
"""
