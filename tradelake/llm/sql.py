"""DuckDB SQL of the operators on windows, shingle sets and vectors: every pair or window is looked at, so it is for small tables."""

WORD = r"[^\x20\x09-\x0D]+"

FM_DEDUP = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM documents WHERE text IS NOT NULL
), h AS (
  SELECT doc_id, ws, list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i : i + 19], ' '))) AS hs FROM w
), u AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word, unnest(hs) AS digest FROM h
), d AS (
  SELECT doc_id, i, word, digest IS NOT NULL AND row_number() OVER (PARTITION BY digest ORDER BY doc_id, i) > 1 AS again FROM u
), c AS (
  SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM d
), t AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN t USING (doc_id)
"""

#: Ids with the least id that links reach, from l(a, b) with both directions of every link.
_REACHED = "reach(id, other) AS (SELECT a, a FROM l UNION SELECT id, b FROM reach JOIN l ON other = a), least AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END)) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), k AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), {_REACHED}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.id = d.doc_id
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
), f AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM f x JOIN f y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), {_REACHED}, n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id)::BIGINT AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.id = vec_id
"""
