"""DuckDB SQL for the results of the operators that SQL can express."""

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
),
flag AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_doc FROM win) WHERE doc_id > first_doc),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM flag, range(13) AS r(k)),
lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(js), 0) AS removed, w,
         CASE WHEN js IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(js, x)), lambda x: w[x]) END AS k
  FROM d LEFT JOIN lists USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS g FROM d
),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
links AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c, s.doc_id)) AS component_id, coalesce(c, s.doc_id) >= s.doc_id AS kept
FROM s LEFT JOIN comp ON s.doc_id = comp.x
"""

COSINE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, coalesce(c, vec_id) >= vec_id AS kept
FROM embeddings LEFT JOIN comp ON vec_id = comp.x LEFT JOIN degree ON vec_id = degree.x
"""

ORACLES = {"op7_embedding_near_dedup": COSINE, "op8_substring_dedup": SUBSTRING, "op9_minhash_near_dedup": NEAR}
