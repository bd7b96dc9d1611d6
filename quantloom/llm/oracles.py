"""DuckDB SQL of the operators that SQL can express, over whole tables."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SUBSTRING = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
p AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
spans AS (SELECT r, i, w, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS span, count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS n FROM p),
starts AS (SELECT r, i, w, CASE WHEN n = 35 AND count(*) OVER (PARTITION BY span, n) > 1 THEN 1 ELSE 0 END AS again FROM spans),
covered AS (SELECT r, i, w, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM starts),
kept AS (SELECT r, sum(gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (gone = 0) AS text FROM covered GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i, len(words) AS n FROM d),
spans AS (SELECT doc_id, i, n, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS g FROM p),
grams AS (SELECT DISTINCT doc_id, g FROM spans WHERE i <= n - 3 OR (n < 4 AND i = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a, a AS b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, coalesce(m.b, d.doc_id) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a) m USING (doc_id)
"""
