"""DuckDB SQL for the results of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH l AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM l),
x AS (SELECT *, string_agg(word, ' ') OVER q AS span, count(*) OVER q AS n FROM w
  WINDOW q AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
d AS (SELECT doc_id, j, word, n = 20 AND row_number() OVER (PARTITION BY span, n ORDER BY doc_id, j) > 1 AS again FROM x),
g AS (SELECT doc_id, j, word, max(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM d),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM l LEFT JOIN s ON s.doc_id = l.doc_id"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE l AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS m, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM l),
p AS (SELECT doc_id, m, word, lead(word) OVER (PARTITION BY doc_id ORDER BY j) AS next FROM w),
s AS (SELECT DISTINCT doc_id, CASE WHEN m = 1 THEN word ELSE word || ' ' || next END AS shingle FROM p WHERE m = 1 OR next IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a AS u, b AS v FROM k UNION ALL SELECT b, a FROM k),
cc(node, component) USING KEY (node) AS (
  SELECT doc_id, doc_id FROM l
  UNION
  SELECT e.u, min(c.component) FROM e JOIN cc c ON c.node = e.v JOIN recurring.cc o ON o.node = e.u WHERE c.component < o.component GROUP BY e.u)
SELECT l.doc_id, coalesce(n.n, 0) AS n_shingles, cc.component AS component_id, l.doc_id = cc.component AS kept
FROM l JOIN cc ON cc.node = l.doc_id LEFT JOIN n ON n.doc_id = l.doc_id"""
