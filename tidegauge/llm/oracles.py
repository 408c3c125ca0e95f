"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

WARC = """SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM (
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last,
array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(sha1(coalesce(html, '')), 5 * g + 1, 5) AS BIGINT) >> b) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest FROM pages) AS p"""

LINE_RUNS = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, len(regexp_extract_all(line, '{_WORD}')) AS n FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS i, sum(n) OVER (PARTITION BY doc_id ORDER BY ln) AS cum FROM w WHERE n > 0),
win AS (SELECT a.doc_id, a.i AS s, b.i AS e FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.i >= a.i WHERE b.cum - a.cum + a.n >= 50 AND (b.cum - b.n - a.cum + a.n < 50 OR b.cum - a.cum < 50)),
run AS (SELECT win.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS k FROM win JOIN r ON r.doc_id = win.doc_id AND r.i BETWEEN s AND e GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM run),
gone AS (SELECT DISTINCT r.doc_id, r.ln FROM ranked d JOIN r ON r.doc_id = d.doc_id AND r.i BETWEEN s AND e WHERE nth > 1),
kept AS (SELECT w.doc_id, string_agg(line, chr(10) ORDER BY w.ln) FILTER (WHERE g.ln IS NULL) AS text, count(*) FILTER (WHERE n > 0) AS n_lines, count(g.ln) AS n_removed FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.ln = w.ln GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN k.n_removed = 0 THEN d.text ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed FROM documents d LEFT JOIN kept k USING (doc_id)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS x FROM s), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) AS component_id, n.doc_id <= coalesce(m, n.doc_id) AS kept FROM n LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) r ON r.a = n.doc_id"""

SPELLING = r"""WITH RECURSIVE low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
run AS (SELECT doc_id, w, count(*) AS k, hex(encode(doc_id || ':' || w)) AS h FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM low) AS r GROUP BY doc_id, w),
step AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(0, 8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(0, 256) AS t(b)) AS s),
hashed AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) + 1, 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) AS crc FROM run, step),
cut AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(w, 1, crc % len(w)) || substr(w, crc % len(w) + 2) ELSE w END AS word, k FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE len(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v) AS p),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, row(-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, 0 AS far FROM f UNION ALL SELECT walk.word, f.form, far + 1 FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL)
SELECT f.*, root FROM f JOIN (SELECT word, arg_max(here, far) AS root FROM walk GROUP BY word) AS r USING (word)"""

HARD_NEGATIVES = """WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3"""

ORACLE_SQL = {"op1_warc_normaliser": WARC, "op3_line_runs": LINE_RUNS, "op9_setsketch_neardup": NEAR_DUPLICATES, "op11_spelling_variants": SPELLING, "op13_hard_negatives": HARD_NEGATIVES}
