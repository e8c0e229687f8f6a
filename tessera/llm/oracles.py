"""DuckDB SQL for the queries that SQL can express: operators 7, 8, 9, 11 and 13."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

REPEATS = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS i FROM b),
strings AS (SELECT doc_id, i, md5(array_slice(h, 2 * i + 1, 2 * i + 400)) AS m FROM starts JOIN b USING (doc_id)),
again AS (SELECT doc_id, i FROM strings WHERE m IN (SELECT m FROM strings GROUP BY m HAVING count(*) > 1)),
fresh AS (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 200)::INT AS fresh FROM again),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM fresh),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM numbered GROUP BY ALL),
pieces AS (
    SELECT doc_id, a AS pos, array_slice(h, 2 * coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, 2 * a) AS piece FROM runs JOIN b USING (doc_id)
    UNION ALL SELECT doc_id, 1000000000, array_slice(h, 2 * coalesce(max(z), 0) + 1, length(h)) FROM b LEFT JOIN runs USING (doc_id) GROUP BY doc_id, h
),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS h FROM pieces GROUP BY doc_id),
removed AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, (length(b.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
n AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS newest FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || h[5 * (i // 4) + 1 : 5 * (i // 4) + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest,
    CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to, 0::BIGINT AS archive_gap_bytes
FROM n
"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
x AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 75 * (len(sa.sh) + len(sb.sh) - n)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT s.doc_id, len(any_value(sh))::BIGINT AS n_shingles, min(reach) AS component_id, s.doc_id = min(reach) AS kept FROM s JOIN r USING (doc_id) GROUP BY s.doc_id
"""

LINES = rf"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id <> keeper AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

NEGATIVES = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id::BIGINT AS anchor_id, positive_id::BIGINT AS positive_id, row_number() OVER w AS rank, other::BIGINT AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY rank <= 10
"""

ORACLES = {"op7_pfp": REPEATS, "op8_warc": ARCHIVES, "op9_minhash": NEAR, "op11_linededup": LINES, "op13_hardneg": NEGATIVES}
