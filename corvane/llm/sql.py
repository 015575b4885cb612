"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

import string

LOWERED = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def components(ids: str, links: str, key: str) -> str:
    """Recursive reach: the smallest id each id reaches."""
    return f"reach(id, root) AS (SELECT {key}, {key} FROM {ids} UNION SELECT l.y, r.root FROM reach r JOIN {links} l ON l.x = r.id), comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"


SHINGLES = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({LOWERED}, '{SPACED}'), []) AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
{components("documents", "l", "doc_id")}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN comp ON comp.id = d.doc_id"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
{components("v", "l", "vec_id")}, k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp ON id = vec_id LEFT JOIN k ON x = vec_id"""

CONTAMINATION = f"""WITH i AS (SELECT item_id, regexp_extract_all({LOWERED}, '{ALNUM}') AS ws FROM benchmark), m AS (SELECT item_id, ws, least(13, len(ws)) AS m FROM i WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda k: array_to_string(ws[k:k + m - 1], ' '))) AS g FROM m),
d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWERED}, '{ALNUM}'), []) AS ws FROM documents),
dw AS (SELECT doc_id, m, unnest(range(1, len(ws) - m + 2)) AS k, unnest(list_transform(range(1, len(ws) - m + 2), lambda k: array_to_string(ws[k:k + m - 1], ' '))) AS g FROM d CROSS JOIN (SELECT DISTINCT m FROM win)),
h AS (SELECT doc_id, k, dw.m, item_id FROM dw JOIN win USING (m, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(ws) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

REPEATS = f"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{SPACED}'), []) AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS k, unnest(list_transform(range(1, len(ws) - 33), lambda k: array_to_string(ws[k:k + 34], ' '))) AS g FROM d WHERE len(ws) >= 35),
r AS (SELECT doc_id, k FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
p AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM r), x AS (SELECT doc_id, list(p) AS gone FROM p GROUP BY doc_id),
a AS (SELECT doc_id, k, ws[k] AS word, ws FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM d)),
kept AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY k) AS kept FROM a LEFT JOIN p ON p.doc_id = a.doc_id AND p.p = a.k WHERE p.p IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ARCHIVE = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS digest FROM pages), g AS (SELECT digest, max(page_id) AS keeper FROM p GROUP BY digest)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN strlen(h) >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN strlen(h) >= 1000 AND page_id <> keeper THEN keeper END AS refers_to FROM p JOIN g USING (digest)"""

#: CRC-32 bit by bit, as DuckDB has none
CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b:
    list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)), 4294967295)"""

TRIE = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS k FROM t),
ids AS (SELECT c, {CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
front AS (SELECT ids.c, o.k, o.role, o.text FROM ids JOIN own o ON o.c = ids.c - ids.c % 20 AND o.k < ids.h),
i AS (SELECT ids.c, h, coalesce(n, 0) AS hb FROM ids LEFT JOIN (SELECT c, count(*) AS n FROM front GROUP BY c) USING (c)),
r AS (SELECT * FROM front UNION ALL SELECT c, k - h + hb, role, text FROM own JOIN i USING (c) WHERE k >= h),
m AS (SELECT c, k + 1 AS d, list({{'r': role, 't': text}}) OVER (PARTITION BY c ORDER BY k) AS p, len(regexp_extract_all(text, '{SPACED}')) AS w FROM r UNION ALL SELECT c, 0, [], 0 FROM i),
n AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM m GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, p)),
up AS (SELECT a AS d, p[1:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY ALL),
e AS (SELECT d, p, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM (SELECT c, d, p FROM m QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1) GROUP BY d, p)
SELECT f.conv_id, f.d::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM f JOIN up USING (d, p) LEFT JOIN e USING (d, p) LEFT JOIN n q ON q.d = f.d - 1 AND q.p = f.p[1:f.d - 1]"""

PHRASES = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) t(k))),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM g GROUP BY ALL), total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND f >= 100),
inside AS (SELECT DISTINCT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, f FROM (SELECT lang, ws, f, j, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c))),
open AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.f)),
cuts AS (SELECT o.lang, o.phrase, o.f AS a, x.f AS l, y.f AS r, n, i, ((1000::HUGEINT * o.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, k)) AS i FROM open) o JOIN total USING (lang) JOIN f x ON x.lang = o.lang AND x.phrase = array_to_string(o.ws[1:i], ' ') JOIN f y ON y.lang = o.lang AND y.phrase = array_to_string(o.ws[i + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""
