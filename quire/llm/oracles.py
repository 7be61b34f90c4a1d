"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    """The words of ``text``: runs without the bytes 0x20 and 0x09-0x0D."""
    return rf"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"


OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_words(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i+4], ' '))) AS g
  FROM w WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(coalesce(c.m, d.doc_id), d.doc_id) AS component_id,
       least(coalesce(c.m, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

OP5 = rf"""
WITH w AS (SELECT doc_id, {_words("text")} AS ws FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)
), f AS (SELECT k, min({{'d': doc_id, 'i': i}}) AS f FROM p GROUP BY k
), g AS (
  SELECT DISTINCT doc_id, i + j AS at FROM (SELECT doc_id, i FROM p JOIN f ON p.k = f.k WHERE (doc_id, i) <> (f.f.d, f.f.i)), range(0, 20) t(j)
), u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at FROM w
), k AS (
  SELECT u.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY u.at) AS t FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.at = u.at WHERE g.at IS NULL GROUP BY u.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

OP10 = """
WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM w)
), f AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1
), s AS (SELECT doc_id, i FROM p WHERE k IN (SELECT k FROM f)
), e AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS new FROM s
), r AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e
), x AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY ALL
), y AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM x
), z AS (
  SELECT y.doc_id, sum(b - a)::BIGINT AS gone, count(*) AS n, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS kept, max(b) AS last
  FROM y JOIN w ON w.doc_id = y.doc_id GROUP BY y.doc_id
)
SELECT w.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM w LEFT JOIN z ON z.doc_id = w.doc_id
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS m FROM r GROUP BY a
), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(coalesce(m, e.vec_id), e.vec_id) AS component_id, least(coalesce(m, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.vec_id = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id
"""

# For pages of the tables' make: one article element with headings and paragraphs.
OP7 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS t FROM pages
), b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(t, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&quot;?', '"', 'g'),
    '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS l
  FROM a
), c AS (SELECT page_id, url, array_to_string(list_filter(l, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), m AS (
  SELECT doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
         100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM d
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
         count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY ALL
), x AS (SELECT unnest(range(0, 5)) AS i
), o AS (
  SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5
), k AS (
  SELECT array_to_string(list_transform(o, lambda j: substr('ABCDE', (j + 1)::INT, 1)), '') AS filter_order, s.i + 1 AS step, (1 << o[s.i + 1])::INT AS bit,
         coalesce(list_sum(list_transform(o[1:s.i], lambda j: 1 << j)), 0)::INT AS before
  FROM o, x s
), y AS (
  SELECT part, filter_order, step::INT AS step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM f, k GROUP BY ALL
)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM y
"""

OP13 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), s AS (SELECT conv_id, turn, role, md5(length(role)::VARCHAR || ':' || role || text) || lpad(format('{:x}', length(text)), 8, '0') AS y FROM t
), own AS (SELECT conv_id, list(y ORDER BY turn NULLS FIRST, role, y) AS ys FROM s GROUP BY conv_id
), h AS (
  SELECT conv_id, ys, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
           lambda c: list_prepend(ascii(c)::BIGINT, list_transform(range(0, 8), lambda i: -1::BIGINT))))),
         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 6 AS h
  FROM own
), r AS (
  SELECT h.conv_id, list_concat(coalesce(g.ys, []::VARCHAR[])[1:h], h.ys[h + 1:]) AS ys FROM h LEFT JOIN own g ON g.conv_id = h.conv_id - h.conv_id % 100
), p AS (SELECT conv_id, len(ys) AS n, array_to_string(ys, '') AS k, unnest(range(0, len(ys) + 1)) AS d FROM r
), n AS (
  SELECT substr(k, 1, 40 * d) AS k, d, count(*) AS n_convs, min(conv_id) AS conv_id,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM p GROUP BY ALL
), c AS (SELECT substr(k, 1, 40 * (d - 1)) AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL
), x AS (
  SELECT n.k, n.d, coalesce(c.n, 0) AS n_children, (n_convs - 1) * CASE WHEN d > 0 THEN ('0x' || right(n.k, 8))::BIGINT ELSE 0 END AS saved
  FROM n LEFT JOIN c ON c.k = n.k
), u AS (
  SELECT substr(k, 1, 40 * a) AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM x) GROUP BY ALL
)
SELECT n.conv_id, n.d::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN x ON x.k = n.k JOIN u ON u.k = n.k LEFT JOIN n q ON n.d > 0 AND q.k = substr(n.k, 1, 40 * (n.d - 1))
"""

#: Of the media query, what doesn't depend on the stream's format.
PAYLOADS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT *, octet_length(encode(text)) AS n FROM d),
p AS (SELECT *, greatest(192, (n + 191) // 192 * 192) AS size FROM n)
SELECT doc_id, n::BIGINT AS n_bytes, size::BIGINT AS payload_bytes, sha256(text || repeat(' ', (size - n)::INT)) AS payload_sha256 FROM p
"""

ORACLES = {"media_payloads": PAYLOADS, "op13_prefix_trie": OP13, "op11_filter_audit": OP11, "op7_html_text": OP7, "op1_epsilon_grid": OP1, "op9_warc_dictionary": OP9, "op5_substring_dedup": OP5, "op6_minhash_dedup": OP6, "op10_suffix_dedup": OP10}
