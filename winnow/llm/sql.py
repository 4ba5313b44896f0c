"""DuckDB SQL for the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, c.component_id
FROM g JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = g.doc_id
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length(regexp_replace(replace(role, '\', '\\'), '([\[<])(/?INST\]|/?s>)', '\1\\\2', 'g'))
    + length(regexp_replace(replace(text, '\', '\\'), '([\[<])(/?INST\]|/?s>)', '\1\\\2', 'g')) + 17 AS chars FROM c),
e AS (SELECT *, 3 + sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

MIXING = rf"""
WITH w AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
d AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS size, 1 - pow((CAST(('0x' || substr(md5('1:' || doc_id), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE,
    1 / greatest(len(list_distinct(ws)) / greatest(len(ws), 1), 0.05)) AS z FROM w),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
h AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS share, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - sum(cap) OVER o + cap)::DOUBLE / (sum(share) OVER () - sum(share) OVER o + share) AS level
  FROM h WINDOW o AS (ORDER BY cap / share, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
g AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(level, cap / share) FROM l WHERE level <= cap / share) * share, 0)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs FROM g),
u AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.epochs, r.target - r.epochs * r.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY z, doc_id) AS upto, sum(d.size) OVER (PARTITION BY d.source, z, doc_id) AS peers
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN rest > 0 AND upto - peers / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM u
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM m WHERE least < doc_id),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (
  SELECT t.doc_id, count(*) AS n_words, count(c.p) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY t.p) FILTER (c.p IS NULL), '')) AS kept_sha256
  FROM t LEFT JOIN c USING (doc_id, p) GROUP BY t.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

TOPK = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
o AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
c AS (SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs FROM o GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS total FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT lang, source, term, m.n, (1 + 1000000000::HUGEINT * (m.n + 1) // (own + v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (total + 1) // (v.n + v))::BIGINT AS q
  FROM m JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""

TRIE = """
WITH RECURSIVE t0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM t0),
byte AS (SELECT b::BIGINT AS b, 0 AS k, b::BIGINT AS crc FROM range(256) x(b)
  UNION ALL SELECT b, k + 1, xor(crc >> 1, 3988292384 * (crc & 1)) FROM byte WHERE k < 8),
c AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS told FROM t),
z AS (SELECT conv_id, told, 0 AS pos, 4294967295::BIGINT AS crc FROM c
  UNION ALL SELECT conv_id, told, pos + 1, xor(byte.crc, z.crc >> 8) FROM z JOIN byte ON k = 8 AND b = xor(z.crc, ascii(substr(told, pos + 1, 1))) & 255 WHERE pos < length(told)),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS head, xor(crc, 4294967295) % 6 AS h FROM z WHERE pos = length(told)),
r0 AS (
  SELECT h.conv_id, 0 AS own, i, role, text FROM h JOIN t ON t.conv_id = head AND i <= h
  UNION ALL SELECT conv_id, 1, i, role, text FROM t JOIN h USING (conv_id) WHERE i > h),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d FROM r0),
m AS (
  SELECT conv_id, d, length(text) AS chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
ended AS (SELECT conv_id, max(d) AS last FROM m GROUP BY conv_id),
v AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = last), '') AS ends
  FROM m JOIN ended USING (conv_id) GROUP BY key, d),
up AS (SELECT v.*, p.key AS parent, w.conv_id AS parent_conv_id FROM v LEFT JOIN m p ON p.conv_id = v.conv_id AND p.d = v.d - 1 LEFT JOIN v w ON w.key = p.key AND w.d = v.d - 1),
kids AS (SELECT parent AS key, d - 1 AS d, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL),
sub AS (
  SELECT a.key, a.d, count(*) FILTER (kids.key IS NULL) AS n_leaves, sum((v.n - 1) * v.chars) AS saved
  FROM v JOIN m a ON a.conv_id = v.conv_id AND a.d <= v.d LEFT JOIN kids ON kids.key = v.key AND kids.d = v.d GROUP BY a.key, a.d)
SELECT up.conv_id, up.d::BIGINT AS depth, parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM up JOIN sub ON sub.key = up.key AND sub.d = up.d LEFT JOIN kids ON kids.key = up.key AND kids.d = up.d
"""
