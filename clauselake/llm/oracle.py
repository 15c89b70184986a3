"""DuckDB SQL for those training-data queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Base 32 of a SHA-1 in hex: 5 bits at 5k lie in the nibbles 5k / 4 and the next.
_WARC = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, url, octet_length(b) AS n, sha1(b) || '0' AS h, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('{_DIGITS}',
    1 + (((instr('0123456789abcdef', substr(h, 5 * k // 4 + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, 5 * k // 4 + 2, 1)) - 1) >> CAST(3 - 5 * k % 4 AS INTEGER)) % 32, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to, url
FROM d
"""

_TOPK = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 5
"""

#: Every window of 200 bytes, as 400 hex digits; windows that start twice cover what goes.
_REPEATS = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, sha256(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT r, h, unnest(range(len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
g AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM w) WHERE n > 1),
m AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM g),
k AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM m),
x AS (SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY r, run),
y AS (SELECT r, run, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM x),
z AS (
  SELECT y.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM y JOIN d USING (r) GROUP BY y.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN z USING (r)
"""

_JACCARD = rf"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * both_ >= 90 * (a.n + b.n - both_)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.doc_id),
k AS (SELECT u AS doc_id, count(*) AS n_links FROM l GROUP BY u)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, coalesce(any_value(k.n_links), 0) AS n_links FROM r LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) GROUP BY r.doc_id
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTAMINATED = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN (SELECT DISTINCT n FROM iw) ON len(w) >= n)),
h AS (SELECT DISTINCT dw.r, dw.k, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
c AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS at FROM h) GROUP BY r),
o AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN o USING (r)
"""

_NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
t AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.n ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score WHERE p.n <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM t WHERE rank <= 5
"""

_PHRASES = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
w AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS s(k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
o AS (
  SELECT lang, part, max(a) AS over_ FROM (SELECT lang, a, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS part FROM c WHERE k > 2) GROUP BY lang, part),
y AS (SELECT c.*, unnest(range(1, c.k)) AS cut FROM c LEFT JOIN o ON c.lang = o.lang AND c.phrase = o.part WHERE o.over_ IS NULL OR o.over_ < c.a),
z AS (
  SELECT y.lang, y.phrase, y.a, y.cut, l.f AS l, r.f AS r, n.n, CAST(1000 * CAST(y.a AS HUGEINT) * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM y JOIN f l ON l.lang = y.lang AND l.phrase = array_to_string(y.w[1:y.cut], ' ') JOIN f r ON r.lang = y.lang AND r.phrase = array_to_string(y.w[y.cut + 1:y.k], ' ') JOIN n ON n.lang = y.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS least FROM z) WHERE least = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM t WHERE rank <= 2000
"""

ORACLE_SQL = {"op1_warc": _WARC, "op2_topk": _TOPK, "op3_suffix": _REPEATS, "op6_jaccard": _JACCARD, "op8_decontaminate": _CONTAMINATED, "op11_negatives": _NEGATIVES, "op13_phrases": _PHRASES}
