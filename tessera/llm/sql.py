"""DuckDB SQL with the results of the operators that SQL can express."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS, passes

WS = r"[^\x20\x09-\x0D]"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quality_sql(source: str = "documents", final: str | None = None) -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    verdict = " AND ".join(passes(r) for r in RULES)
    final = final or (
        "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, "
        "NOT base_failed AND verdict AS kept FROM v"
    )
    return rf"""
WITH d AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {source}),
a AS (
  SELECT *, regexp_extract_all(t, '{WS}+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WS}')) AS lines
  FROM d),
wins AS (
  SELECT rid, i, w[i : i + 4] AS g
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM a)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM wins) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY rid),
m AS (
  SELECT a.*, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(t, '!'))::BIGINT AS n_shouts,
         len(lines)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: rtrim(lower(x), '.,;:?') IN ({stops})))::BIGINT AS n_stop,
         len(list_filter(lines, lambda x: x LIKE '%...' OR x LIKE '%…'))::BIGINT AS n_ellipsis_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*•]')))::BIGINT AS n_bullet_lines
  FROM a LEFT JOIN cov USING (rid)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {verdict} AS verdict FROM m)
{final}"""


def _similar_sets(width: int, columns: str) -> str:
    """Links by prefix filter, components by reachability."""
    return rf"""
WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WS}+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i : i + {width - 1}] AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {width - 1}, least(len(w), 1)))) AS i FROM a)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
df AS (SELECT g, row_number() OVER (ORDER BY count(*), g) AS r FROM s GROUP BY g),
o AS (SELECT doc_id, r, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS p FROM s JOIN df USING (g)),
pre AS (SELECT doc_id, r FROM o JOIN n USING (doc_id) WHERE p <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM pre x JOIN pre y ON x.r = y.r AND x.doc_id < y.doc_id),
inter AS (SELECT a, b, count(*) AS c FROM cand JOIN o x ON x.doc_id = a JOIN o y ON y.doc_id = b AND y.r = x.r GROUP BY a, b),
links AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.x)
SELECT doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(x) AS component_id{columns}
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


#: Base 32 by fives of the hexadecimal digest: five digits are four characters.
WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex FROM p),
d AS (
  SELECT *, array_to_string(list_transform(generate_series(0, 7), lambda i:
    array_to_string(list_transform([15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * i + 1)::INT, 5))::INT >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex) AS first
  FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""


#: crc32 of UTF-8 bytes from its table of remainders; `t` is the table's list.
_CRC_TABLE = """
bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def _crc32(x: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda o: ('0x' || o)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


RESAMPLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
w AS (SELECT 'd' AS side, doc_id AS r, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
      FROM documents UNION ALL
      SELECT 'b', NULL, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
b AS (SELECT w, {_crc32("w")} % 10000 AS k FROM (SELECT DISTINCT w FROM w), crc),
f AS (SELECT side, r, k, count(*) AS c FROM w JOIN b USING (w) GROUP BY ALL),
n AS (SELECT k, sum(c) FILTER (side = 'd') AS s, sum(c) FILTER (side = 'b') AS t FROM f GROUP BY k),
u AS (SELECT coalesce(sum(s), 0)::DOUBLE + 10000 AS s, coalesce(sum(t), 0)::DOUBLE + 10000 AS t FROM n),
g AS (SELECT k, floor(1000 * ln((coalesce(n.t, 0)::DOUBLE + 1) * u.s / ((coalesce(n.s, 0)::DOUBLE + 1) * u.t)))::BIGINT AS g FROM n, u),
v AS (SELECT r, sum(c)::BIGINT AS n, floor(sum(c * g)::DOUBLE / sum(c))::BIGINT AS weight FROM f JOIN g USING (k) WHERE side = 'd' GROUP BY r),
d AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN v ON r = doc_id),
e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS p, count(*) FILTER (n_features >= 20) OVER () AS m FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= 10 * m // 100 THEN p END AS rank FROM o"""


TRIE = rf"""
WITH RECURSIVE {_CRC_TABLE},
t AS (
  SELECT conv_id, d, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS i
  FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS n,
               md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
        FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (
  SELECT c.conv_id, d, n, 0 AS own, i FROM c JOIN t ON t.conv_id = base AND i <= h
  UNION ALL SELECT c.conv_id, d, n, 1, i FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
q AS (SELECT conv_id, d, n, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth FROM r),
p AS (
  SELECT conv_id, depth, n, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM q
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id),
n AS (
  SELECT path, p.depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n_bytes,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (depth = len), '')) AS ends_sha256
  FROM p JOIN e USING (conv_id) GROUP BY path, p.depth),
k AS (SELECT left(path, 32 * (depth - 1)::INT) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (
  SELECT left(path, 32 * a) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n_bytes)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(generate_series(0, depth::INT)) AS a FROM m) GROUP BY ALL)
SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s USING (path) LEFT JOIN n u ON m.depth > 0 AND u.path = left(m.path, 32 * (m.depth - 1)::INT)"""


ORACLES = {
    "op13_ngram_jaccard_join": _similar_sets(5, ""),
    "op12_prefix_trie": TRIE,
    "op11_importance_resampling": RESAMPLING,
    "op2_warc": WARC,
    "op8_minhash_near_dup": _similar_sets(2, ", doc_id = min(x) AS kept"),
    "op10_quality_rules": quality_sql(),
}
