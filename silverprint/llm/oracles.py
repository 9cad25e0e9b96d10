"""SQL counterparts of the queries that SQL can express, written from their contracts and not from the operators."""

from __future__ import annotations

from silverprint.llm.licenses import NOTICES

_LOWERED = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CONTENT = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = rf"regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+')"

OP1 = f"""WITH d AS (SELECT doc_id, {_CONTENT} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS id, {_CONTENT} AS ws FROM benchmark),
win AS (SELECT DISTINCT id, least(len(ws), 10) AS k, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS g
  FROM items, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(ws) - k + 2)) AS t(i)),
hit AS (SELECT DISTINCT doc_id, grams.k, i, id FROM grams JOIN win ON win.g = grams.g AND win.k = grams.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, CAST(COALESCE(words.n, 0) AS BIGINT) AS n_hit, CAST(COALESCE(found.n, 0) AS BIGINT) AS n_items,
  sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id"""

_TEMPLATES = ", ".join(
    f"('{t.label}', string_split('{' '.join(t.words)}', ' '), {t.needed}, {len(t.tokens)})" for t in NOTICES
)
OP3 = f"""WITH d AS (SELECT doc_id, {_CONTENT} AS ws FROM documents),
phrases(label, p) AS (VALUES ('gpl', ['gnu', 'general', 'public', 'license']), ('apache', ['apache', 'license']),
  ('cc-by', ['cc', 'by']), ('mit', ['mit', 'license'])),
places AS (SELECT doc_id, label, i - 1 AS place FROM d, phrases, unnest(range(1, len(ws) - len(p) + 2)) AS t(i) WHERE ws[i : i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi FROM places GROUP BY doc_id),
notices(label, p, needed, size) AS (VALUES {_TEMPLATES}),
blocks AS (SELECT doc_id, label, needed, size, len(list_intersect(ws[b + 1 : b + 2 * len(p)], p)) AS common
  FROM d, notices, unnest(range(0, len(ws))) AS t(b)),
own AS (SELECT doc_id, label, max(common / size) AS holds FROM blocks WHERE common >= needed GROUP BY doc_id, label),
every AS (SELECT doc_id, label, 1e0 AS holds, true AS is_base FROM places UNION SELECT doc_id, label, holds, false FROM own),
named AS (SELECT doc_id, max(holds) AS score, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels FROM every GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, CAST(COALESCE(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels, COALESCE(score, 0e0) AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id"""

OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i : i + 4], ' ') ELSE array_to_string(ws, ' ') END AS s
  FROM d, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS t(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(node, low) AS (SELECT DISTINCT x, x FROM links UNION SELECT l.y, r.low FROM reach r JOIN links l ON l.x = r.node WHERE r.low < l.y),
named AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT d.doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_shingles, COALESCE(low, d.doc_id) AS component_id, COALESCE(low, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN named ON named.node = d.doc_id"""


_EXACT = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"


def _crc32(column: str) -> str:
    """Unsigned CRC-32 of the decimal digits of a number, bit by bit."""
    codes = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    byte = f"list_reduce(range(8), lambda x, k: {step}, xor(acc, c))"
    return f"xor(list_reduce({codes}, lambda acc, c: {byte}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


OP12 = f"""WITH o AS (SELECT doc_id, {_EXACT} AS ws, {_crc32("doc_id")} AS h FROM documents),
g AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM o),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS ws FROM p),
w AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS i FROM d),
same AS (SELECT x.doc_id, y.i - x.i AS q, y.i AS i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
part AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM same),
span AS (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length FROM part GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM span GROUP BY doc_id, start, length),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(COALESCE(told.text, '')) AS runs_sha256, sha256(COALESCE(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN told ON told.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

OP13 = f"""WITH t AS (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text, len({_EXACT}) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_crc32("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, i, role, text, n FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND i < h
  UNION ALL SELECT c.conv_id, i, role, text, n FROM c JOIN t ON t.conv_id = c.conv_id AND i >= h),
k AS (SELECT conv_id, n, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY i) AS k FROM r),
whole AS (SELECT c.conv_id, COALESCE(list_last(list(k.k ORDER BY len(k.k)) FILTER (k.k IS NOT NULL)), []) AS k FROM c LEFT JOIN k ON k.conv_id = c.conv_id GROUP BY c.conv_id),
node AS (SELECT k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM (SELECT conv_id, k, n FROM k UNION ALL SELECT conv_id, [], 0 FROM c) GROUP BY k),
ends AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM whole GROUP BY k),
up AS (SELECT *, k[1 : len(k) - 1] AS above FROM node),
child AS (SELECT above AS k, count(*) AS n FROM up WHERE len(k) > 0 GROUP BY above),
sums AS (SELECT u.k[1 : d] AS k, sum((u.n_convs - 1) * u.n) AS saved, count(*) FILTER (child.n IS NULL) AS leaves
  FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM node) u LEFT JOIN child ON child.k = u.k GROUP BY 1)
SELECT up.conv_id, len(up.k) AS depth, p.conv_id AS parent_conv_id, up.n_convs, COALESCE(child.n, 0) AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(COALESCE(ids, '')) AS ends_sha256
FROM up LEFT JOIN node p ON len(up.k) > 0 AND p.k = up.above LEFT JOIN child ON child.k = up.k LEFT JOIN ends ON ends.k = up.k JOIN sums ON sums.k = up.k"""
