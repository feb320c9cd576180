"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: CRC-32 of a number as text, bit by bit.
_CRC = "xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_zip(w[:-2], w[2:]).list_transform(lambda p: p[1] || ' ' || p[2])) END AS g FROM d),
k AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS h FROM s),
rep AS (SELECT h, min(doc_id) AS node, any_value(n) AS n FROM k WHERE n > 0 GROUP BY h),
x AS (SELECT r.node, r.n, unnest(s.g) AS e FROM rep r JOIN s ON s.doc_id = r.node),
links AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.e = b.e AND a.node < b.node AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS other FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.other),
c AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, CASE WHEN k.n = 0 THEN k.doc_id ELSE coalesce(c.component, r.node) END AS component_id, k.doc_id = CASE WHEN k.n = 0 THEN k.doc_id ELSE coalesce(c.component, r.node) END AS kept
FROM k LEFT JOIN rep r ON r.h = k.h LEFT JOIN c ON c.node = r.node"""

#: Good-Turing discount of count r from the counts of counts m[1] to m[6].
_REST = "(6.0 * m[6] / m[1])"
_DISC = f"(((r + 1) * m[r + 1] / CAST(r * m[r] AS DOUBLE) - {_REST}) / (1 - {_REST}))"
_DISCOUNTS = f"list_transform(range(1, 6), lambda r: CASE WHEN m[r] > 0 AND m[1] > 0 AND {_REST} < 1 AND {_DISC} > 0 AND {_DISC} < 1 THEN {_DISC} ELSE 1 - 0.5 / r END)"
_COUNTED = "sum(c) AS total, count(*) AS v, list_transform(range(1, 7), lambda r: len(list_filter(list(c), lambda x: x = r))) AS m"
_KEPT = "CASE WHEN {0}.c > 5 THEN {0}.c - 0.1 ELSE disc[{0}.c] * {0}.c END"

#: Trigrams x, a, b; ' ' is the begin, '' the end; the first word of a text has no x.
KATZ = f"""
WITH d AS (SELECT doc_id, {_CRC} % 10 = 0 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+'), '') AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS b, unnest(list_concat([' '], w[:-2])) AS a, unnest(list_concat([NULL, ' '], w[:-3])[:len(w)]) AS x FROM d),
u AS (SELECT b, count(*) AS c FROM t WHERE NOT held_out GROUP BY b),
p AS (SELECT a, b, count(*) AS c FROM t WHERE NOT held_out GROUP BY a, b),
o AS (SELECT x, a, b, count(*) AS c FROM t WHERE NOT held_out AND x IS NOT NULL GROUP BY x, a, b),
n AS (SELECT 0 AS k, {_COUNTED} FROM u UNION ALL SELECT 1, {_COUNTED} FROM p UNION ALL SELECT 2, {_COUNTED} FROM o),
g AS (SELECT k, total, v, m, {_DISCOUNTS} AS disc FROM n),
q AS (SELECT u.b, u.c, ({_KEPT.format("u")}) / CAST(total AS DOUBLE) AS own FROM u, g WHERE k = 0),
z AS (SELECT 1 - sum(own) AS unseen FROM q),
cx AS (SELECT b AS a, c FROM u WHERE b <> '' UNION ALL SELECT ' ', c FROM u WHERE b = ''),
pp AS (SELECT p.a, p.b, ({_KEPT.format("p")}) / CAST(cx.c AS DOUBLE) AS chance, q.own FROM p JOIN cx USING (a) JOIN q ON q.b = p.b, g WHERE k = 1),
al AS (SELECT a, (1 - sum(chance)) / (1 - sum(own)) AS alpha FROM pp GROUP BY a),
oo AS (SELECT o.x, o.a, o.b, ({_KEPT.format("o")}) / CAST(p.c AS DOUBLE) AS chance, pp.chance AS own FROM o JOIN p ON p.a = o.x AND p.b = o.a JOIN pp ON pp.a = o.a AND pp.b = o.b, g WHERE k = 2),
ao AS (SELECT x, a, (1 - sum(chance)) / (1 - sum(own)) AS alpha FROM oo GROUP BY x, a)
SELECT t.doc_id, t.held_out, count(*) AS n_tokens, count(q.c) AS n_known, CAST(any_value(g.total) AS BIGINT) AS train_tokens,
round(sum(log10((coalesce(q.c, 0) + 0.1) / (g.total + 0.1 * (g.v + 1)))), 6) AS base_score,
round(sum(log10(CASE WHEN oo.chance IS NOT NULL THEN oo.chance ELSE coalesce(ao.alpha, 1) * CASE WHEN pp.chance IS NOT NULL THEN pp.chance ELSE coalesce(al.alpha, 1) * coalesce(q.own, z.unseen) END END)), 6) AS score
FROM t JOIN g ON g.k = 0 CROSS JOIN z LEFT JOIN q ON q.b = t.b LEFT JOIN pp ON pp.a = t.a AND pp.b = t.b LEFT JOIN al ON al.a = t.a
LEFT JOIN oo ON oo.x = t.x AND oo.a = t.a AND oo.b = t.b LEFT JOIN ao ON ao.x = t.x AND ao.a = t.a GROUP BY t.doc_id, t.held_out"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
r AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
o AS (SELECT doc_id, i, sum(CASE WHEN i > p + 200 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r)),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS z FROM o GROUP BY doc_id, g),
l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM sp GROUP BY doc_id)
SELECT d.doc_id, octet_length(b) AS n_bytes, CAST(coalesce(list_sum(z) - list_sum(a) + len(a), 0) AS BIGINT) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
sha256(CASE WHEN a IS NULL THEN b ELSE list_reduce(list_transform(range(1, len(a) + 2), lambda i: CASE WHEN i = 1 THEN b[1:a[1] - 1] WHEN i = len(a) + 1 THEN b[z[len(a)] + 1:octet_length(b)] ELSE b[z[i - 1] + 1:a[i] - 1] END), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN l ON l.doc_id = d.doc_id"""

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM d WHERE len(w) > 2),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, len(l) - len(list_distinct(l)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
x AS (SELECT *, base_failed OR sf OR lf AS af FROM (SELECT *, n_symbols > 0.5 * n_words AS sf, 100 * n_dup_lines > 60 * len(l) AS lf FROM f)),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS k FROM (SELECT source, unnest(['a', 's', 'l']) AS rule, unnest([af, sf, lf]) AS failed FROM x WHERE source IS NOT NULL) GROUP BY 1, 2),
b AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM h GROUP BY rule),
s AS (SELECT rule, m, CASE WHEN v > 0 THEN least(1000, greatest(1, m * (1 - m) / v - 1)) ELSE 1000 END AS a FROM b),
q AS (SELECT source, rule, (k + m * a) / (n + a) AS mean, n + a AS size FROM h JOIN s USING (rule)),
y AS (SELECT source, max(mean) FILTER (rule = 'a') AS host_rate, max(low) FILTER (rule = 'a') > 0.5 AS bad, max(low) FILTER (rule = 's') >= 0.01 AS hs, max(low) FILTER (rule = 'l') >= 0.01 AS hl FROM (SELECT *, mean - 2 * sqrt(mean * (1 - mean) / (size + 1)) AS low FROM q) GROUP BY source),
z AS (SELECT x.*, host_rate, coalesce(bad OR (sf AND hs) OR (lf AND hl), false) AS host_gone FROM x LEFT JOIN y ON y.source = x.source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT host_gone AS kept, source, round(host_rate, 6) AS host_rate, host_gone FROM z"""

SHARDING = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda x, i: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)), CAST(n AS BIGINT))) AS t),
b AS (SELECT doc_id, md5(text) AS key, octet_length(encode(text)) + 16 AS size, list_transform(range(0, octet_length(encode(text))), lambda i: CAST(('0x' || substr(hex(encode(text)), 2 * i + 1, 2)) AS BIGINT)) AS l FROM d),
r AS (SELECT doc_id, key, size, xor(list_reduce(l, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM b, crc),
g AS (SELECT key, sum(size) AS bytes FROM r GROUP BY key),
p AS (SELECT key, bytes, CAST(sum(bytes) OVER (ORDER BY key) AS BIGINT) AS upto FROM g),
a AS (SELECT list([CAST(0 AS BIGINT), CAST(bytes AS BIGINT)] ORDER BY key) AS l, CAST(max(bytes) AS BIGINT) AS lo, CAST(sum(bytes) AS BIGINT) AS hi FROM g),
s AS (SELECT lo, hi FROM a UNION ALL SELECT CASE WHEN ok THEN lo ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE hi END FROM (SELECT s.lo, s.hi, (s.lo + s.hi) // 2 AS mid, list_reduce(a.l, lambda c, x: CASE WHEN c[2] + x[2] > (s.lo + s.hi) // 2 THEN [c[1] + 1, x[2]] ELSE [c[1], c[2] + x[2]] END, [CAST(1 AS BIGINT), CAST(0 AS BIGINT)])[1] <= 40 AS ok FROM s, a WHERE s.lo < s.hi)),
cap AS (SELECT min(hi) AS c FROM s),
cut AS (SELECT 0 AS k, CAST(0 AS BIGINT) AS at UNION ALL SELECT k + 1, (SELECT max(upto) FROM p WHERE upto <= cut.at + cap.c) FROM cut, cap WHERE k < 39 AND cut.at < (SELECT max(upto) FROM p)),
q AS (SELECT key, (SELECT count(*) FROM cut WHERE k > 0 AND cut.at < p.upto) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM r JOIN q USING (key)"""

DECONTAMINATION = """
WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]', ' ', 'g'), '[^ ]+') AS w FROM documents),
v AS (SELECT item_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]', ' ', 'g'), '[^ ]+') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, unnest(range(0, greatest(1, len(w) - 4))) AS p, unnest(list_transform(range(0, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM w WHERE len(w) > 0),
vs AS (SELECT item_id, len(w) AS m, unnest(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM v WHERE len(w) >= 5),
vc AS (SELECT item_id, m, s, count(*) AS c FROM vs GROUP BY ALL),
hit AS (SELECT doc_id, item_id, n, m, p FROM ds JOIN vc USING (s)),
st AS (SELECT DISTINCT doc_id, item_id, n, m, unnest(range(greatest(0, least(p - (m - 5), greatest(0, n - m))), least(p, greatest(0, n - m)) + 1)) AS start FROM hit),
k AS (SELECT st.doc_id, st.item_id, st.n, st.m, st.start, vc.s, least(count(*), any_value(vc.c)) AS shared FROM st JOIN ds ON ds.doc_id = st.doc_id AND ds.p BETWEEN st.start AND st.start + st.m - 5 JOIN vc ON vc.item_id = st.item_id AND vc.s = ds.s GROUP BY ALL),
z AS (SELECT doc_id, item_id, n, m, start, sum(shared) AS l FROM k GROUP BY ALL),
y AS (SELECT doc_id, item_id, start, least(m, n) AS words, l / CAST(least(m - 4, greatest(1, n - 4)) + m - 4 - l AS DOUBLE) AS sim FROM z),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, start) AS r FROM y WHERE sim >= 0.8)
SELECT doc_id, item_id, start AS start_word, CAST(words AS BIGINT) AS n_words, sim AS similarity FROM x WHERE r = 1"""


def _sized(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_sized, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


_TREE = "SELECT k, 0, i, n, h FROM {0} UNION ALL SELECT k, lv + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM {1} WHERE n > 1 GROUP BY k, lv, i // 2"
_STEP = "CASE WHEN s.h IS NULL THEN 'N' WHEN s.i % 2 = 1 THEN 'R' || s.h ELSE 'L' || s.h END"

MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(':' || lang, '') AS k, {_leaf("n_chars")} AS h, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS other FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
t(k, lv, i, n, h) AS ({_TREE.format("l", "t")}),
r AS (SELECT k AS own, '' AS k, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(k, lv, i, n, h) AS ({_TREE.format("r", "u")}),
a AS (SELECT k, x.i AS i, list({_STEP} ORDER BY lv) AS steps FROM (SELECT l.k, l.i, v.lv, xor(l.i >> v.lv, 1) AS j FROM l JOIN (SELECT DISTINCT k, lv FROM t WHERE n > 1) v ON v.k = l.k) x
  LEFT JOIN (SELECT k AS sk, lv AS sl, i, h FROM t) s ON s.sk = x.k AND s.sl = x.lv AND s.i = x.j GROUP BY k, x.i),
b AS (SELECT own, list({_STEP} ORDER BY lv) AS steps FROM (SELECT r.own, v.lv, xor(r.i >> v.lv, 1) AS j FROM r, (SELECT DISTINCT lv FROM u WHERE n > 1) v) x
  LEFT JOIN (SELECT lv AS sl, i, h FROM u) s ON s.sl = x.lv AND s.i = x.j GROUP BY own),
p AS (SELECT l.doc_id, l.h AS leaf, coalesce(l.other, l.h) AS checked, r.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM l JOIN r ON r.own = l.k LEFT JOIN a ON a.k = l.k AND a.i = l.i LEFT JOIN b ON b.own = l.k),
f AS (SELECT *, list_reduce(steps, lambda x, s: CASE s[1] WHEN 'N' THEN sha256(x) WHEN 'L' THEN sha256(s[2:] || x) ELSE sha256(x || s[2:]) END, checked) AS folded FROM p)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s[2:]), ''), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f"""
