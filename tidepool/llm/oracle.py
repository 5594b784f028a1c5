"""DuckDB SQL for the queries that SQL can express, written independently of the operators."""

from __future__ import annotations

from . import chat, quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
e AS (SELECT *, CASE WHEN size > 0 THEN CAST(floor(log2(size)) AS INT) ELSE 0 END AS lvl FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
s1 AS (SELECT *, CAST([1.0, 2.0, 3.0][((sid - 1) % 3) + 1] AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS room, CAST(sum(source_size) OVER () AS DOUBLE) AS amount FROM s0),
s2 AS (SELECT *, room / w AS ratio,
    greatest(0.0, amount - coalesce(sum(room) OVER (ORDER BY room / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(w) OVER (ORDER BY room / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s1),
s3 AS (SELECT source, sid, source_size, coalesce(least(room, max(CASE WHEN ratio >= lv THEN lv END) OVER () * w), room) AS target FROM s2),
l0 AS (SELECT s3.sid, s3.target, e.lvl, CAST(sum(e.size) AS BIGINT) AS lvl_size FROM e JOIN s3 ON e.source IS NOT DISTINCT FROM s3.source GROUP BY ALL HAVING sum(e.size) > 0),
l1 AS (SELECT *, lvl_size * pow(2.0, -0.25 * lvl) AS w, CAST(3 * lvl_size AS DOUBLE) AS room FROM l0),
l2 AS (SELECT *, room / w AS ratio,
    greatest(0.0, target - coalesce(sum(room) OVER (PARTITION BY sid ORDER BY room / w, lvl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(w) OVER (PARTITION BY sid ORDER BY room / w, lvl ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM l1),
l3 AS (SELECT *, least(3.0, coalesce(least(room, max(CASE WHEN ratio >= lv THEN lv END) OVER (PARTITION BY sid) * w), room) / lvl_size) AS expect FROM l2),
l4 AS (SELECT *, CAST(floor(expect) AS BIGINT) AS whole, target - sum(CAST(floor(expect) AS BIGINT) * lvl_size) OVER (PARTITION BY sid) AS rest FROM l3),
k AS (SELECT e.doc_id, e.size, s3.sid, s3.source_size, s3.target, l4.whole, l4.rest, l4.expect - l4.whole AS f,
    (CAST('0x' || substr(md5('17|' || coalesce(CAST(e.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM e JOIN s3 ON e.source IS NOT DISTINCT FROM s3.source LEFT JOIN l4 ON l4.sid = s3.sid AND l4.lvl = e.lvl),
r AS (SELECT *, CASE WHEN f > 0 AND size > 0 THEN (u / (1 - u)) / (f / (1 - f)) END AS rank FROM k),
o AS (SELECT *, coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY sid ORDER BY rank NULLS LAST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * (coalesce(whole, 0) + CASE WHEN rank IS NOT NULL AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""


def _op2() -> str:
    outside = [p.replace("'", "''") for p in quality.CLASSES.values()]
    classes = ", ".join(f"length(regexp_replace(t, '{p}', '', 'g'))" for p in outside)
    common = " ".join(f"WHEN '{g}' THEN [{', '.join(chr(39) + w + chr(39) for w in ws)}]" for g, ws in quality.COMMON.items())
    known = ", ".join(f"'{g}'" for g in quality.COMMON)
    given = ", ".join(f"('{k[0]}', '{g}', {i}, {n})" for g, ref in quality.REFERENCES.items() for k, ns in ref.items() for i, n in enumerate(ns, 1))
    blank = r"length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
w AS (SELECT rid, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT rid, i, word AS a, lead(word, 1) OVER z AS b, lead(word, 2) OVER z AS c FROM w WINDOW z AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g WHERE c IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT p) AS n_rep FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY rid),
c0 AS (SELECT rid, lang, length(t) AS total, [{classes}, {blank}] AS c FROM d),
c1 AS (SELECT rid, lang, total, list_append(c, total - list_sum(c)) AS c FROM c0),
ch AS (SELECT rid, lang, unnest(c) AS n, generate_subscripts(c, 1) AS i FROM c1),
hits AS (SELECT rid, list_position(CASE lang {common} END, lower(word)) AS i FROM w WHERE lang IN ({known})),
wn AS (SELECT rid, CASE WHEN i IS NULL OR i = 0 THEN 25 ELSE i END AS i, count(*) AS n FROM hits GROUP BY ALL),
wo AS (SELECT d.rid, d.lang, x.i, coalesce(wn.n, 0) AS n FROM d CROSS JOIN range(1, 26) x(i) LEFT JOIN wn ON wn.rid = d.rid AND wn.i = x.i WHERE d.lang IN ({known})),
bo AS (SELECT 'c' AS kind, rid, lang, i, n FROM ch UNION ALL SELECT 'w', rid, lang, i, n FROM wo),
refs AS (SELECT kind, lang, i, n / CAST(sum(n) OVER (PARTITION BY kind, lang) AS DOUBLE) AS q FROM (VALUES {given}) x(kind, lang, i, n)),
p AS (SELECT kind, rid, lang, i, CASE WHEN sum(n) OVER (PARTITION BY kind, rid) > 0 THEN n / CAST(sum(n) OVER (PARTITION BY kind, rid) AS DOUBLE) END AS p FROM bo),
js AS (SELECT p.kind, p.rid, p.lang AS mine, refs.lang AS theirs,
    sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS js
  FROM p JOIN refs ON refs.kind = p.kind AND refs.i = p.i WHERE p IS NOT NULL GROUP BY ALL),
best AS (SELECT rid, min(CASE WHEN kind = 'c' AND mine = theirs THEN js END) AS cj, min(CASE WHEN kind = 'w' AND mine = theirs THEN js END) AS wj FROM js GROUP BY rid),
o AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words, length(t) AS chars, cj, wj
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN best USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR coalesce(chars >= {quality.MIN_CHARS} AND cj > {quality.MAX_CHAR_JS}, false) OR coalesce(n_words >= {quality.MIN_WORDS} AND wj > {quality.MAX_WORD_JS}, false)) AS kept FROM o
"""


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ws FROM documents),
b0 AS (SELECT item_id, {_TERMS} AS ws FROM benchmark),
b1 AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(ws) - 8, 0) + 2), lambda i: ws[i:i + 7])) AS g FROM b0 WHERE len(ws) > 0),
b AS (SELECT DISTINCT item_id, array_to_string(g, ' ') AS g, len(g) AS n FROM b1),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
l AS (SELECT rid, i, list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM w),
f AS (SELECT l.rid, l.i, x.n, array_to_string(l.g[1:x.n], ' ') AS g FROM l, (SELECT DISTINCT n FROM b) x WHERE len(l.g) >= x.n),
m AS (SELECT f.rid, f.i, f.n, b.item_id FROM f JOIN b USING (g, n)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM m)) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN n USING (rid)
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
l AS (SELECT doc_id, n, i, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS g FROM w),
s AS (SELECT DISTINCT doc_id, g FROM l WHERE i <= greatest(n - 4, 1)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT x.a, x.b FROM x JOIN c ca ON ca.doc_id = x.a JOIN c cb ON cb.doc_id = x.b WHERE 100 * x.i >= 85 * (ca.n + cb.n - x.i)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN c USING (doc_id) JOIN m ON m.a = d.doc_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
g AS (SELECT doc_id, word, i, n, CASE WHEN i <= n - 49 THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS h FROM w),
f AS (SELECT h, min(doc_id) AS first FROM g WHERE h IS NOT NULL GROUP BY h),
x AS (SELECT g.doc_id, g.word, g.i, max(CASE WHEN f.first < g.doc_id THEN g.i END) OVER (PARTITION BY g.doc_id ORDER BY g.i) AS last FROM g LEFT JOIN f ON f.h = g.h),
y AS (SELECT doc_id, count(*) FILTER (i - last < 50) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (coalesce(i - last >= 50, true)) AS kept FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id)
"""

_STEP = chat.stride(chat.BUDGET, chat.HISTORY)
OP10 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS ord, 4 + CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tok,
    23 + length(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|nl|>')) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS chars FROM c),
p AS (SELECT *, ord = 1 AND role = 'system' AS sys, coalesce(sum(CASE WHEN ord = 1 AND role = 'system' THEN 0 ELSE tok END) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM o),
q AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY s // {_STEP}) AS win FROM p),
f AS (SELECT conv_id, win, min(s) AS s FROM q GROUP BY ALL),
z AS (SELECT q.*, NOT q.sys AND coalesce(f.s - q.s <= {chat.HISTORY}, false) AS again FROM q LEFT JOIN f ON f.conv_id = q.conv_id AND f.win = q.win + 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY ord) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars * (1 + CAST(again AS INT))) + coalesce(max(CASE WHEN sys THEN chars END), 0) * (max(win) - 1) AS BIGINT) AS formatted_chars
FROM z GROUP BY conv_id
"""

ORACLE = {
    "op1_pareto_mix": OP1,
    "op2_distribution_divergence": _op2(),
    "op3_positional_index": OP3,
    "op8_minhash": OP8,
    "op9_recompression": OP9,
    "op10_chat_windows": OP10,
}
