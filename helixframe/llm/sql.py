"""SQL of the contracts that SQL can express on whole tables."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = f"""WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, list_slice(w, s, s + n - 1) AS g FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dg.n, item FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
iv AS (SELECT item, row_number() OVER () AS r, w FROM iw WHERE len(w) > 0), it AS (SELECT r, item, word, min(p) AS p FROM (SELECT r, item, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM iv) GROUP BY 1, 2, 3), dp AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM dw),
tc AS (SELECT word, count(*) AS n FROM dp SEMI JOIN it ON it.word = dp.word GROUP BY 1), rare AS (SELECT r, item, word, k, count(*) OVER (PARTITION BY r) AS m FROM (SELECT it.*, row_number() OVER (PARTITION BY r ORDER BY n, it.p) AS k FROM it JOIN tc ON tc.word = it.word) WHERE k <= 4),
oc AS (SELECT doc_id, r, item, k, m, dp.p FROM dp JOIN rare ON rare.word = dp.word), nr AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM (SELECT a.doc_id, a.item, a.r, a.p FROM oc a LEFT JOIN oc b ON b.doc_id = a.doc_id AND b.r = a.r AND b.k > 1 AND abs(b.p - a.p) <= 32 WHERE a.k = 1 GROUP BY a.doc_id, a.item, a.r, a.p, a.m HAVING count(DISTINCT b.k) = a.m - 1) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM dw LEFT JOIN nr ON nr.doc_id = dw.doc_id LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id"""

_BLACK = r"'[^\x20\x09-\x0D]+'"

OP3 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents), w AS (SELECT r, doc_id, t, regexp_extract_all(t, {_BLACK}) AS w FROM d),
l AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_BLACK}) GROUP BY 1, 2), ls AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(n - 1) AS BIGINT) AS n_dup FROM l GROUP BY 1),
g AS (SELECT r, s, list_slice(w, s, s + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS s FROM w WHERE len(w) >= 3)), h AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1), m AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([s, s + 1, s + 2]) AS p FROM h) GROUP BY 1),
b AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(m.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
 length(t) - length(replace(t, '!', '')) AS bang, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS letters FROM w LEFT JOIN ls ON ls.r = w.r LEFT JOIN m ON m.r = w.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 25 * n_words OR 100 * bang > 50 * n_words OR 100 * up > 60 * letters OR word_chars > 20 * n_words OR 10 * word_chars < 15 * n_words OR 100 * n_dup_lines > 60 * n_lines) AS kept FROM b"""

OP5 = """WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents), x AS (SELECT r, doc_id, hex(encode(t)) AS h FROM d),
g AS (SELECT r, doc_id, s, md5_number(substring(h, 2 * s + 1, 200)) AS g FROM (SELECT r, doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS s FROM x WHERE doc_id IS NOT NULL)),
w AS (SELECT r, s FROM (SELECT r, s, doc_id, first_value(doc_id) OVER o AS d1, first_value(s) OVER o AS s1 FROM g WINDOW o AS (PARTITION BY g ORDER BY doc_id, s)) WHERE (doc_id, s) <> (d1, s1)),
e AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM w),
i AS (SELECT r, s, sum(CASE WHEN before IS NULL OR s > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s ROWS UNBOUNDED PRECEDING) AS isle FROM e),
c AS (SELECT r, min(s) AS lo, max(s) + 100 AS hi FROM i GROUP BY r, isle),
k AS (SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM c GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(CASE WHEN k.r IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(los) + 1), lambda j: substring(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE his[j] END) + 1, 2 * ((CASE WHEN j = len(los) THEN length(h) // 2 ELSE los[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE his[j] END)))), '') END)) AS kept_sha256
FROM x LEFT JOIN k ON k.r = x.r"""

OP9 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, {_BLACK}) AS w FROM documents), s AS (SELECT DISTINCT doc_id, md5(array_to_string(g, ' ')) AS g FROM (SELECT doc_id, list_slice(w, k, k + 3) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS k FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), few AS (SELECT g FROM s GROUP BY 1 HAVING count(*) > 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id SEMI JOIN few ON few.g = a.g GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT two.b, r.root FROM r JOIN two ON two.a = r.node), c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id"""

OP10 = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
ky AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
q AS (SELECT key, max(doc_id) AS last FROM ky WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last IS NOT NULL AND last <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM ky LEFT JOIN q USING (key) GROUP BY doc_id"""

OP11 = f"""WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), {_BLACK}) AS w FROM documents),
g AS (SELECT doc_id, r, s, md5(array_to_string(list_slice(w, s, s + 12), ' ')) AS g
 FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 11)) AS s FROM w WHERE len(w) >= 13 AND doc_id IS NOT NULL)),
h AS (SELECT r, s FROM (SELECT doc_id, r, s, min(doc_id) OVER (PARTITION BY g) AS low FROM g) WHERE doc_id > low),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 13)) AS p FROM h),
p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
k AS (SELECT p.r, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (gone.p IS NULL) AS kept
 FROM p LEFT JOIN gone ON gone.r = p.r AND gone.p = p.p GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.r = w.r"""


def _step(k: int) -> str:
    return f"""x{k} AS (SELECT s.*, e.ts AS stop FROM s{k - 1} s ASOF LEFT JOIN e ON e.client_id = s.client_id AND e.kind = s.no AND s.t{k - 1} < e.ts),
y{k} AS (SELECT x.*, e.ts AS t{k} FROM x{k} x ASOF JOIN e ON e.client_id = x.client_id AND e.kind = x.k{k} AND x.t{k - 1} < e.ts),
s{k} AS (SELECT * EXCLUDE (stop) FROM y{k} WHERE t{k} - t{k - 1} <= INTERVAL 15 MINUTE AND (stop IS NULL OR stop > t{k})),
m{k} AS (SELECT funnel, client_id, any_value(n) AS n, max(d) FILTER (r = (n + 1) // 2) AS t FROM
 (SELECT funnel, client_id, d, row_number() OVER (PARTITION BY funnel, client_id ORDER BY d) AS r, count(*) OVER (PARTITION BY funnel, client_id) AS n
  FROM (SELECT funnel, client_id, epoch_us(t{k}) - epoch_us(t{k - 1}) AS d FROM s{k})) GROUP BY 1, 2)"""


OP12 = f"""WITH e AS (SELECT DISTINCT client_id, kind, ts FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL),
f(funnel, k1, k2, k3, k4, no) AS (VALUES ('A', 'view', 'click', 'view', 'purchase', 'error'),
 ('B', 'signup', 'view', 'click', 'purchase', 'error'), ('C', 'click', 'click', 'purchase', 'view', 'signup')),
s1 AS (SELECT f.*, e.client_id, e.ts AS t1 FROM e JOIN f ON e.kind = f.k1),
m1 AS (SELECT funnel, client_id, count(*) AS n FROM s1 GROUP BY 1, 2),
{_step(2)},
{_step(3)},
{_step(4)},
a AS (SELECT m1.funnel, m1.client_id, m1.n AS n1, coalesce(m2.n, 0) AS n2, coalesce(m3.n, 0) AS n3, coalesce(m4.n, 0) AS n4, m2.t AS t2, m3.t AS t3, m4.t AS t4,
 CAST(CASE WHEN m4.n > 0 THEN 4 WHEN m3.n > 0 THEN 3 WHEN m2.n > 0 THEN 2 ELSE 1 END AS INTEGER) AS deepest
 FROM m1 LEFT JOIN m2 USING (funnel, client_id) LEFT JOIN m3 USING (funnel, client_id) LEFT JOIN m4 USING (funnel, client_id))
SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM a"""

_HEX = "CAST(CAST('0x' || substr(h, {}, 8) AS UBIGINT) AS BIGINT)"
_NL = "chr(10)"

OP13 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, string_split(t, {_NL}) AS l, length(t) - length(replace(t, {_NL}, '')) AS nl FROM d),
c AS (SELECT *, nl + CASE WHEN t <> '' AND NOT suffix(t, {_NL}) THEN 1 ELSE 0 END AS n FROM u),
k AS (SELECT *, least({_HEX.format(1)} % (n + 1), {_HEX.format(9)} % (n + 1)) AS a, greatest({_HEX.format(1)} % (n + 1), {_HEX.format(9)} % (n + 1)) AS b,
 t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_HEX.format(17)} % 100 >= 100 AS plain, {_HEX.format(25)} % 100 < 50 AS rear FROM c),
p AS (SELECT *, length(array_to_string(list_slice(l, 1, a), {_NL}) || CASE WHEN a BETWEEN 1 AND nl THEN {_NL} ELSE '' END) AS x,
 length(array_to_string(list_slice(l, 1, b), {_NL}) || CASE WHEN b BETWEEN 1 AND nl THEN {_NL} ELSE '' END) AS y FROM k),
o AS (SELECT *, substring(t, 1, x) AS pre, substring(t, x + 1, y - x) AS mid, substring(t, y + 1) AS suf FROM p)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN rear THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN x END AS prefix_chars, CASE WHEN NOT plain THEN y - x END AS middle_chars,
 sha256(CASE WHEN plain THEN t WHEN rear THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
