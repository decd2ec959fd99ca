"""The SQL, for DuckDB, of the operators that it can express exactly."""

from __future__ import annotations

from . import quality

JACCARD_JOIN = r"""WITH RECURSIVE d AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
n AS (SELECT row_number() OVER (ORDER BY t) AS i, t FROM d),
w AS (SELECT i, unnest(x) AS w, unnest(range(len(x))) AS p, len(x) AS size FROM (SELECT i, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS x FROM n)),
s AS (SELECT DISTINCT i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS g FROM w WINDOW o AS (PARTITION BY i ORDER BY p) QUALIFY p = 0 OR p <= size - 5),
sizes AS (SELECT i, count(*) AS k FROM s GROUP BY i),
met AS (SELECT a.i AS a, b.i AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.i < b.i GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.i = a JOIN sizes y ON y.i = b WHERE 5 * shared >= 4 * (x.k + y.k - shared)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(i, j) AS (SELECT i, i FROM n UNION SELECT reach.i, ends.b FROM reach JOIN ends ON ends.a = reach.j),
classes AS (SELECT i, min(j) AS root FROM reach GROUP BY i),
copies AS (SELECT coalesce(text, '') AS t, min(doc_id) AS copy_of FROM documents GROUP BY 1),
members AS (SELECT i, root, t, copy_of FROM n JOIN classes USING (i) JOIN copies USING (t)),
least AS (SELECT root, min(copy_of) AS class_id FROM members GROUP BY root),
counts AS (SELECT a AS i, count(*) AS k FROM ends GROUP BY a)
SELECT x.doc_id, r.copy_of, l.class_id, CAST(coalesce(c.k, 0) AS BIGINT) AS n_links
FROM documents x JOIN members r ON r.t = coalesce(x.text, '') JOIN least l USING (root) LEFT JOIN counts c USING (i)"""

#: The digest of a text stands for it here as in the operator, so that ties fall alike.
QUOTATION_LINKS = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS t, md5(coalesce(text, '')) AS msg FROM conversations),
l AS (SELECT r, unnest(x) AS line, unnest(range(len(x))) AS k, len(x) AS n FROM (SELECT r, string_split(t, chr(10)) AS x FROM d WHERE contains(t, '>'))),
w AS (SELECT r, k, n, len(regexp_replace(p, '[^>]', '', 'g')) AS level, substr(line, length(p) + 1) AS words FROM (SELECT *, regexp_extract(line, '^[ \t]*(>[ \t]?)+') AS p FROM l)),
b AS (SELECT *, NOT regexp_matches(words, '[^ \t\r\f\v]') AS blank, lead(level) OVER (PARTITION BY r ORDER BY k) AS next_level FROM w),
c AS (SELECT *, coalesce(lead(CASE WHEN level > 0 OR NOT blank THEN level END IGNORE NULLS) OVER (PARTITION BY r ORDER BY k), 0) > level
    AND regexp_matches(words, ':[ \t]*$') AND regexp_matches(words, '(?i)(^|[^a-z])(wrote|writes|schrieb|écrit|escribió)([^a-z]|$)') AS told,
  blank AND (level > 0 OR (k + 1 < n AND next_level = 0)) AS may_follow FROM b),
f AS (SELECT *, may_follow AND count(*) FILTER (NOT told) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS follows FROM c),
g AS (SELECT * FROM f WHERE follows OR NOT told),
h AS (SELECT *, CASE WHEN follows THEN NULL WHEN lag(CASE WHEN NOT follows THEN level END IGNORE NULLS) OVER (PARTITION BY r ORDER BY k) IS NOT DISTINCT FROM level THEN 0 ELSE 1 END AS new FROM g),
i AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY r ORDER BY k) AS p FROM h),
passages AS (SELECT r, p, max(level) FILTER (NOT follows) AS level, regexp_replace(string_agg(CASE WHEN follows THEN '' ELSE words END, chr(10) ORDER BY k), '^\n+|\n+$', '', 'g') AS said
  FROM i GROUP BY r, p HAVING bool_or(NOT blank)),
own AS (SELECT d.*, CASE WHEN contains(t, '>') THEN coalesce((SELECT string_agg(said, chr(10) ORDER BY p) FROM passages x WHERE x.r = d.r AND level = 0), '') ELSE t END AS own_text FROM d),
cut AS (SELECT r, 0 AS p, 0 AS level, own_text AS said FROM own UNION ALL SELECT r, p, level, said FROM passages WHERE level > 0),
units AS (SELECT r, p, level, 2 AS part, said AS u FROM cut UNION ALL SELECT r, p, level, 1, unnest(string_split(regexp_replace(said, '\n([ \t]*\n)+', chr(1), 'g'), chr(1))) FROM cut
  UNION ALL SELECT r, p, level, 0, unnest(string_split(said, chr(10))) FROM cut),
plain AS (SELECT r, p, level, max(part) AS part, u FROM (SELECT r, p, level, part, trim(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g')) AS u FROM units) WHERE u <> '' GROUP BY r, p, level, u),
sources AS (SELECT conv_id, u, min({'turn': turn, 'msg': msg}) AS source FROM plain JOIN d USING (r) WHERE level = 0 AND turn IS NOT NULL GROUP BY conv_id, u),
met AS (SELECT d.conv_id, d.turn, d.msg, level, p, max({'part': part, 'turn': s.source.turn, 'msg': s.source.msg}) AS best FROM plain JOIN d USING (r) JOIN sources s ON s.conv_id = d.conv_id AND s.u = plain.u
  WHERE level > 0 AND s.source.turn < d.turn GROUP BY ALL),
links AS (SELECT conv_id, turn, msg, count(*) AS n_linked, min({'level': level, 'back': -best.turn, 'to': best.msg}) AS best FROM met GROUP BY ALL),
chain AS (SELECT conv_id, turn, msg, -best.back AS thread, best.to AS at, 1 AS depth FROM links
  UNION ALL SELECT c.conv_id, c.turn, c.msg, -x.best.back, x.best.to, depth + 1 FROM chain c JOIN links x ON x.conv_id = c.conv_id AND x.turn = c.thread AND x.msg = c.at),
tops AS (SELECT conv_id, turn, msg, arg_max(thread, depth) AS thread, max(depth) AS depth FROM chain GROUP BY ALL),
counts AS (SELECT r, count(DISTINCT p) AS n_quotes FROM plain WHERE level > 0 GROUP BY r)
SELECT o.conv_id, o.turn, o.role, o.own_text, CAST(coalesce(n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, -x.best.back AS reply_to,
  coalesce(t.thread, o.turn) AS thread, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth
FROM own o LEFT JOIN counts USING (r) LEFT JOIN links x ON x.conv_id = o.conv_id AND x.turn = o.turn AND x.msg = o.msg LEFT JOIN tops t ON t.conv_id = o.conv_id AND t.turn = o.turn AND t.msg = o.msg"""

_QUALITY = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(x) AS w, unnest(range(len(x))) AS p FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS x FROM d)),
g AS (SELECT r, p, CASE WHEN lead(p, 7) OVER s IS NOT NULL THEN [w, lead(w, 1) OVER s, lead(w, 2) OVER s, lead(w, 3) OVER s, lead(w, 4) OVER s, lead(w, 5) OVER s, lead(w, 6) OVER s, lead(w, 7) OVER s] END AS g
  FROM w WINDOW s AS (PARTITION BY r ORDER BY p)),
often AS (SELECT r, unnest(ps) AS p FROM (SELECT r, list(p) AS ps FROM g WHERE g IS NOT NULL GROUP BY r, g HAVING count(*) > 1)),
covered AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, p + k AS q FROM often, range(8) AS s(k)) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
c AS (SELECT d.r, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN counts USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
e AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
m AS (SELECT r, lang, source, base_failed, unnest({rates}) AS metric,
    unnest([coalesce(n_symbols / nullif(n_words, 0), 0), coalesce(n_dup_lines / nullif(n_lines, 0), 0), coalesce(n_repeat_words / nullif(n_words, 0), 0), coalesce(word_chars / nullif(n_words, 0), 0)]::DOUBLE[]) AS v,
    unnest([1 / sqrt(nullif(n_words, 0)), 1 / sqrt(nullif(n_lines, 0)), 1 / sqrt(nullif(n_words, 0) / {clump}), word_chars / n_words / sqrt(nullif(n_words, 0))]::DOUBLE[]) AS less FROM e),
k AS (SELECT metric, v, level, CASE WHEN level < 2 THEN lang END AS lang, CASE WHEN level < 1 THEN source END AS source FROM m, range(3) AS s(level) WHERE NOT base_failed),
b AS (SELECT level, lang, source, metric, CASE WHEN v > 0 THEN ceil(ln(v) / ln({ratio})) END AS bucket, count(*) AS n FROM k GROUP BY ALL),
u AS (SELECT *, CASE WHEN bucket IS NULL THEN 0 ELSE 2 * pow({ratio}, bucket) / ({ratio} + 1) END AS value,
    sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM b),
p AS (SELECT level, lang, source, metric, min(value) FILTER (upto >= ceil(0.25 * total)) AS q0, min(value) FILTER (upto >= ceil(0.75 * total)) AS q1, max(total) AS size FROM u GROUP BY ALL),
q AS (SELECT *, q1 + {spread} * (q1 - q0) AS most FROM p),
t AS (SELECT s.lang, s.source, s.metric, s.size, s.most, CASE WHEN x.size < {least} AND s.metric <> 'word_length' THEN y.most ELSE x.most END AS above
  FROM q s JOIN q x ON s.level = 0 AND x.level = 1 AND x.lang IS NOT DISTINCT FROM s.lang AND x.metric = s.metric JOIN q y ON y.level = 2 AND y.metric = s.metric),
far AS (SELECT m.r FROM m JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source AND m.metric = t.metric
  WHERE coalesce(v - less, 0) > CASE WHEN size < {least} THEN above ELSE least(most, above) END)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM far) AS kept FROM e"""


def adaptive_quality() -> str:
    """The query of :func:`quality.judged` over ``documents``, in sketches of the same buckets."""
    rates = "[" + ", ".join(f"'{r}'" for r in quality.RATES) + "]"
    ratio = f"({1 + quality.ERROR}::DOUBLE / {1 - quality.ERROR}::DOUBLE)"
    return _QUALITY.format(rates=rates, ratio=ratio, spread=quality.SPREAD, least=quality.LEAST_GROUP, clump=2.0 * quality.WINDOW)
