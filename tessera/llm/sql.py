"""SQL of the training-data queries that SQL can express, for DuckDB."""

from __future__ import annotations

_WHITE = r"[ \t\n\x0B\f\r]+"

OP1 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v LEFT JOIN n ON vec_id = n.a JOIN c ON vec_id = c.a"""

OP7 = rf"""WITH d AS (SELECT doc_id, source, len([x FOR x IN regexp_split_to_array(coalesce(text, ''), '{_WHITE}') IF x <> ''])::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, source_size * 3::DOUBLE AS lim FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT *, first_value(CASE WHEN lev * weight <= lim THEN lev END IGNORE NULLS) OVER (ORDER BY lim / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM l),
t AS (SELECT source, source_size, coalesce(least(level * weight, lim), lim) AS target FROM f),
e AS (SELECT d.*, source_size, target, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS cls FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT source, cls, any_value(target) AS target, sum(size) AS class_size, 16::DOUBLE / (16 + cls) AS g FROM e GROUP BY source, cls),
x AS (SELECT source, cls, g, (target - 3 * coalesce(sum(class_size) OVER (PARTITION BY source ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rest, sum(class_size * g) OVER (PARTITION BY source ORDER BY cls ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM c),
k AS (SELECT source, coalesce(arg_min(CASE WHEN below > 0 THEN rest / below ELSE 0 END, cls) FILTER (CASE WHEN below > 0 THEN rest / below ELSE 0 END * g <= 3), 1e300) AS factor FROM x GROUP BY source),
p AS (SELECT e.*, CASE WHEN size > 0 THEN least(3, factor * 16::DOUBLE / (16 + cls)) ELSE 0 END AS expected FROM e JOIN k ON e.source IS NOT DISTINCT FROM k.source),
q AS (SELECT *, floor(expected + 1e-9) AS whole, expected - floor(expected + 1e-9) AS part, (('0x' || substr(md5('17|' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u FROM p),
o AS (SELECT *, CASE WHEN part > 1e-9 THEN (u / (1 - u)) / (part / (1 - part)) END AS odds, target - sum(whole * size) OVER (PARTITION BY source) AS missing FROM q),
y AS (SELECT *, CASE WHEN odds IS NOT NULL THEN sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY floor(odds / (1 + odds) * 281474976710656), doc_id ROWS UNBOUNDED PRECEDING) END AS upto FROM o)
SELECT doc_id, size, source_size, round(target, 6) AS target, ((whole + CASE WHEN upto - size / 2 <= missing THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM y"""

_MARKS = r"^(?:[ \t]*>)+"
_INTRODUCES = r"(?i)^.*\b(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"


def _units(text: str) -> str:
    """Distinct normalised units of a text: the whole, paragraphs, lines."""
    parts = rf"[{text}] || string_split_regex({text}, '\n[ \t]*\n') || string_split({text}, chr(10))"
    normal = f"[lower(trim(regexp_replace(x, '{_WHITE}', ' ', 'g'))) FOR x IN {parts}]"
    return f"list_distinct([y FOR y IN {normal} IF y <> ''])"


OP4 = rf"""WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, * FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text, count(*) AS copies FROM conversations GROUP BY ALL)),
c AS (SELECT id, string_split_regex(text, '\r?\n') AS ls FROM m),
r AS (SELECT id, unnest(range(len(ls))) AS i, unnest(ls) AS raw FROM c),
l AS (SELECT id, i, length(regexp_replace(regexp_extract(raw, '{_MARKS}'), '[^>]', '', 'g')) AS level, regexp_replace(raw, '{_MARKS}[ \t]?', '') AS line FROM r),
n AS (SELECT id, (count(*) FILTER (level > 0))::INT AS n_quoted FROM l GROUP BY id),
b AS (SELECT id, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS body FROM l JOIN n USING (id) WHERE level = 0 AND NOT (n_quoted > 0 AND regexp_matches(line, '{_INTRODUCES}')) GROUP BY id),
d AS (SELECT m.*, n_quoted, coalesce(body, '') AS body FROM m JOIN n USING (id) LEFT JOIN b USING (id)),
u AS (SELECT id, conv_id, turn, unnest({_units('body')}) AS unit FROM d WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
f AS (SELECT conv_id, unit, min(turn) AS t, arg_min(id, turn) AS id FROM u GROUP BY conv_id, unit),
e AS (SELECT unit, arg_min({{'c': conv_id, 't': t, 'id': id}}, {{'c': conv_id, 't': t}}) AS v FROM f GROUP BY unit),
k AS (SELECT DISTINCT id, level FROM l WHERE level > 0),
g AS (SELECT k.id, k.level, string_agg(CASE WHEN l.level = k.level THEN line ELSE '' END, chr(10) ORDER BY i) AS quoted FROM k JOIN l ON k.id = l.id GROUP BY k.id, k.level),
a AS (SELECT g.id, conv_id, turn, level, unnest({_units('quoted')}) AS unit FROM g JOIN d USING (id) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
h AS (SELECT a.id, a.conv_id, level, length(a.unit) AS size, CASE WHEN f.t < turn THEN {{'c': a.conv_id, 't': f.t, 'id': f.id}} WHEN v.c < a.conv_id OR (v.c = a.conv_id AND v.t < turn) THEN v END AS up FROM a LEFT JOIN f ON f.conv_id = a.conv_id AND f.unit = a.unit LEFT JOIN e ON e.unit = a.unit),
o AS (SELECT id, up, row_number() OVER (PARTITION BY id ORDER BY level, (up.c = conv_id) DESC, size DESC, up.t, up.c DESC) AS place, level FROM h WHERE up IS NOT NULL),
y AS (SELECT id, any_value(up) FILTER (place = 1) AS up, count(DISTINCT level) AS n_linked FROM o GROUP BY id),
p AS (SELECT id, up.id AS top, 1 AS depth FROM y UNION ALL SELECT p.id, y.up.id, depth + 1 FROM p JOIN y ON p.top = y.id),
z AS (SELECT id, arg_max(top, depth) AS top, max(depth)::BIGINT AS depth FROM p GROUP BY id),
w AS (SELECT d.*, coalesce(n_linked, 0) AS n_linked, y.up.c AS reply_conv, y.up.t AS reply_turn, coalesce(CASE WHEN q.conv_id = d.conv_id THEN q.turn ELSE d.turn END, d.turn) AS thread_turn, coalesce(depth, 0) AS depth FROM d LEFT JOIN y ON y.id = d.id LEFT JOIN z ON z.id = d.id LEFT JOIN m q ON q.id = z.top)
SELECT conv_id, turn, role, copies, n_quoted, n_linked, reply_conv, reply_turn, thread_turn, depth, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn, turn, role NULLS FIRST, id) END AS position, body FROM w"""

ORACLE_SQL = {"op4_quote_threads": OP4, "op1_embedding_dedup": OP1, "op7_pareto_mix": OP7}
