"""SQL for DuckDB that gives the same rows as the pN_ queries, where plain SQL is quick enough on whole tables."""

from __future__ import annotations

from .ranking import _A, _B, _C, _D

_LATEST = """latest AS (SELECT * FROM memories WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, {rest}) = 1)"""

_P1 = f"""
WITH {_LATEST.format(rest="session_id DESC, importance DESC, confidence DESC, access_count DESC")},
c AS (SELECT memory_id, max(centrality) AS centrality FROM graph_nodes WHERE kind = 'memory' GROUP BY 1),
s AS (SELECT l.session_id, l.id AS memory_id, importance AS s1, confidence AS s2, CAST(access_count AS DOUBLE) AS s3, centrality AS s4
      FROM latest l LEFT JOIN c ON c.memory_id = l.id WHERE session_id IS NOT NULL),
r AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n,
  {" + ".join(f"rank() OVER (PARTITION BY session_id ORDER BY s{i} NULLS FIRST) + (count(*) OVER (PARTITION BY session_id, s{i}) - 1) / 2.0" for i in range(1, 5))} AS place FROM s)
SELECT session_id, memory_id FROM r WHERE n >= 12
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY place DESC, memory_id) = 1
"""

_P2 = """
WITH c AS (SELECT ch.id, ch.text, coalesce(g.max_chunk_size, s.max_chunk_size) AS most FROM code_chunks ch
  LEFT JOIN chunk_configs g ON g.lang = ch.lang LEFT JOIN chunk_configs s ON s.lang = '*')
SELECT DISTINCT id AS chunk_id FROM c WHERE length(regexp_replace(text, '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+', '', 'g')) > most
"""

_P6 = f"""
WITH {_LATEST.format(rest="content DESC")},
w AS (SELECT id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS term FROM latest WHERE content IS NOT NULL),
tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) BETWEEN 2 AND 12),
t AS (SELECT DISTINCT id, lower(trim(tag, E' \\t\\n\\r')) AS term FROM (SELECT id, unnest(tags) AS tag FROM latest) WHERE tag IS NOT NULL),
td AS (SELECT term, count(*) AS df FROM t WHERE term <> '' GROUP BY 1 HAVING count(*) BETWEEN 2 AND 12)
SELECT id AS memory_id, 'content' AS field, term FROM tf JOIN df USING (term) WHERE tf >= 3
UNION ALL SELECT id, 'tags', term FROM t JOIN td USING (term)
"""

_P7 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
q AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
qg AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM q))
SELECT DISTINCT doc_id, item_id FROM dg JOIN qg USING (g)
"""


def _poly(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


_Z = f"CASE WHEN lo >= 0.02425 THEN {_poly('r', _A)} * q / ({_poly('r', _B)} * r + 1) WHEN p < 0.5 THEN {_poly('t', _C)} / ({_poly('t', _D)} * t + 1) ELSE -({_poly('t', _C)} / ({_poly('t', _D)} * t + 1)) END"

_P1_RANKING = f"""
WITH {_LATEST.format(rest="session_id DESC, importance DESC, confidence DESC, access_count DESC")},
c AS (SELECT memory_id, max(centrality) AS centrality FROM graph_nodes WHERE kind = 'memory' GROUP BY 1),
s AS (SELECT l.session_id, l.id AS memory_id, importance AS s1, confidence AS s2, CAST(access_count AS DOUBLE) AS s3, centrality AS s4 FROM latest l LEFT JOIN c ON c.memory_id = l.id WHERE session_id IS NOT NULL),
x AS (SELECT session_id, memory_id, k, v FROM (SELECT session_id, memory_id, unnest([1, 2, 3, 4]) AS k, unnest([s1, s2, s3, s4]) AS v FROM s)),
y AS (SELECT *, count(*) OVER (PARTITION BY session_id, k) AS n, (rank() OVER (PARTITION BY session_id, k ORDER BY v NULLS FIRST) - 1 + count(*) OVER (PARTITION BY session_id, k, v) / 2.0) / count(*) OVER (PARTITION BY session_id, k) AS p FROM x),
z AS (SELECT *, least(p, 1 - p) AS lo, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS r, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM y),
g AS (SELECT session_id, memory_id, any_value(n) AS n, round(sum(p * 0.25), 9) AS place, round(sum(0.25 * {_Z}), 9) + 0.0 AS score FROM z GROUP BY 1, 2)
SELECT session_id, memory_id, n, place, score, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, memory_id) AS position FROM g
"""

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_FORM = "array_to_string(" + _WORDS + ", ' ')"

#: cls(id, rep): the smallest id of the copies of each memory.
_COPIES = f"""{_LATEST.format(rest="content DESC")},
m AS (SELECT id, content, trim(content, E' \\t\\n\\r') AS t FROM latest WHERE content IS NOT NULL),
js AS (SELECT id, 'json' AS kind, unnest(json_keys(t)) AS k, t FROM m WHERE starts_with(t, '{{') AND ends_with(t, '}}') AND json_valid(t)),
jf AS (SELECT id, kind, {_FORM.format("k")} || '=' || {_FORM.format("coalesce(json_extract_string(t, '$.\"' || k || '\"'), 'null')")} AS f FROM js),
pp AS (SELECT id, t, list_filter(string_split(t, ';'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS l FROM m WHERE contains(t, '=') AND contains(t, ';') AND id NOT IN (SELECT id FROM js)),
po AS (SELECT id, l FROM pp WHERE len(l) > 1 AND len(list_filter(l, lambda x: NOT regexp_matches(x, '^[\\s>*•-]*([^=;:\n]{{1,80}}?)\\s*='))) = 0),
pf AS (SELECT id, 'pairs' AS kind, {_FORM.format("regexp_extract(x, '^[^=]*')")} || '=' || {_FORM.format("regexp_replace(x, '^[^=]*=', '')")} AS f FROM (SELECT id, unnest(l) AS x FROM po)),
lp AS (SELECT id, t, list_filter(regexp_split_to_array(t, '\\r\\n|\\r|\\n'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS l FROM m WHERE contains(t, ':') AND (contains(t, chr(10)) OR contains(t, chr(13))) AND id NOT IN (SELECT id FROM js) AND id NOT IN (SELECT id FROM po)),
lo AS (SELECT id, l FROM lp WHERE len(l) > 1 AND len(list_filter(l, lambda x: NOT regexp_matches(x, '^[\\s>*•-]*([^:=\n]{{1,80}}?)\\s*:'))) = 0),
lf AS (SELECT id, 'lines' AS kind, {_FORM.format("regexp_extract(x, '^[^:]*')")} || '=' || {_FORM.format("regexp_replace(x, '^[^:]*:', '')")} AS f FROM (SELECT id, unnest(l) AS x FROM lo)),
rk AS (SELECT id, kind || string_agg(DISTINCT f, ';' ORDER BY f) AS key FROM (SELECT * FROM jf UNION ALL SELECT * FROM pf UNION ALL SELECT * FROM lf) GROUP BY id, kind),
ky AS (SELECT id, 's:' || {_FORM.format("content")} AS key FROM m UNION SELECT id, 'r:' || key FROM rk),
cr AS (SELECT id, id AS rep FROM m UNION SELECT b.id, cr.rep FROM cr JOIN ky AS a ON a.id = cr.id JOIN ky AS b ON b.key = a.key WHERE cr.rep < b.id),
cls AS (SELECT id, min(rep) AS rep FROM cr GROUP BY 1)"""

_P3 = f"WITH RECURSIVE {_COPIES} SELECT rep AS rep_id, id AS memory_id FROM cls WHERE id <> rep"
_P3_COPIES = f"WITH RECURSIVE {_COPIES} SELECT rep AS rep_id, count(*) AS copies FROM cls GROUP BY 1"

_P4 = f"""WITH RECURSIVE {_COPIES}, w AS (SELECT DISTINCT id, unnest({_WORDS.format("content")}) AS w FROM m), n AS (SELECT id, count(*) AS n FROM w GROUP BY 1),
k AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM w AS a JOIN w AS b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2)
SELECT a AS id_a, b AS id_b FROM k JOIN n AS x ON x.id = a JOIN n AS y ON y.id = b JOIN cls AS p ON p.id = a JOIN cls AS q ON q.id = b WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9 AND p.rep <> q.rep"""

_P6_TERMS = f"""
WITH {_LATEST.format(rest="content DESC")},
w AS (SELECT id, {_WORDS.format("content")} AS l FROM latest WHERE content IS NOT NULL), tg AS (SELECT id, list_filter(list_transform(tags, lambda t: lower(trim(t, E' \\t\\n\\r'))), lambda t: t IS NOT NULL AND t <> '') AS l FROM latest WHERE tags IS NOT NULL),
b AS (SELECT 'content' AS field, id, l FROM w UNION ALL SELECT 'tags', id, l FROM tg), st AS (SELECT field, count(*) AS n, sum(len(l)) / count(*) AS avgdl FROM b GROUP BY 1),
tf AS (SELECT field, id, len(l) AS dl, term, count(*) AS tf FROM (SELECT field, id, l, unnest(l) AS term FROM b) GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL)
SELECT id AS memory_id, field, term, CAST(tf AS INT) AS tf, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9) AS score FROM tf JOIN df USING (field, term) JOIN st USING (field)
"""

#: TESTDATA: the margins do not hang on the tokenizer, so characters stand for tokens.
_P8 = """
WITH d AS (SELECT lower(trim(source, E' \\t\\n\\r')) AS source, sum(length(text)) AS size FROM documents GROUP BY 1),
t AS (SELECT lower(trim(source, E' \\t\\n\\r')) AS source, sum(target_share) AS share, min(max_repeats) AS most FROM mix_targets GROUP BY 1), h AS (SELECT t.*, coalesce(size, 0) AS size FROM t LEFT JOIN d USING (source))
SELECT source FROM h WHERE most * size < share * (SELECT sum(size) FROM h)
"""

_P9 = """
WITH g AS (SELECT doc_id, hash(substr(text, CAST(i AS INT), 320)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 318)) AS i FROM documents WHERE length(text) >= 320)), u AS (SELECT DISTINCT doc_id, h FROM g),
s AS (SELECT h FROM u GROUP BY 1 HAVING count(*) > 1), k AS (SELECT * FROM u WHERE h IN (SELECT h FROM s))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k AS a JOIN k AS b ON a.h = b.h AND a.doc_id < b.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1, "p1_ranking": _P1_RANKING, "p2_found": _P2, "p3_found": _P3, "p3_copies": _P3_COPIES, "p4_found": _P4,
        "p6_found": _P6, "p6_terms": _P6_TERMS, "p7_found": _P7, "p8_found": _P8, "p9_found": _P9,
    }
