"""Queries over changes, the registry, packages and dashboards; registered beside those of catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import analytics as A
from ..operators import enrich as N
from ..operators import graph as G
from ..operators import jobs as J
from ..operators import linking as L
from ..operators import records as R
from ..operators import registry as Y
from ..operators import review as V
from ..operators import temporal as T
from ..operators import text as X
from ..sources.tables import Store
from .catalog import BEFORE, NOW, _calls, _commits, _lines, query
from .sql import COMMITS, HUB, SQL, TOKENS, ranks

_RUNAWAY = "(SELECT session_id FROM act WHERE session_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, session_id LIMIT 1)"


def _runaway(s: Store) -> str:
    row = s.activity("session_id").where("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "session_id").first()
    return row["session_id"] if row else ""


@query("a02_memory", "WITH k AS (SELECT id FROM mem ORDER BY id LIMIT 3) SELECT id, content, access_count FROM mem WHERE id IN (SELECT id FROM k)")
def _(s: Store) -> DataFrame:
    """Three memories, as they are: reading does not count as access."""
    ids = [r["id"] for r in s.memories("created_at").select("id").orderBy("id").limit(3).collect()]
    return R.by_ids(s.memories("content", "access_count"), ids).select("id", "content", "access_count")


@query("a08_whole_graph", "SELECT id, 'node' AS what FROM nod UNION ALL SELECT id, 'edge' FROM edg ")
def _(s: Store) -> DataFrame:
    return s.nodes().select("id", F.lit("node").alias("what")).union(s.edges().select("id", F.lit("edge")))


@query("a09_graph_node", f"SELECT id, kind, label FROM (SELECT DISTINCT id, kind, label FROM nod ) WHERE id = {HUB}")
def _(s: Store) -> DataFrame:
    from .catalog import _hub

    hub = _hub(s).first()
    return R.by_ids(s.nodes("kind", "label"), [hub["id"]] if hub else [""])


@query("a13_packages", "SELECT regexp_replace(file_path, '/[^/]*$', '') AS package, namespace, count(DISTINCT file_path) AS files FROM chk WHERE contains(file_path, '/') GROUP BY 1, 2")
def _(s: Store) -> DataFrame:
    return Y.packages(s.chunks("file_path", "namespace"))


@query("a14_unresolved", "SELECT id, src, dst FROM (SELECT DISTINCT id, src, dst FROM edg ) WHERE dst NOT IN (SELECT id FROM nod WHERE id IS NOT NULL) AND dst IS NOT NULL")
def _(s: Store) -> DataFrame:
    return Y.unresolved(s.edges("src", "dst").where("dst IS NOT NULL"), s.nodes()).select("id", "src", "dst")


@query("b11_file_hashes", "SELECT coalesce(namespace, '') AS namespace, file_path, sha256(string_agg(sha256(text), '' ORDER BY chunk_index, sha256(text))) AS content_hash FROM (SELECT DISTINCT id, namespace, file_path, chunk_index, text FROM chk ) WHERE text IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2")
def _(s: Store) -> DataFrame:
    return Y.file_hashes(s.chunks("namespace", "file_path", "chunk_index", "text"))


@query("b12_folded_sessions", "SELECT id, namespace, started_at, ended_at, CASE WHEN ended_at IS NOT NULL THEN summary END AS summary FROM ses ")
def _(s: Store) -> DataFrame:
    ses = s.sessions()
    start = ses.select("id", F.lit("start").alias("what"), F.col("started_at").alias("at"), "namespace", F.lit(None).cast("string").alias("summary"))
    end = ses.where("ended_at IS NOT NULL").select("id", F.lit("end"), "ended_at", F.lit(None).cast("string"), "summary")
    return J.folded_sessions(start.union(end)).select("id", "namespace", "started_at", "ended_at", "summary")


_NEW = f"old AS (SELECT * FROM mem WHERE created_at < TIMESTAMP '{BEFORE}'), inc AS (SELECT * FROM mem WHERE created_at >= TIMESTAMP '{BEFORE}'), fresh AS (SELECT * FROM inc WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.content = inc.content AND coalesce(old.namespace, '') = coalesce(inc.namespace, '')) QUALIFY row_number() OVER (PARTITION BY content, coalesce(namespace, '') ORDER BY created_at, id) = 1)"


@query(
    "b18_store_with_links",
    f"""WITH {_NEW}, n0 AS (SELECT DISTINCT id FROM nod WHERE kind <> 'memory'), l AS (SELECT DISTINCT src, dst FROM edg WHERE relationship = 'RELATES_TO' AND src IN (SELECT id FROM fresh) AND (dst IN (SELECT id FROM n0) OR dst IN (SELECT id FROM fresh)))
SELECT 'memories' AS what, count(*) AS n FROM (SELECT id FROM old UNION ALL SELECT id FROM fresh) UNION ALL SELECT 'graph_nodes', count(*) FROM (SELECT id FROM n0 UNION SELECT id FROM fresh) UNION ALL SELECT 'graph_edges', count(*) FROM l""",
)
def _(s: Store) -> DataFrame:
    m = s.memories("content", "namespace", "created_at")
    n = s.nodes("kind", "label", "memory_id", "namespace").where("kind <> 'memory'").dropDuplicates(["id"])
    e = s.edges("src", "dst", "relationship", "weight")
    links = e.where("relationship = 'RELATES_TO'").select(F.col("src").alias("id"), F.col("dst").alias("target"))
    out = Y.store_with_links(m.where(F.col("created_at") < S.ts(BEFORE)), n, e.limit(0), m.where(F.col("created_at") >= S.ts(BEFORE)), links)
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, df in out.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query("b19_associate", "SELECT DISTINCT src || '-RELATES_TO-' || dst AS id, src, dst, 'RELATES_TO' AS relationship, CAST(1 AS DOUBLE) AS weight FROM edg WHERE relationship = 'SHARES_THEME'")
def _(s: Store) -> DataFrame:
    pairs = s.edges("src", "dst", "relationship").where("relationship = 'SHARES_THEME'").select("src", "dst").distinct()
    return pairs.select(*Y.associate("src", "dst", "RELATES_TO"))


@query("b22_delete_edges", "SELECT DISTINCT id FROM edg AS e WHERE NOT EXISTS (SELECT 1 FROM edg AS x WHERE x.relationship = 'CALLS' AND x.src = e.src AND x.dst = e.dst)")
def _(s: Store) -> DataFrame:
    e = s.edges("src", "dst", "relationship")
    return Y.delete_edges(e, e.where("relationship = 'CALLS'").select("src", "dst")).select("id")


@query(
    "b23_cleanup_files",
    "WITH f AS (SELECT DISTINCT file_path FROM act WHERE tool_name = 'Write'), g AS (SELECT id FROM nod WHERE coalesce(json_extract_string(payload, '$.file_path'), CASE WHEN kind = 'file' THEN substr(id, 6) END, CASE WHEN kind = 'chunk' THEN regexp_replace(substr(id, 7), ':\\d+$', '') END) IN (SELECT file_path FROM f)) SELECT id, 'node' AS what FROM nod WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT id, 'edge' FROM edg WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)",
)
def _(s: Store) -> DataFrame:
    gone = s.activity("file_path", "tool_name").where("tool_name = 'Write'").select("file_path")
    left = Y.cleanup_file(s.nodes(), s.edges(), gone)
    return left["graph_nodes"].select("id", F.lit("node").alias("what")).union(left["graph_edges"].select("id", F.lit("edge")))


@query("c12_existence", "SELECT DISTINCT memory_id AS id, memory_id IN (SELECT id FROM mem ) AS found FROM emb WHERE memory_id IS NOT NULL")
def _(s: Store) -> DataFrame:
    return Y.exists(s.embeddings().where("memory_id IS NOT NULL").select(F.col("memory_id").alias("id")), s.memories("created_at"))


@query(
    "d09_hunks_to_symbols",
    "WITH r AS (SELECT 'sym:' || parent_symbol AS symbol, file_path, min(line_start) AS a, max(line_end) AS b FROM chk WHERE parent_symbol IS NOT NULL GROUP BY 1, 2) SELECT DISTINCT c.id, r.symbol FROM chk AS c JOIN r ON r.file_path = c.file_path AND c.line_start <= r.b AND r.a <= c.line_end",
)
def _(s: Store) -> DataFrame:
    c = s.chunks("file_path", "line_start", "line_end", "parent_symbol")
    return V.overlapping(c.select("id", "file_path", "line_start", "line_end"), V.symbol_ranges(c))


@query(
    "d13_link_packages",
    """WITH y AS (SELECT DISTINCT namespace, parent_symbol AS symbol FROM chk WHERE parent_symbol IS NOT NULL AND namespace IS NOT NULL), r AS (SELECT DISTINCT id AS ref_id, namespace AS own, regexp_extract(parent_symbol, '[^:]*$') AS name FROM chk WHERE parent_symbol IS NOT NULL AND namespace IS NOT NULL)
SELECT ref_id, y.namespace, y.symbol, CAST(CASE WHEN y.symbol = r.name THEN 1.0 ELSE 0.7 END AS DOUBLE) AS confidence FROM r JOIN y ON y.symbol = r.name OR ends_with(y.symbol, '::' || r.name) WHERE own <> y.namespace QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY (y.symbol = r.name) DESC, length(y.symbol), y.symbol, y.namespace) = 1""",
)
def _(s: Store) -> DataFrame:
    """All namespaces offer one package, and every symbol is asked for by its last name."""
    c = s.chunks("parent_symbol", "namespace").where("parent_symbol IS NOT NULL AND namespace IS NOT NULL")
    package = F.lit("all")
    pending = c.select(F.col("id").alias("ref_id"), "namespace", package.alias("package"), F.element_at(F.split("parent_symbol", "::"), -1).alias("name")).distinct()
    symbols = c.select("namespace", F.col("parent_symbol").alias("symbol"), F.lit("private").alias("visibility")).distinct()
    return L.link_packages(pending, c.select(package.alias("package"), "namespace").distinct(), symbols)


@query("e09_directory_reads", "SELECT session_id, directory, count(*) AS n FROM act WHERE tool_name = 'Read' AND session_id IS NOT NULL AND directory IS NOT NULL GROUP BY 1, 2")
def _(s: Store) -> DataFrame:
    return Y.directory_reads(s.activity())


@query("e09_pattern_searches", "SELECT session_id, pattern, count(*) AS n FROM act WHERE tool_name IN ('Grep', 'Glob') AND session_id IS NOT NULL AND pattern IS NOT NULL GROUP BY 1, 2")
def _(s: Store) -> DataFrame:
    return Y.pattern_searches(s.activity())


@query("e19_cycle_status", "WITH l AS (SELECT CASE hour(started_at) % 4 WHEN 0 THEN 'decay' WHEN 1 THEN 'creative' WHEN 2 THEN 'cluster' ELSE 'forget' END AS cycle_type, started_at, CAST(coalesce(memory_count, 0) AS BIGINT) AS c FROM ses ), m AS (SELECT cycle_type, max(started_at) AS run_at FROM l GROUP BY 1) SELECT v.cycle_type, m.run_at, coalesce((SELECT max(c) FROM l WHERE l.cycle_type = m.cycle_type AND l.started_at = m.run_at), 0) AS affected_count FROM (VALUES ('decay'), ('creative'), ('cluster'), ('forget'), ('summarize')) AS v(cycle_type) LEFT JOIN m USING (cycle_type)")
def _(s: Store) -> DataFrame:
    """Sessions stand for the log of the cycles; one cycle never ran."""
    turn = F.hour("started_at") % 4
    kind = F.when(turn == 0, "decay").when(turn == 1, "creative").when(turn == 2, "cluster").otherwise("forget")
    log = s.sessions("started_at", "memory_count").select(kind.alias("cycle_type"), F.col("started_at").alias("run_at"), F.coalesce("memory_count", F.lit(0)).cast("long").alias("affected_count"))
    return A.cycle_status(log)


@query("f08_newest_documents", "SELECT id FROM mem ORDER BY created_at DESC, id LIMIT 500")
def _(s: Store) -> DataFrame:
    return X.newest_documents(s.memories("created_at"), 500, "created_at", "id").select("id")


@query("g03_stale_symbols", "WITH o AS (SELECT DISTINCT id, json_extract_string(payload, '$.file_path') AS file_path FROM nod WHERE kind = 'method') SELECT id, file_path FROM o WHERE id NOT IN (SELECT dst FROM edg WHERE relationship = 'CALLS' AND dst IS NOT NULL)")
def _(s: Store) -> DataFrame:
    """Methods that nothing calls stand for those that a new version of the code no longer has."""
    old = s.nodes("kind", "payload").where("kind = 'method'").select("id", S.json_text("payload", "$.file_path").alias("file_path"))
    e = s.edges("src", "dst", "relationship")
    new = e.where("relationship = 'CALLS'").select(F.col("dst").alias("id"))
    return L.stale_symbols(old, new, e, s.memories("created_at"))[0]


@query("q13_redirected_edges", "WITH o AS (SELECT DISTINCT id, json_extract_string(payload, '$.file_path') AS f FROM nod WHERE kind = 'method'), g AS (SELECT * FROM o WHERE id NOT IN (SELECT dst FROM edg WHERE relationship = 'CALLS' AND dst IS NOT NULL)), e AS (SELECT DISTINCT id, src, dst, relationship FROM edg ), j AS (SELECT e.*, a.f AS fs, b.f AS fd, src IN (SELECT id FROM mem ) AS ms, dst IN (SELECT id FROM mem ) AS md FROM e LEFT JOIN g AS a ON a.id = src LEFT JOIN g AS b ON b.id = dst) SELECT id, coalesce('file:' || fs, src) AS src, coalesce('file:' || fd, dst) AS dst, relationship FROM j WHERE (fs IS NULL OR md) AND (fd IS NULL OR ms)")
def _(s: Store) -> DataFrame:
    old = s.nodes("kind", "payload").where("kind = 'method'").select("id", S.json_text("payload", "$.file_path").alias("file_path"))
    e = s.edges("src", "dst", "relationship")
    return L.stale_symbols(old, e.where("relationship = 'CALLS'").select(F.col("dst").alias("id")), e, s.memories("created_at"))[1]


@query("g06_patterns_elsewhere", f"WITH c AS (SELECT session_id, pattern, count(*) AS n FROM act WHERE tool_name IN ('Grep', 'Glob') AND session_id IS NOT NULL AND pattern IS NOT NULL GROUP BY 1, 2), r AS (SELECT * FROM {_RUNAWAY}) SELECT pattern FROM c WHERE session_id NOT IN (SELECT session_id FROM r) AND pattern NOT IN (SELECT pattern FROM c WHERE session_id IN (SELECT session_id FROM r)) GROUP BY 1 HAVING sum(n) >= 2")
def _(s: Store) -> DataFrame:
    return Y.patterns_elsewhere(s.activity(), _runaway(s))


@query(
    "i06_score_texts",
    f"""WITH t AS (SELECT id, {TOKENS.format("content")} AS w FROM mem WHERE content IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t), df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(w) AS term FROM t) GROUP BY 1),
c AS (SELECT DISTINCT id, {TOKENS.format("text")} AS w, text FROM chk WHERE text IS NOT NULL), p AS (SELECT id, len(w) AS dl, term, count(*) AS tf FROM (SELECT id, w, text, unnest(w) AS term FROM c) GROUP BY 1, 2, 3), q AS (SELECT 'q1' AS query_id, unnest(['buffer', 'parser', 'retry', 'zzz']) AS term),
w AS (SELECT query_id, term, avgdl, ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1) AS idf FROM q LEFT JOIN df USING (term), st), mx AS (SELECT query_id, sum(idf * 10 * 2.2 / (10 + 1.2)) AS most FROM w GROUP BY 1)
SELECT query_id, id, round(least(1.0, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) / any_value(most)), 9) AS score FROM p JOIN w USING (term) JOIN mx USING (query_id) GROUP BY 1, 2""",
)
def _(s: Store) -> DataFrame:
    """Chunks of code scored by the frequencies of the memories."""
    asked = s.spark.createDataFrame([("q1", "buffer parser retry zzz")], "query_id string, query string")
    texts = s.chunks("text").withColumnRenamed("text", "content")
    return Y.score_texts(texts, asked, s.memories("content"), "id", "content").select("query_id", "id", F.round("score", 9).alias("score"))


@query("i11_path_tags", "SELECT DISTINCT file_path, 'ext:' || regexp_extract(file_path, '\\.([^.]+)$', 1) || ',dir:' || regexp_extract(file_path, '([^/]+)/[^/]*$', 1) || ',file:' || regexp_extract(file_path, '[^/]*$') AS tags FROM act WHERE file_path LIKE '%/%.%'")
def _(s: Store) -> DataFrame:
    own = s.activity("file_path").where("file_path LIKE '%/%.%'").select("file_path").distinct()
    return own.select("file_path", F.array_join(S.path_tags(F.col("file_path")), ",").alias("tags"))


@query("i12_relative_paths", "SELECT DISTINCT file_path, CASE WHEN starts_with(file_path, 'src/') THEN substr(file_path, 5) ELSE file_path END AS path FROM act WHERE file_path IS NOT NULL")
def _(s: Store) -> DataFrame:
    own = s.activity("file_path").where("file_path IS NOT NULL").select("file_path").distinct()
    return own.select("file_path", S.relative_path(F.col("file_path"), F.lit("src/")).alias("path"))


@query("l05_expire_deleted", f"WITH {COMMITS}, d AS (SELECT file, max(w) AS d FROM c WHERE author < '40' GROUP BY 1) SELECT n.id, coalesce(d, valid_to) AS valid_to FROM (SELECT DISTINCT id, valid_to, coalesce(json_extract_string(payload, '$.file_path'), CASE WHEN starts_with(id, 'file:') THEN substr(id, 6) END) AS p FROM nod ) AS n LEFT JOIN d ON d.file = n.p")
def _(s: Store) -> DataFrame:
    a = s.activity("session_id", "tool_name", "file_path", "created_at").where("tool_name IN ('Edit', 'Write') AND file_path IS NOT NULL AND left(session_id, 2) < '40'")
    return T.expire_deleted(s.nodes("valid_to", "payload"), a.select("file_path", F.col("created_at").alias("date"))).select("id", "valid_to").distinct()


@query("l06_commits_between", f"WITH {COMMITS}, k AS (SELECT 'commit:' || c.hash AS id, max(date) AS at_time, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM c JOIN cc USING (hash, author) GROUP BY 1) SELECT id, at_time AS \"at\", files FROM k WHERE at_time BETWEEN TIMESTAMP '{BEFORE}' AND TIMESTAMP '{NOW}'")
def _(s: Store) -> DataFrame:
    n, e = T.ingest_commits(_commits(s))
    return T.commits_between(n, e, BEFORE, NOW).select("id", "at", F.array_join("files", ",").alias("files"))


@query(
    "m01_diff_to_symbols",
    "WITH r AS (SELECT 'sym:' || parent_symbol AS symbol, file_path, min(line_start) AS a, max(line_end) AS b FROM chk WHERE parent_symbol IS NOT NULL GROUP BY 1, 2), l AS (SELECT DISTINCT file_path, line_start AS line FROM chk WHERE file_path LIKE 'src/a%'), h AS (SELECT DISTINCT symbol AS id FROM l JOIN r ON r.file_path = l.file_path AND line BETWEEN a AND b), e AS (SELECT src, regexp_replace(dst, '#\\d+$', '') AS dst FROM edg WHERE relationship = 'CONTAINS') SELECT id, 'changed' AS how FROM h UNION ALL SELECT DISTINCT src, 'containing' FROM e WHERE dst IN (SELECT id FROM h) AND src NOT IN (SELECT id FROM h)",
)
def _(s: Store) -> DataFrame:
    c = s.chunks("file_path", "line_start", "line_end", "parent_symbol")
    e = s.edges("src", "dst", "relationship").withColumn("dst", F.regexp_replace("dst", r"#\d+$", ""))
    return V.changed_symbols(_lines(s), V.symbol_ranges(c), e)


@query("n13_run_enrichments", "WITH d AS (" + SQL["n02_security_names"].replace("WITH ", "WITH ", 1) + "), x AS (SELECT id FROM (SELECT src AS id FROM edg UNION ALL SELECT dst FROM edg ) GROUP BY 1 HAVING count(*) > 15) SELECT 'security' AS analysis, count(*) AS n FROM d UNION ALL SELECT 'coupling', count(*) FROM x UNION ALL SELECT 'architecture', count(*) FROM (" + SQL["n07_architecture"] + ")")
def _(s: Store) -> DataFrame:
    tables = {"nodes": s.nodes("kind", "label"), "edges": s.edges("src", "dst", "relationship")}
    analyses = {"security": lambda t: N.security_names(t["nodes"]), "coupling": lambda t: N.coupling(t["edges"]), "architecture": lambda t: N.architecture(t["edges"]), "other": lambda t: t["nodes"]}
    return Y.run_enrichments(tables, analyses, ("security", "coupling", "architecture"))


@query("n15_pattern_memories", f"WITH p AS ({SQL['p_patterns']}), k AS (SELECT kind || ' ' || subject || ' (' || n || ' times)' AS content, confidence FROM p) SELECT left(sha256(content), 32) AS id, content, CAST(0.5 AS DOUBLE) AS importance, round(confidence, 9) AS confidence FROM k")
def _(s: Store) -> DataFrame:
    found = Y.pattern_memories(A.patterns(s.activity()), "orbit-core", NOW)
    return found.select("id", "content", "importance", F.round("confidence", 9).alias("confidence"))


@query("n17_security_insights", "SELECT count(DISTINCT id) FILTER (kind = 'file') AS sensitive, count(DISTINCT id) FILTER (kind = 'method') AS endpoints, count(DISTINCT id) FILTER (kind = 'function') AS functions FROM nod ")
def _(s: Store) -> DataFrame:
    """The test data have no flags: every kind gets one of its own."""
    flag = F.when(F.col("kind") == "file", "auth_related").when(F.col("kind") == "method", "exposed_endpoint").when(F.col("kind") == "function", "security_function")
    n = s.nodes("kind").withColumn("payload", F.when(flag.isNotNull(), F.concat(F.lit('{"security_flags":["'), flag, F.lit('","other"]}'))).otherwise("{}"))
    return Y.security_insights(n)


@query(
    "n18_performance_insights",
    f"WITH RECURSIVE {ranks('SELECT DISTINCT id, %s AS g FROM nod ' % (chr(39) * 2), 'SELECT src, dst FROM (SELECT DISTINCT id, src, dst FROM edg )', 100)}, "
    + SQL["k08_topological_layers"].removeprefix("WITH RECURSIVE ").rsplit(" SELECT id, max(layer)", 1)[0]
    + ", cp AS (SELECT 'coupling' AS what, id, CAST(count(*) AS DOUBLE) AS n FROM (SELECT src AS id FROM edg UNION ALL SELECT dst FROM edg ) GROUP BY 2 HAVING count(*) > 15 ORDER BY n DESC, id LIMIT 10), fr AS (SELECT 'rank' AS what, id, rank FROM rk WHERE id IN (SELECT id FROM nod WHERE kind = 'file') ORDER BY round(rank, 9) DESC, id LIMIT 10) SELECT what, id, round(n, 5) AS n FROM (SELECT * FROM cp UNION ALL SELECT 'layers', '', (SELECT max(layer) + 1 FROM ly) UNION ALL SELECT * FROM fr)",
)
def _(s: Store) -> DataFrame:
    e = s.edges("src", "dst")
    ranked = G.pagerank(s.nodes(), e).withColumn("rank", F.round("rank", 9))
    return Y.performance_insights(e, G.topological_layers(*_calls(s)), ranked, s.nodes("kind")).withColumn("n", F.round("n", 5))


@query(
    "p_checkpoint",
    f"WITH r AS (SELECT * FROM {_RUNAWAY}), a AS (SELECT * FROM act WHERE session_id IN (SELECT session_id FROM r)), s AS (SELECT count(DISTINCT CASE WHEN tool_name = 'Read' THEN file_path END) AS files_read, count(DISTINCT CASE WHEN tool_name IN ('Edit', 'Write') THEN file_path END) AS files_edited, count(*) FILTER (tool_name IN ('Grep', 'Glob')) AS searches, count(*) AS actions FROM a), d AS (SELECT directory, count(*) AS n FROM a WHERE directory IS NOT NULL GROUP BY 1 ORDER BY n DESC, directory LIMIT 5) SELECT 'summary' AS what, subject, n FROM (UNPIVOT s ON files_read, files_edited, searches, actions INTO NAME subject VALUE n) UNION ALL SELECT 'directory', * FROM d UNION ALL SELECT 'search', pattern, count(*) FROM a WHERE tool_name IN ('Grep', 'Glob') AND pattern IS NOT NULL GROUP BY 2 HAVING count(*) >= 2 UNION ALL SELECT 'hotspot', file_path, count(*) FROM a WHERE tool_name IN ('Read', 'Edit', 'Write') AND file_path IS NOT NULL GROUP BY 2 HAVING count(*) >= 3 UNION ALL SELECT 'insight', id, 1 FROM mem WHERE session_id IN (SELECT session_id FROM r) AND lower(trim(memory_type)) = 'insight'",
)
def _(s: Store) -> DataFrame:
    return Y.session_checkpoint(s.memories("session_id", "memory_type"), s.activity(), _runaway(s))


@query("p_stop_summary", "WITH r AS (SELECT session_id FROM mem WHERE session_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, session_id LIMIT 1) SELECT session_id, 'Session ' || session_id || ': 0 files read, 0 edited, 0 searches, ' || count(*) FILTER (lower(trim(memory_type)) = 'decision') || ' decisions' AS content FROM mem WHERE session_id IN (SELECT session_id FROM r) GROUP BY 1")
def _(s: Store) -> DataFrame:
    """The session with most memories."""
    m = s.memories("session_id", "metadata", "memory_type")
    row = m.where("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "session_id").first()
    return J.stop_summary(m, row["session_id"] if row else "").select("session_id", "content")


@query("q08_fan_out", "WITH e AS (SELECT DISTINCT id, dst AS symbol, src AS file_path FROM edg WHERE relationship = 'CALLS') SELECT id FROM e WHERE (symbol, file_path) IN (SELECT (symbol, file_path) FROM e GROUP BY symbol, file_path HAVING count(*) <= 1)")
def _(s: Store) -> DataFrame:
    e = s.edges("src", "dst", "relationship").where("relationship = 'CALLS'").select("id", F.col("dst").alias("symbol"), F.col("src").alias("file_path"))
    return L.fan_out_limited(e, 1).select("id")


@query("q08_roles", "SELECT DISTINCT id, CASE WHEN kind = 'file' THEN 'IMPORTS' WHEN coalesce(centrality, 0) > 0.5 THEN 'WRITES' WHEN kind = 'chunk' THEN 'READS' WHEN kind = 'memory' THEN 'TYPE_DEFINITION' ELSE 'CALLS' END AS role FROM nod ")
def _(s: Store) -> DataFrame:
    n = s.nodes("kind", "centrality").select("id", (F.col("kind") == "file").alias("is_import"), (F.coalesce("centrality", F.lit(0.0)) > 0.5).alias("is_write"), (F.col("kind") == "chunk").alias("is_read"), F.when(F.col("kind") == "memory", "struct").otherwise("fn").alias("kind"))
    return n.select("id", L.role_relationship().alias("role")).distinct()


@query("q22_without_blocked", "SELECT DISTINCT id, lang, regexp_extract(parent_symbol, '[^:]*$') AS name FROM chk WHERE parent_symbol IS NOT NULL AND lang IS NOT NULL AND (lang, regexp_extract(parent_symbol, '[^:]*$')) NOT IN (SELECT (lang, n) FROM (SELECT lang, regexp_extract(parent_symbol, '[^:]*$') AS n FROM (SELECT DISTINCT id, lang, parent_symbol FROM chk WHERE parent_symbol IS NOT NULL AND lang IS NOT NULL) GROUP BY ALL HAVING count(*) > 1))")
def _(s: Store) -> DataFrame:
    """Names that stand more than once in a language are the block list."""
    refs = s.chunks("lang", "parent_symbol").where("parent_symbol IS NOT NULL AND lang IS NOT NULL").select("id", "lang", F.element_at(F.split("parent_symbol", "::"), -1).alias("name"))
    blocked = refs.groupBy("lang", "name").agg(F.count("*").alias("c")).where("c > 1")
    return L.without_blocked(refs, blocked).select("id", "lang", "name")


@query("q23_packages", "SELECT c.package, coalesce(l.version, '0') AS version FROM (SELECT DISTINCT split_part(parent_symbol, '::', 1) AS package FROM chk WHERE parent_symbol IS NOT NULL) AS c LEFT JOIN (SELECT split_part(parent_symbol, '::', 1) AS package, max(CAST(chunk_index AS VARCHAR)) AS version FROM chk WHERE lang = 'rust' AND parent_symbol IS NOT NULL GROUP BY 1) AS l USING (package)")
def _(s: Store) -> DataFrame:
    c = s.chunks("parent_symbol", "lang", "chunk_index").where("parent_symbol IS NOT NULL").withColumn("package", F.split_part("parent_symbol", F.lit("::"), F.lit(1)))
    locks = c.where("lang = 'rust'").select("package", F.col("chunk_index").cast("string").alias("version"))
    return L.extract_packages(c.select("package", F.lit("0").alias("version")).distinct(), locks)


@query("b25_newest_rows", "SELECT namespace, id, ended_at FROM ses WHERE ended_at IS NOT NULL AND namespace IS NOT NULL QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY ended_at DESC, id DESC) = 1")
def _(s: Store) -> DataFrame:
    return L.newest_rows(s.sessions("namespace", "ended_at").where("ended_at IS NOT NULL AND namespace IS NOT NULL").select("namespace", "ended_at", "id"), ["namespace"], "ended_at").select("namespace", "id", "ended_at")


@query(
    "f03_compacted_chunks",
    r"""WITH c AS (SELECT id, min(file_path) AS file_path, min(parent_symbol) AS parent_symbol, min(length(regexp_replace(text, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+', '', 'g'))) AS size FROM chk WHERE text IS NOT NULL AND file_path IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT id, src, dst FROM edg ), x AS (SELECT src AS id, dst AS o FROM e UNION ALL SELECT dst, src FROM e WHERE src <> dst),
d AS (SELECT id, count(*) AS degree, max(CASE WHEN regexp_matches(o, '^(sym|file|chunk|pkg|contains|ref):') THEN 0 ELSE 1 END) AS linked FROM x WHERE id IN (SELECT id FROM c) GROUP BY 1), j AS (SELECT c.*, coalesce(degree, 0) AS degree, coalesce(linked, 0) AS linked FROM c LEFT JOIN d USING (id)),
s AS (SELECT id, file_path, round(0.3 * degree / greatest(1, max(degree) OVER ()) + 0.2 * (parent_symbol IS NOT NULL)::INT + 0.3 * linked + 0.2 * size / greatest(1, max(size) OVER ()), 9) AS score FROM j),
y AS (SELECT json_extract_string(payload, '$.file_path') AS file_path, count(DISTINCT id) AS y FROM nod WHERE kind IN ('function', 'method') GROUP BY 1), k AS (SELECT file_path, greatest(least(10, count(*)), 3, coalesce(any_value(y), 0)) AS k FROM s LEFT JOIN y USING (file_path) GROUP BY 1)
SELECT id, file_path, score FROM s JOIN k USING (file_path) WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) <= any_value(k) OVER (PARTITION BY file_path)""",
)
def _(s: Store) -> DataFrame:
    c = s.chunks("file_path", "parent_symbol", "text").where("text IS NOT NULL").withColumn("size", S.non_whitespace("text"))
    symbols = s.nodes("kind", "payload").where("kind IN ('function', 'method')").select("id", S.json_text("payload", "$.file_path").alias("file_path"))
    return N.compacted_chunks(c, s.edges("src", "dst"), symbols)
