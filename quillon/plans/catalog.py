"""All queries of the engine over the store's tables, and the SQL for DuckDB that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedding as E
from ..functions import scalars as S
from ..functions.lineage import durable
from ..operators import analytics as A
from ..operators import consolidate as C
from ..operators import enrich as N
from ..operators import graph as G
from ..operators import jobs as J
from ..operators import linking as L
from ..operators import records as R
from ..operators import review as V
from ..operators import temporal as T
from ..operators import text as X
from ..operators import vectors as H
from ..operators.recall import recall, recall_expanded, with_impact
from ..sources.tables import Store
from .sql import SQL, TOKENS

#: The moment at which the queries look: after all but the last rows.
NOW = "2025-12-01 00:00:00"
BEFORE = "2025-06-01 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_CTES = {
    "mem": "mem AS (SELECT * FROM memories WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)",
    "nod": "nod AS (SELECT DISTINCT * FROM graph_nodes)",
    "edg": "edg AS (SELECT DISTINCT * FROM graph_edges)",
    "act": "act AS (SELECT DISTINCT * FROM session_activity)",
    "ses": "ses AS (SELECT DISTINCT * FROM sessions)",
    "chk": "chk AS (SELECT DISTINCT * FROM code_chunks)",
    "emb": "emb AS (SELECT DISTINCT * FROM memory_embeddings)",
}


def _with_tables(sql: str) -> str:
    """The SQL with the cleaned tables that it uses ({mem}, {nod}, ...) in front."""
    used = [c for c in _CTES if f" {c} " in sql.replace("\n", " ").replace(")", " ) ").replace(",", " , ") + " "]
    own = sql.strip()
    recursive = "RECURSIVE " if own.upper().startswith("WITH RECURSIVE") else ""
    body = own[len("WITH RECURSIVE") if recursive else 4 :] if own.upper().startswith("WITH") else None
    ctes = ", ".join(_CTES[c] for c in used)
    return own if not used else f"WITH {recursive}{ctes}, {body}" if body is not None else f"WITH {ctes} {own}"


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Store], DataFrame]], Callable[[Store], DataFrame]]:
    """Register a query over a Store, and its SQL: mem, nod, ... in it stand for the cleaned tables. Longer SQL stands in sql.py."""

    def put(f: Callable[[Store], DataFrame]) -> Callable[[Store], DataFrame]:
        _QUERIES[name] = lambda spark, d: f(Store(spark, d))
        text = sql if sql is not None else SQL.get(name)
        if text is not None:
            _SQL[name] = _with_tables(text)
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- A, C: reading and filtering --------------------------------------------


@query("a04_newest_ids", "SELECT id, created_at FROM mem ORDER BY created_at DESC, id LIMIT 100")
def _(s: Store) -> DataFrame:
    return R.newest(s.memories("created_at"), 100).select("id", "created_at")


@query("a05_namespace_ids", "SELECT id FROM mem WHERE namespace = 'orbit-core'")
def _(s: Store) -> DataFrame:
    return s.memories("namespace").where("namespace = 'orbit-core'").select("id")


@query("a06_listing", f"SELECT id, lower(trim(memory_type)) AS kind FROM mem WHERE (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') AND lower(trim(memory_type)) = 'decision'")
def _(s: Store) -> DataFrame:
    return R.listing(s.memories("memory_type", "expires_at"), NOW, memory_type="Decision").select("id", S.memory_type().alias("kind"))


@query("a03_batch_by_keys", "SELECT id, content FROM mem WHERE id IN (SELECT memory_id FROM nod WHERE centrality > 0.005)")
def _(s: Store) -> DataFrame:
    keys = s.nodes("memory_id", "centrality").where("centrality > 0.005").select(F.col("memory_id").alias("id"))
    return R.by_keys(s.memories("content"), keys).select("id", "content")


@query("a07_embeddings", "SELECT memory_id, len(embedding) AS dims, model FROM emb WHERE embedding IS NOT NULL")
def _(s: Store) -> DataFrame:
    return s.embeddings().where("embedding IS NOT NULL").select("memory_id", F.size("embedding").cast("long").alias("dims"), "model")


@query("a10_node_edges", "WITH hub AS (SELECT src FROM edg GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1) SELECT e.id, e.src, e.dst FROM edg AS e, hub WHERE e.src = hub.src OR e.dst = hub.src")
def _(s: Store) -> DataFrame:
    e = s.edges("src", "dst")
    hub = e.groupBy("src").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "src").limit(1).select(F.col("src").alias("hub"))
    one = e.join(F.broadcast(hub), F.col("src") == F.col("hub"))
    return one.union(e.join(F.broadcast(hub), F.col("dst") == F.col("hub"))).select("id", "src", "dst").distinct()


@query("c01_quality", f"SELECT id FROM mem WHERE (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') AND importance >= 0.5 AND confidence >= 0.5 AND NOT coalesce(list_has_any(tags, ['static-analysis', 'bug']), false)")
def _(s: Store) -> DataFrame:
    return R.quality(s.memories("importance", "confidence", "tags", "expires_at"), NOW, ("static-analysis", "bug"), 0.5, 0.5).select("id")


@query("c04_with_tag", f"SELECT id, created_at FROM mem WHERE list_contains(tags, 'rust') AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')")
def _(s: Store) -> DataFrame:
    return R.with_tag(s.memories("tags", "expires_at", "created_at"), "rust", NOW).select("id", "created_at")


@query(
    "c05_tag_siblings",
    """WITH x AS (SELECT DISTINCT id, created_at, coalesce(namespace, '') AS ns, tag FROM (SELECT id, created_at, namespace, unnest(tags) AS tag FROM mem )),
r AS (SELECT *, row_number() OVER (PARTITION BY ns, tag ORDER BY created_at DESC, id) AS r FROM x)
SELECT a.id, a.tag, b.id AS sibling FROM r AS a JOIN r AS b USING (ns, tag) WHERE a.id <> b.id AND (b.r <= 50 OR (b.r = 51 AND a.r <= 50))""",
)
def _(s: Store) -> DataFrame:
    return R.tag_siblings(s.memories("created_at", "namespace", "tags"), 50)


@query("c06_label_search", "SELECT DISTINCT id, label FROM nod WHERE contains(lower(label), 'shard_')")
def _(s: Store) -> DataFrame:
    return R.label_search(s.nodes("label", "namespace", "centrality"), "shard_").select("id", "label").distinct()


@query("c07_symbol_search")
def _(s: Store) -> DataFrame:
    return R.symbol_search(s.nodes("kind", "label"), "shard")


@query(
    "c08_browse",
    """WITH d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edg UNION ALL SELECT dst FROM edg ) GROUP BY 1),
p AS (SELECT * FROM nod WHERE kind = 'function' ORDER BY centrality DESC NULLS LAST, id LIMIT 50 OFFSET 10)
SELECT p.id, kind, label, centrality, coalesce(degree, 0) AS degree FROM p LEFT JOIN d USING (id)""",
)
def _(s: Store) -> DataFrame:
    return R.browse(s.nodes("kind", "label", "centrality", "namespace"), s.edges("src", "dst"), kind="function", offset=10, limit=50)


@query("c09_forgettable", "SELECT id FROM mem WHERE importance < 0.1 AND coalesce(access_count, 0) <= 0")
def _(s: Store) -> DataFrame:
    return R.forgettable(s.memories("importance", "access_count")).select("id")


@query("c10_forgettable_by_tags", "SELECT id FROM mem WHERE importance < 0.3 AND coalesce(access_count, 0) <= 5 AND list_has_any(tags, ['todo', 'auto'])")
def _(s: Store) -> DataFrame:
    return R.forgettable(s.memories("importance", "access_count", "tags"), 0.3, 5, ("todo", "auto")).select("id")


@query("c11_stale", f"SELECT id FROM mem WHERE last_accessed_at < TIMESTAMP '{BEFORE}'")
def _(s: Store) -> DataFrame:
    return R.stale(s.memories("last_accessed_at"), BEFORE).select("id")


@query("c13_valid_nodes", f"SELECT id, kind FROM nod WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{BEFORE}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{BEFORE}')")
def _(s: Store) -> DataFrame:
    return s.nodes().where(S.valid_at(S.ts(BEFORE))).select("id", "kind")


# ---- B: changes as table to table -------------------------------------------


@query(
    "b01_insert_new",
    f"""WITH old AS (SELECT * FROM mem WHERE created_at < TIMESTAMP '{BEFORE}'), new AS (SELECT * FROM mem WHERE created_at >= TIMESTAMP '{BEFORE}')
SELECT id, sha256(content) AS content_hash FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.content = new.content AND coalesce(old.namespace, '') = coalesce(new.namespace, ''))
QUALIFY row_number() OVER (PARTITION BY content, coalesce(namespace, '') ORDER BY created_at, id) = 1""",
)
def _(s: Store) -> DataFrame:
    m = s.memories("content", "namespace", "created_at")
    return R.insert_new(m.where(F.col("created_at") < S.ts(BEFORE)), m.where(F.col("created_at") >= S.ts(BEFORE)).select("id", "content", "namespace", "created_at")).select("id", "content_hash")


@query("b03_update_memories", "SELECT id, CASE WHEN namespace = 'orbit-core' THEN upper(content) ELSE content END AS content FROM mem ")
def _(s: Store) -> DataFrame:
    m = s.memories("content", "content_hash", "importance", "namespace")
    changes = m.where("namespace = 'orbit-core'").select("id", F.upper("content").alias("content"), F.to_timestamp_ntz(F.lit(NOW)).alias("updated_at"))
    return R.update_memories(m, changes).select("id", "content")


@query(
    "b04_delete_cascade",
    """WITH gone AS (SELECT id FROM mem WHERE importance < 0.2), dead AS (SELECT n.id FROM nod AS n JOIN gone ON n.memory_id = gone.id UNION SELECT id FROM gone)
SELECT 'memories' AS what, count(*) AS n FROM mem WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'memory_embeddings', count(*) FROM emb WHERE memory_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'graph_nodes', count(*) FROM nod WHERE id NOT IN (SELECT id FROM dead)
UNION ALL SELECT 'graph_edges', count(*) FROM edg WHERE src NOT IN (SELECT id FROM dead) AND dst NOT IN (SELECT id FROM dead)""",
)
def _(s: Store) -> DataFrame:
    m = s.memories("importance")
    left = R.delete_cascade(m.where("importance < 0.2"), m, s.embeddings(), s.nodes(), s.edges())
    out = None
    for what, df in left.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.union(one)
    return out


@query("b06_expire_for_file")
def _(s: Store) -> DataFrame:
    """The memories that relate to a symbol relate to its file: the edges of the test data lead to symbols only."""
    m, n = s.memories("tags", "expires_at"), s.nodes("payload", "memory_id", "kind")
    file = n.where("kind IN ('function', 'method')").groupBy(F.col("id").alias("dst")).agg(F.min(S.json_text("payload", "$.file_path")).alias("f")).where("f IS NOT NULL")
    e = s.edges("src", "dst", "relationship").where("relationship = 'RELATES_TO'").join(file, "dst").select("src", F.concat(F.lit("file:"), "f").alias("dst"), "relationship")
    marked = m.where(F.array_contains("tags", "static-analysis")).select(F.col("id").alias("m"))
    most = e.distinct().join(marked, F.col("src") == F.col("m")).groupBy("dst").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "dst").first()
    return R.expire_for_file(m, n, e, most["dst"][5:] if most else "", NOW).where(F.col("expires_at") == S.ts(NOW)).select("id")


@query("b07_delete_prefix", "SELECT kind, count(*) AS n FROM nod WHERE NOT starts_with(id, 'chunk:') GROUP BY 1")
def _(s: Store) -> DataFrame:
    return R.delete_prefix(s.nodes(), "chunk:").groupBy("kind").agg(F.count("*").alias("n"))


@query("b08_upsert", "SELECT id, CASE WHEN kind = 'file' THEN 'path' ELSE kind END AS kind FROM (SELECT DISTINCT id, kind FROM nod )")
def _(s: Store) -> DataFrame:
    n = s.nodes("kind")
    return R.upsert(n, n.where("kind = 'file'").withColumn("kind", F.lit("path")))


@query("b10_update_importance", "SELECT id, CASE WHEN list_contains(tags, 'rust') THEN 0.9 ELSE importance END AS importance FROM mem ")
def _(s: Store) -> DataFrame:
    m = s.memories("importance", "tags")
    return R.update_importance(m, m.where(F.array_contains("tags", "rust")).select("id", F.lit(0.9).alias("importance"))).select("id", "importance")


@query("a01_touched", "WITH log AS (SELECT id, access_count FROM mem WHERE namespace = 'orbit-core') SELECT m.id, coalesce(m.access_count, 0) + CASE WHEN log.id IS NULL THEN 0 ELSE 2 END AS access_count FROM mem AS m LEFT JOIN log ON log.id = m.id")
def _(s: Store) -> DataFrame:
    m = s.memories("access_count", "last_accessed_at", "namespace")
    log = m.where("namespace = 'orbit-core'").select("id", F.to_timestamp_ntz(F.lit(NOW)).alias("accessed_at"))
    return R.touched(m, log.union(log)).select("id", "access_count")


@query("b15_export", "SELECT m.id, count(e.id) AS edges FROM mem AS m LEFT JOIN (SELECT id, src AS a FROM edg UNION ALL SELECT id, dst FROM edg ) AS e ON e.a = m.id GROUP BY 1")
def _(s: Store) -> DataFrame:
    return R.export_rows(s.memories("content"), s.edges("src", "dst", "relationship")).select("id", F.when(F.col("edges").isNull(), 0).otherwise(F.size("edges")).cast("long").alias("edges"))


# ---- D: joins ----------------------------------------------------------------


@query("d01_namespace_edges", "WITH n AS (SELECT DISTINCT id, namespace FROM nod ) SELECT e.id, a.namespace AS src_ns, b.namespace AS dst_ns, a.namespace IS DISTINCT FROM b.namespace AS cross FROM (SELECT DISTINCT id, src, dst FROM edg ) AS e JOIN n AS a ON a.id = e.src JOIN n AS b ON b.id = e.dst".replace(" AS cross", ' AS "cross"'))
def _(s: Store) -> DataFrame:
    return R.namespace_edges(s.nodes("namespace"), s.edges("src", "dst"))


@query("d03_unembedded", "SELECT id FROM mem WHERE id NOT IN (SELECT memory_id FROM emb WHERE memory_id IS NOT NULL)")
def _(s: Store) -> DataFrame:
    return R.unembedded(s.memories("created_at"), s.embeddings()).select("id")


@query("d04_hash_duplicates", "WITH h AS (SELECT id, left(lower(content_hash), 16) AS h, coalesce(namespace, '') AS ns FROM mem WHERE content_hash IS NOT NULL) SELECT id, min(id) OVER w AS first_id, count(*) OVER w AS copies FROM h QUALIFY count(*) OVER w > 1 WINDOW w AS (PARTITION BY h, ns)".replace(" QUALIFY count(*) OVER w > 1 WINDOW w AS (PARTITION BY h, ns)", " WINDOW w AS (PARTITION BY h, ns) QUALIFY count(*) OVER w > 1"))
def _(s: Store) -> DataFrame:
    return R.hash_duplicates(s.memories("content_hash", "namespace"))


@query("d05_session_counts", "SELECT s.id, s.namespace, (SELECT count(*) FROM mem AS m WHERE m.session_id = s.id) AS counted, coalesce(s.memory_count, 0) AS stored FROM ses AS s")
def _(s: Store) -> DataFrame:
    return A.sessions_with_counts(s.sessions(), s.memories("session_id")).select("id", "namespace", "counted", "stored")


@query("d17_vectors_with_kind", "WITH n AS (SELECT id, min(label) AS label FROM nod GROUP BY 1) SELECT e.memory_id, coalesce(lower(trim(m.memory_type)), 'code') AS kind, coalesce(n.label, e.memory_id) AS label FROM (SELECT DISTINCT memory_id FROM emb ) AS e LEFT JOIN mem AS m ON m.id = e.memory_id LEFT JOIN n ON n.id = e.memory_id")
def _(s: Store) -> DataFrame:
    m = s.memories("memory_type").select(F.col("id").alias("memory_id"), S.memory_type().alias("kind"))
    n = s.nodes("label").groupBy(F.col("id").alias("memory_id")).agg(F.min("label").alias("label"))
    return s.embeddings().select("memory_id").distinct().join(m, "memory_id", "left").join(n, "memory_id", "left").select("memory_id", F.coalesce("kind", F.lit("code")).alias("kind"), F.coalesce("label", "memory_id").alias("label"))


@query(
    "d08_innermost_symbol",
    """WITH r AS (SELECT 'sym:' || parent_symbol AS symbol, file_path, min(line_start) AS a, max(line_end) AS b FROM chk WHERE parent_symbol IS NOT NULL GROUP BY 1, 2)
SELECT c.id, r.symbol FROM (SELECT DISTINCT id, file_path, line_start, line_end FROM chk ) AS c JOIN r ON r.file_path = c.file_path AND r.a <= c.line_start AND c.line_end <= r.b
QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY r.b - r.a, r.symbol) = 1""",
)
def _(s: Store) -> DataFrame:
    c = s.chunks("file_path", "line_start", "line_end", "parent_symbol")
    return V.innermost(c, V.symbol_ranges(c))


@query("d15_fuse_edges")
def _(s: Store) -> DataFrame:
    e = s.edges("src", "dst", "relationship", "weight").withColumn("confidence", F.coalesce("weight", F.lit(0.5)))
    return L.fuse_edges(e.where("relationship = 'CALLS'"), e.where("weight > 0.5"))


@query("d16_hot_complex")
def _(s: Store) -> DataFrame:
    return N.hot_complex(s.activity("tool_name", "file_path"), s.chunks("text", "file_path"))


@query("d19_enriched_text")
def _(s: Store) -> DataFrame:
    return C.enriched_text(s.memories("content"), s.nodes("label"), s.edges("src", "dst", "relationship")).select("id", F.length("text").alias("n"))


# ---- E: aggregations ---------------------------------------------------------


@query("e01_totals", "SELECT 'memories' AS what, count(*) AS n FROM mem UNION ALL SELECT 'embeddings', count(*) FROM emb UNION ALL SELECT 'nodes', count(*) FROM nod UNION ALL SELECT 'edges', count(*) FROM edg ")
def _(s: Store) -> DataFrame:
    return A.totals(s.memories("created_at"), s.nodes(), s.edges(), s.embeddings())


def _grouped(tools: str, by: str, least: int) -> str:
    return f"SELECT {by}, count(*) AS n, count(DISTINCT session_id) AS sessions, string_agg(DISTINCT tool_name, ',' ORDER BY tool_name) AS tools FROM act WHERE tool_name IN ({tools}) AND {by} IS NOT NULL GROUP BY 1 HAVING count(*) >= {least}"


@query("e03_repeated_searches", _grouped("'Grep', 'Glob'", "pattern", 3))
def _(s: Store) -> DataFrame:
    return A.repeated_searches(s.activity(), 3)


@query("e04_file_hotspots", _grouped("'Read', 'Edit', 'Write'", "file_path", 5))
def _(s: Store) -> DataFrame:
    return A.file_hotspots(s.activity(), 5)


@query("e05_tool_usage", "SELECT tool_name, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM act WHERE tool_name IS NOT NULL GROUP BY 1")
def _(s: Store) -> DataFrame:
    return A.tool_usage(s.activity())


@query("e06_edit_chains", _grouped("'Edit', 'Write'", "file_path", 2))
def _(s: Store) -> DataFrame:
    return A.edit_chains(s.activity(), 2)


@query("e07_session_summary", "SELECT session_id, count(DISTINCT CASE WHEN tool_name = 'Read' THEN file_path END) AS files_read, count(DISTINCT CASE WHEN tool_name IN ('Edit', 'Write') THEN file_path END) AS files_edited, count(*) FILTER (tool_name IN ('Grep', 'Glob')) AS searches, count(*) AS actions FROM act WHERE session_id IS NOT NULL GROUP BY 1")
def _(s: Store) -> DataFrame:
    return A.session_summary(s.activity())


@query("e08_hot_directories", "SELECT session_id, directory, count(*) AS n FROM act WHERE session_id IS NOT NULL AND directory IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, directory) <= 5")
def _(s: Store) -> DataFrame:
    return A.hot_directories(s.activity(), 5)


@query("e10_namespace_stats", "SELECT namespace, count(*) AS n, round(avg(importance), 9) AS avg_importance, round(avg(confidence), 9) AS avg_confidence, count(DISTINCT lower(trim(memory_type))) AS kinds, min(created_at) AS first_at, max(created_at) AS last_at FROM mem WHERE namespace IS NOT NULL GROUP BY 1")
def _(s: Store) -> DataFrame:
    return A.namespace_stats(s.memories("namespace", "importance", "confidence", "memory_type", "created_at"))


@query("e10_tag_counts", "SELECT namespace, tag, count(*) AS n FROM (SELECT DISTINCT id, namespace, lower(trim(t)) AS tag FROM (SELECT id, namespace, unnest(tags) AS t FROM mem )) WHERE tag <> '' GROUP BY 1, 2")
def _(s: Store) -> DataFrame:
    return A.tag_counts(s.memories("namespace", "tags"))


@query("e11_timeline", "SELECT strftime(created_at, '%Y-%m-%d') AS day, lower(trim(memory_type)) AS kind, count(*) AS n FROM mem GROUP BY 1, 2")
def _(s: Store) -> DataFrame:
    return A.timeline(s.memories("created_at", "memory_type"))


@query("e12_importance_histogram", "SELECT CAST(least(greatest(floor(importance * 10), 0), 9) AS INT) AS bucket, count(*) AS n FROM mem WHERE importance IS NOT NULL GROUP BY 1")
def _(s: Store) -> DataFrame:
    return A.importance_histogram(s.memories("importance"))


@query("e13_graph_stats", "SELECT 'node' AS what, kind, count(*) AS n FROM nod GROUP BY 2 UNION ALL SELECT 'edge', relationship, count(*) FROM edg GROUP BY 2")
def _(s: Store) -> DataFrame:
    return A.graph_stats(s.nodes(), s.edges())


@query(
    "e14_latency_percentiles",
    """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most, min(value) FILTER (r = floor(0.5 * (n - 1) + 0.5)) AS p50, min(value) FILTER (r = floor(0.95 * (n - 1) + 0.5)) AS p95, min(value) FILTER (r = floor(0.99 * (n - 1) + 0.5)) AS p99 FROM o GROUP BY 1""",
)
def _(s: Store) -> DataFrame:
    return A.latency_percentiles(s.raw("events"), "event_type", "value").withColumn("total", F.round("total", 6))


@query("e16_api_surface", "WITH y AS (SELECT DISTINCT id, json_extract_string(payload, '$.file_path') AS file_path, json_extract_string(payload, '$.visibility') AS v FROM nod WHERE kind IN ('function', 'method')) SELECT file_path, count(*) FILTER (v = 'public') AS public, count(*) FILTER (v IS DISTINCT FROM 'public') AS private, count(*) FILTER (v = 'public') / count(*) AS share FROM y WHERE file_path IS NOT NULL GROUP BY 1")
def _(s: Store) -> DataFrame:
    return N.api_surface(s.nodes("kind", "payload"))


@query("e17_doc_coverage")
def _(s: Store) -> DataFrame:
    n = s.nodes("kind", "payload", "label")
    documented = F.contains("label", F.lit("shard")) | F.contains("label", F.lit("index"))  # the test data have no doc_comment
    return N.doc_coverage(n.withColumn("payload", F.when(documented, F.regexp_replace("payload", r"\}$", ',"doc_comment":"text"}')).otherwise(F.col("payload"))))


@query("e20_namespaces_with_stats", "SELECT namespace, count(*) AS memories, count(DISTINCT session_id) AS sessions FROM mem WHERE namespace IS NOT NULL GROUP BY 1")
def _(s: Store) -> DataFrame:
    return s.memories("namespace", "session_id").where("namespace IS NOT NULL").groupBy("namespace").agg(F.count("*").alias("memories"), F.countDistinct("session_id").alias("sessions"))


@query("e22_activity_cube", "SELECT coalesce(tool_name, '-') AS tool, coalesce(directory, '-') AS directory, count(*) AS n, grouping(tool, directory) AS level FROM (SELECT coalesce(tool_name, '-') AS tool_name, coalesce(directory, '-') AS directory FROM act ) GROUP BY CUBE (1, 2)".replace("SELECT coalesce(tool_name, '-') AS tool, coalesce(directory, '-') AS directory, count(*) AS n, grouping(tool, directory) AS level FROM (SELECT coalesce(tool_name, '-') AS tool_name,", "SELECT tool, directory, count(*) AS n, CAST(grouping(tool, directory) AS INT) AS level FROM (SELECT coalesce(tool_name, '-') AS tool,").replace("CUBE (1, 2)", "CUBE (tool, directory)"))
def _(s: Store) -> DataFrame:
    return A.cubed(s.activity())


@query("e21_activity_bursts", "SELECT session_id, CAST(sum(CASE WHEN p IS NULL OR date_sub('second', p, created_at) > 1800 THEN 1 ELSE 0 END) AS BIGINT) AS bursts FROM (SELECT session_id, created_at, lag(created_at) OVER (PARTITION BY session_id ORDER BY created_at) AS p FROM act WHERE session_id IS NOT NULL AND created_at IS NOT NULL) GROUP BY 1")
def _(s: Store) -> DataFrame:
    return A.gap_sessions(s.activity())


# ---- F, G: windows and sets ---------------------------------------------------


@query("f01_latest_per_hash", "SELECT content_hash, id FROM mem WHERE content_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY updated_at DESC, created_at DESC, id DESC) = 1")
def _(s: Store) -> DataFrame:
    return R.latest_per_hash(s.memories("content_hash", "created_at"))


@query("f05_important_nodes")
def _(s: Store) -> DataFrame:
    ranks = G.pagerank(s.nodes("kind").where("kind <> 'memory'"), s.edges("src", "dst"), tolerance=0.0)
    return ranks.orderBy(F.round("rank", 12).desc(), "id").limit(20).select("id", F.round("rank", 6).alias("rank"))


@query("f06_top_subgraph")
def _(s: Store) -> DataFrame:
    return G.top_subgraph(s.nodes("kind", "centrality"), s.edges("src", "dst", "relationship"), 50)[0].select("id")


@query("f09_definition_extents", "WITH d AS (SELECT DISTINCT id, file_path, line_start AS line, len(string_split(parent_symbol, '::')) AS depth FROM chk WHERE parent_symbol IS NOT NULL) SELECT id, line, (SELECT min(o.line) - 1 FROM d AS o WHERE o.file_path = d.file_path AND o.line > d.line AND o.depth <= d.depth) AS line_end FROM d")
def _(s: Store) -> DataFrame:
    c = s.chunks("file_path", "line_start", "parent_symbol").where("parent_symbol IS NOT NULL")
    return V.definition_extents(c.select("id", "file_path", F.col("line_start").alias("line"), F.size(F.split("parent_symbol", "::")).alias("depth")))


@query("g01_namespaces", "SELECT namespace FROM mem WHERE namespace IS NOT NULL UNION SELECT namespace FROM nod WHERE namespace IS NOT NULL")
def _(s: Store) -> DataFrame:
    return R.namespaces(s.memories("namespace"), s.nodes("namespace"))


@query("g04_dangling_edges", "SELECT DISTINCT id, src, dst FROM edg WHERE src NOT IN (SELECT id FROM nod WHERE id IS NOT NULL) OR dst NOT IN (SELECT id FROM nod WHERE id IS NOT NULL)")
def _(s: Store) -> DataFrame:
    return R.dangling_edges(s.nodes(), s.edges("src", "dst"))


@query("g05_induced_edges", "WITH n AS (SELECT id FROM nod WHERE kind IN ('function', 'method')) SELECT id, src, dst FROM (SELECT DISTINCT id, src, dst FROM edg ) WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def _(s: Store) -> DataFrame:
    return R.induced_edges(s.edges("src", "dst"), s.nodes("kind").where("kind IN ('function', 'method')"))


# ---- H, I: vectors and text ---------------------------------------------------


def _probe(s: Store) -> DataFrame:
    """The stated query set of searches: vectors whose id ends in 00 (hexadecimal)."""
    return s.embeddings().where("embedding IS NOT NULL AND memory_id LIKE '%00'").groupBy(F.col("memory_id").alias("query_id")).agg(F.max("embedding").alias("vector"))


_UNIT = "e AS (SELECT memory_id, embedding AS v, len(embedding) AS d, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM emb WHERE embedding IS NOT NULL AND len(embedding) > 0)"


@query(
    "h01_nearest",
    f"""WITH {_UNIT}, q AS (SELECT * FROM e WHERE memory_id LIKE '%00'),
s AS (SELECT q.memory_id AS query_id, e.memory_id AS id, CASE WHEN q.n * e.n < 1e-12 THEN 0.0 ELSE list_inner_product(CAST(q.v AS DOUBLE[]), CAST(e.v AS DOUBLE[])) / (q.n * e.n) END AS score FROM q JOIN e ON e.d = q.d WHERE e.memory_id <> q.memory_id)
SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10""",
)
def _(s: Store) -> DataFrame:
    return H.nearest(s.embeddings(), _probe(s), 10, key="memory_id", vector="embedding").select("query_id", "id", F.round("score", 6).alias("score"))


@query("h06_pca")
def _(s: Store) -> DataFrame:
    return H.pca(s.embeddings(), "memory_id", "embedding", 3, model="model")




@query("i01_tokens", f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TOKENS.format('content')}) AS term FROM mem ) GROUP BY 1, 2")
def _(s: Store) -> DataFrame:
    return X.postings(s.memories("content"), "id", "content").select("id", "term", "tf")


def _asked(s: Store) -> DataFrame:
    rows = [("q1", "retry the loader after the crate shard fails"), ("q2", "parser verifies a nonce in src/parser"), ("q3", "HistogramFrame gives up"), ("q4", "zzz nothing")]
    return s.spark.createDataFrame(rows, "query_id string, query string")


@query(
    "i04_bm25",
    f"""WITH t AS (SELECT id, {TOKENS.format("content")} AS w FROM mem WHERE content IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
p AS (SELECT id, len(w) AS dl, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM t) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT query_id, unnest({TOKENS.format("query")}) AS term FROM (VALUES ('q1', 'retry the loader after the crate shard fails'), ('q2', 'parser verifies a nonce in src/parser'), ('q3', 'HistogramFrame gives up'), ('q4', 'zzz nothing')) AS v(query_id, query)),
w AS (SELECT query_id, term, n, avgdl, ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1) AS idf FROM q LEFT JOIN df USING (term), st),
mx AS (SELECT query_id, sum(idf * 10 * 2.2 / (10 + 1.2)) AS most FROM w GROUP BY 1)
SELECT query_id, id, round(least(1.0, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) / any_value(most)), 9) AS score FROM p JOIN w USING (term) JOIN mx USING (query_id) GROUP BY 1, 2""",
)
def _(s: Store) -> DataFrame:
    return X.bm25(s.memories("content"), _asked(s), "id", "content").select("query_id", "id", F.round("score", 9).alias("score"))


@query("i07_code_references")
def _(s: Store) -> DataFrame:
    return X.code_references(s.memories("content"), "id", "content")


@query("i09_overlap")
def _(s: Store) -> DataFrame:
    return X.with_overlap(s.chunks("file_path", "chunk_index", "text"), 2).select("id", F.length("text").alias("n"))


@query("i10_signature", r"SELECT DISTINCT id, CASE WHEN length(l) <= 120 THEN l WHEN regexp_extract(left(l, 120), '^(.*)\s\S*$', 1) <> '' THEN regexp_extract(left(l, 120), '^(.*)\s\S*$', 1) ELSE left(l, 120) END AS signature FROM (SELECT id, split_part(text, chr(10), 1) AS l FROM chk )")
def _(s: Store) -> DataFrame:
    return s.chunks("text").select("id", S.signature("text").alias("signature")).distinct()


# ---- J: recall -----------------------------------------------------------------


def _centrality(s: Store) -> tuple[DataFrame, DataFrame]:
    """PageRank and betweenness over the whole graph."""
    n, e = s.nodes("kind"), s.edges("src", "dst")
    return durable(G.pagerank(n, e)), durable(G.betweenness(n, e))


def _recall_tables(s: Store) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = s.memories("content", "tags", "importance", "confidence", "last_accessed_at", "expires_at", "memory_type", "namespace", "git_ref")
    return m, s.nodes("kind", "valid_from", "valid_to", "memory_id"), s.edges("src", "dst", "relationship", "weight", "valid_from", "valid_to")


def _with_vectors(s: Store, m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model of the stored vectors can't be asked here, so queries and contents are embedded alike by hashed words."""
    embed = E.hashed_words(64)
    return _asked(s).withColumn("vector", embed(F.col("query"))), m.where("content IS NOT NULL").select(F.col("id").alias("memory_id"), embed(F.col("content")).alias("embedding"))


def _recall(s: Store, ranks: DataFrame, between: DataFrame, k: int = 10) -> DataFrame:
    m, n, e = _recall_tables(s)
    asked, vectors = _with_vectors(s, m)
    return recall(m, n, e, asked, NOW, k=k, embeddings=vectors, ranks=ranks, between=between)


@query("j05_recall")
def _(s: Store) -> DataFrame:
    return _recall(s, *_centrality(s))


@query("j05_recall_filtered")
def _(s: Store) -> DataFrame:
    """Without vectors every query falls back on all memories that pass the filters."""
    m, n, e = _recall_tables(s)
    ranks = G.pagerank(n, e, tolerance=0.0)
    found = recall(m, n, e, _asked(s), NOW, k=20, ranks=ranks, memory_type="context", exclude_tags=("static-analysis",), min_importance=0.2)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.round("words", 6).alias("words"), F.round("graph", 6).alias("graph"), "tags")


@query("j07_recall_expanded")
def _(s: Store) -> DataFrame:
    m, n, e = _recall_tables(s)
    asked, vectors = _with_vectors(s, m)
    ranks, between = _centrality(s)
    return recall_expanded(m, n, e, asked, NOW, depth=1, embeddings=vectors, ranks=ranks, between=between).select("query_id", "id", "path", "score")


@query("j08_recall_with_impact")
def _(s: Store) -> DataFrame:
    ranks, between = _centrality(s)
    out = with_impact(durable(_recall(s, ranks, between)), s.nodes("kind", "label", "payload"), s.edges("src", "dst"), s.memories("memory_type"), ranks, between)
    return out.select("query_id", "id", "pagerank", "betweenness", F.size("files").alias("files"), F.size("decisions").alias("decisions"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return _recall(s, *_centrality(s))


# ---- K: graph --------------------------------------------------------------------


_HUB = "(SELECT src FROM edg WHERE relationship = 'CALLS' GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1)"


def _hub(s: Store) -> DataFrame:
    e = s.edges("src", "dst", "relationship").where("relationship = 'CALLS'")
    return e.groupBy("src").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "src").limit(1).select(F.col("src").alias("id"))


@query("k01_bfs", f"WITH RECURSIVE b AS (SELECT src AS id, 0 AS depth FROM {_HUB} UNION SELECT x.b, depth + 1 FROM b JOIN (SELECT src AS a, dst AS b FROM edg UNION SELECT dst, src FROM edg ) AS x ON x.a = b.id WHERE depth < 2) SELECT id, min(depth) AS depth FROM b GROUP BY 1")
def _(s: Store) -> DataFrame:
    return G.bfs(s.edges("src", "dst"), _hub(s), 2)


@query("k03_bfs_filtered", f"WITH RECURSIVE b AS (SELECT src AS id, 0 AS depth FROM {_HUB} UNION SELECT x.dst, depth + 1 FROM b JOIN edg AS x ON x.src = b.id AND x.relationship = 'CALLS' WHERE depth < 3) SELECT id, min(depth) AS depth FROM b WHERE id NOT IN (SELECT id FROM nod WHERE kind = 'method') GROUP BY 1")
def _(s: Store) -> DataFrame:
    return G.bfs_filtered(s.nodes("kind"), s.edges("src", "dst", "relationship"), _hub(s), 3, ("method",), ("CALLS",))


@query("k02_reachable", f"WITH RECURSIVE b AS (SELECT src AS id FROM {_HUB} UNION SELECT x.dst FROM b JOIN edg AS x ON x.src = b.id AND x.relationship = 'CALLS') SELECT id FROM b")
def _(s: Store) -> DataFrame:
    return G.reachable(s.edges("src", "dst", "relationship"), _hub(s), "out", ("CALLS",))


@query("k06_components")
def _(s: Store) -> DataFrame:
    return G.components(s.nodes("kind"), s.edges("src", "dst", "relationship").where("relationship IN ('SHARES_THEME', 'PRECEDED_BY')"))


def _calls(s: Store) -> tuple[DataFrame, DataFrame]:
    return s.nodes("kind").where("kind IN ('function', 'method')"), s.edges("src", "dst", "relationship", "weight").where("relationship = 'CALLS'")


@query("k07_strongly_connected")
def _(s: Store) -> DataFrame:
    return G.strongly_connected(*_calls(s))


@query("k08_topological_layers")
def _(s: Store) -> DataFrame:
    return G.topological_layers(*_calls(s))


@query("k09_cycles")
def _(s: Store) -> DataFrame:
    return G.cycles(*_calls(s))


@query("k10_degree_centrality", "WITH n AS (SELECT DISTINCT id FROM nod ), d AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM edg UNION ALL SELECT dst FROM edg ) GROUP BY 1) SELECT id, coalesce(d, 0) AS degree, round(coalesce(d, 0) / ((SELECT count(*) FROM n) - 1), 9) AS centrality FROM n LEFT JOIN d USING (id)")
def _(s: Store) -> DataFrame:
    return G.degree_centrality(s.nodes(), s.edges("src", "dst")).withColumn("centrality", F.round("centrality", 9))


@query(
    "k11_pagerank",
    """WITH RECURSIVE n AS (SELECT DISTINCT id FROM nod WHERE kind IN ('function', 'method')), c AS (SELECT src, dst FROM edg WHERE relationship = 'CALLS' AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)),
o AS (SELECT src, count(*) AS o FROM c GROUP BY 1), k AS (SELECT count(*) AS k FROM n),
r AS (SELECT 0 AS i, id, 1.0 / k AS r FROM n, k UNION ALL (WITH p AS (SELECT * FROM r), f AS (SELECT c.dst AS id, sum(p.r / o.o) AS f FROM p JOIN c ON c.src = p.id JOIN o ON o.src = p.id GROUP BY 1), l AS (SELECT coalesce(sum(r), 0) AS l FROM p WHERE id NOT IN (SELECT src FROM o))
SELECT p.i + 1, p.id, 0.15 / k + 0.85 * (coalesce(f.f, 0) + l / k) FROM p LEFT JOIN f USING (id), k, l WHERE p.i < 10))
SELECT id, round(r, 7) AS rank FROM r WHERE i = 10""",
)
def _(s: Store) -> DataFrame:
    return G.pagerank(*_calls(s), rounds=10, tolerance=0.0).select("id", F.round("rank", 7).alias("rank"))


@query("k12_pagerank_by_namespace")
def _(s: Store) -> DataFrame:
    return G.pagerank(s.nodes("namespace"), s.edges("src", "dst"), by="namespace", tolerance=1e-7).select("id", F.round("rank", 6).alias("rank"))


@query("k13_personalised_pagerank")
def _(s: Store) -> DataFrame:
    n, e = _calls(s)
    return G.pagerank(n, e, seeds=_hub(s), tolerance=0.0).select("id", F.round("rank", 6).alias("rank"))


@query("k14_betweenness")
def _(s: Store) -> DataFrame:
    return G.betweenness(*_calls(s)).withColumn("betweenness", F.round("betweenness", 9))


@query("k15_communities")
def _(s: Store) -> DataFrame:
    return G.communities(*_calls(s))


@query("k17_community_labels")
def _(s: Store) -> DataFrame:
    return G.community_labels(G.communities(*_calls(s)), s.nodes("payload"))


@query("k19_summary_tree", "WITH RECURSIVE c AS (SELECT DISTINCT src, dst FROM edg WHERE relationship = 'CONTAINS'), root AS (SELECT src FROM c GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1), t AS (SELECT src AS id, 0 AS depth FROM root UNION SELECT c.dst, depth + 1 FROM t JOIN c ON c.src = t.id WHERE depth < 3) SELECT id, min(depth) AS depth FROM t GROUP BY 1")
def _(s: Store) -> DataFrame:
    e = s.edges("src", "dst", "relationship")
    c = e.where("relationship = 'CONTAINS'").select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "src").first()
    return G.summary_tree(s.nodes("kind"), e, c["src"] if c else "", 3).select("id", "depth")


@query("k20_node_memories")
def _(s: Store) -> DataFrame:
    hub = _hub(s).first()
    return G.node_memories(s.nodes("kind"), s.edges("src", "dst", "relationship"), hub["id"] if hub else "", 2)


@query("k21_coverage", "WITH m AS (SELECT DISTINCT id FROM nod WHERE kind = 'memory'), x AS (SELECT src AS a, dst AS b FROM edg UNION ALL SELECT dst, src FROM edg ) SELECT id, count(b) AS memories FROM (SELECT DISTINCT id FROM nod WHERE kind <> 'memory') AS n LEFT JOIN (SELECT * FROM x WHERE b IN (SELECT id FROM m)) AS y ON y.a = n.id GROUP BY 1")
def _(s: Store) -> DataFrame:
    return G.coverage(s.nodes("kind"), s.edges("src", "dst"))


@query("k22_decision_chain", "SELECT id, created_at FROM mem WHERE lower(trim(memory_type)) = 'decision' AND (contains(lower(content), 'loader') OR contains(lower(array_to_string(tags, ' ')), 'loader'))")
def _(s: Store) -> DataFrame:
    return G.decision_chain(s.memories("memory_type", "content", "created_at", "tags", "metadata"), s.edges("src", "dst", "relationship"), "loader")


@query("k22_decisions_by_precedence", "WITH RECURSIVE d AS (SELECT id, content, created_at, tags FROM mem WHERE lower(trim(memory_type)) = 'decision'), e AS (SELECT src AS a, dst AS b FROM edg WHERE relationship IN ('PRECEDED_BY', 'SHARES_THEME') AND src IN (SELECT id FROM d) AND dst IN (SELECT id FROM d)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT id FROM d WHERE contains(lower(content), 'rust') OR contains(lower(array_to_string(tags, ' ')), 'rust') UNION SELECT u.b FROM r JOIN u ON u.a = r.id) SELECT d.id, created_at FROM d WHERE id IN (SELECT id FROM r)")
def _(s: Store) -> DataFrame:
    return G.decision_chain(s.memories("memory_type", "content", "created_at", "tags", "metadata"), s.edges("src", "dst", "relationship"), file_path="Rust", relationships=("PRECEDED_BY", "SHARES_THEME"))


# ---- L: time -----------------------------------------------------------------------


_VALID = "(valid_from IS NULL OR valid_from <= TIMESTAMP '{0}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{0}')"


@query("l07_graph_at", f"SELECT 'node' AS what, kind, count(*) AS n FROM nod WHERE {_VALID.format(BEFORE)} GROUP BY 2 UNION ALL SELECT 'edge', relationship, count(*) FROM edg WHERE {_VALID.format(BEFORE)} GROUP BY 2")
def _(s: Store) -> DataFrame:
    return T.graph_at(s.nodes(), s.edges(), BEFORE)


@query("l06_what_changed", f"WITH x AS (SELECT relationship, strftime(valid_from, '%Y-%m-%d') AS day, 1 AS p, 0 AS q FROM edg WHERE valid_from BETWEEN TIMESTAMP '{BEFORE}' AND TIMESTAMP '{NOW}' UNION ALL SELECT relationship, strftime(valid_to, '%Y-%m-%d'), 0, 1 FROM edg WHERE valid_to BETWEEN TIMESTAMP '{BEFORE}' AND TIMESTAMP '{NOW}') SELECT relationship, day, CAST(sum(p) AS BIGINT) AS added, CAST(sum(q) AS BIGINT) AS ended FROM x GROUP BY 1, 2")
def _(s: Store) -> DataFrame:
    return T.what_changed(s.edges(), BEFORE, NOW)


@query("l08_stale_files")
def _(s: Store) -> DataFrame:
    touched = T.ingest_commits(_commits(s))[1].select("id", "src", "dst", "relationship", "valid_from")
    return T.stale_files(s.nodes("kind", "centrality", "valid_to"), s.edges("src", "dst", "relationship", "valid_from").unionByName(touched), NOW)


@query("l09_drift")
def _(s: Store) -> DataFrame:
    return T.drift(s.nodes("kind", "valid_from", "valid_to"), s.edges("src", "dst", "valid_from"), "2025-03-01 00:00:00", NOW)


@query("l10_symbol_history", f"WITH h AS {_HUB} SELECT id AS edge_id, CASE WHEN e.src = h.src THEN dst ELSE e.src END AS other, relationship, coalesce(valid_from, created_at) AS at FROM edg AS e, h WHERE e.src = h.src OR e.dst = h.src")
def _(s: Store) -> DataFrame:
    hub = _hub(s).first()
    return T.symbol_history(s.edges(), hub["id"] if hub else "")


def _commits(s: Store) -> DataFrame:
    """Sessions as commits: what a session edited, by day."""
    a = s.activity("session_id", "tool_name", "file_path", "created_at").where("tool_name IN ('Edit', 'Write') AND file_path IS NOT NULL AND session_id IS NOT NULL")
    own = a.groupBy("session_id", F.to_date("created_at").alias("d")).agg(F.array_sort(F.collect_set("file_path")).alias("files"), F.max("created_at").alias("date"))
    return own.select(F.concat_ws("@", "session_id", F.col("d").cast("string")).alias("hash"), F.substring("session_id", 1, 2).alias("author"), "date", F.concat(F.lit("change (#"), F.conv(F.substring("session_id", 1, 2), 16, 10), F.lit(")")).alias("subject"), "files")


_COMMITS = "c AS (SELECT DISTINCT session_id || '@' || strftime(created_at, '%Y-%m-%d') AS hash, left(session_id, 2) AS author, file_path AS file FROM act WHERE tool_name IN ('Edit', 'Write') AND file_path IS NOT NULL AND session_id IS NOT NULL)"


@query("l01_ingest_commits")
def _(s: Store) -> DataFrame:
    return T.ingest_commits(_commits(s))[1].select("id", "src", "dst")


@query("l04_pull_requests")
def _(s: Store) -> DataFrame:
    return T.pull_requests(_commits(s))


# ---- M: review -----------------------------------------------------------------------


def _lines(s: Store) -> DataFrame:
    """Changed lines: the first line of every chunk of a file in src/alert or src/arena."""
    return s.chunks("file_path", "line_start").where("file_path LIKE 'src/a%'").select("file_path", F.col("line_start").alias("line"))


_CHANGED = "r AS (SELECT 'sym:' || parent_symbol AS symbol, file_path, min(line_start) AS a, max(line_end) AS b FROM chk WHERE parent_symbol IS NOT NULL GROUP BY 1, 2), l AS (SELECT DISTINCT file_path, line_start AS line FROM chk WHERE file_path LIKE 'src/a%')"


@query("m01_lines_to_symbols", f"WITH {_CHANGED} SELECT DISTINCT l.file_path, line, symbol FROM l JOIN r ON r.file_path = l.file_path AND line BETWEEN a AND b")
def _(s: Store) -> DataFrame:
    c = s.chunks("file_path", "line_start", "line_end", "parent_symbol")
    return V.lines_to_ranges(_lines(s), V.symbol_ranges(c)).distinct()


def _seeds(s: Store) -> DataFrame:
    return s.nodes("kind").where("kind = 'function' AND id LIKE 'sym:a%'").select("id").distinct()


@query("m02_dependents", "WITH RECURSIVE x AS (SELECT DISTINCT src, dst FROM edg WHERE relationship IN ('CALLS', 'IMPORTS', 'INHERITS', 'IMPLEMENTS', 'OVERRIDES') AND starts_with(src, 'sym:')), b AS (SELECT DISTINCT id, 0 AS depth FROM nod WHERE kind = 'function' AND id LIKE 'sym:a%' UNION SELECT x.src, depth + 1 FROM b JOIN x ON x.dst = b.id WHERE depth < 2) SELECT id, min(depth) AS depth FROM b GROUP BY 1 HAVING min(depth) > 0")
def _(s: Store) -> DataFrame:
    return V.dependents(s.edges("src", "dst", "relationship"), _seeds(s), 2)


@query("m02_blast_radius")
def _(s: Store) -> DataFrame:
    n, e = _calls(s)
    return V.blast_radius(s.nodes("kind", "payload"), e, _seeds(s), G.pagerank(n, e, tolerance=1e-7)).withColumn("risk", F.round("risk", 6))


@query("m03_missing_changes", "WITH x AS (SELECT DISTINCT src, dst FROM edg WHERE relationship = 'CALLS'), o AS (SELECT DISTINCT id FROM nod WHERE kind = 'function' AND id LIKE 'sym:a%'), s AS (SELECT DISTINCT dst FROM x WHERE src IN (SELECT id FROM o)) SELECT src AS id, count(*) AS n FROM x WHERE src NOT IN (SELECT id FROM o) AND dst IN (SELECT dst FROM s) GROUP BY 1 HAVING count(*) >= greatest((SELECT count(*) FROM o) // 2, 2)")
def _(s: Store) -> DataFrame:
    return V.missing_changes(s.edges("src", "dst", "relationship"), _seeds(s))


@query("m04_co_changed", f"WITH {_COMMITS}, p AS (SELECT a.file AS src, b.file AS dst, count(*) / (SELECT count(DISTINCT hash) FROM c) AS weight FROM c AS a JOIN c AS b ON a.hash = b.hash AND a.file <> b.file GROUP BY 1, 2 HAVING count(*) >= 2) SELECT dst AS id, round(avg(weight), 9) AS weight FROM p WHERE src LIKE 'src/a%' AND dst NOT LIKE 'src/a%' GROUP BY 1")
def _(s: Store) -> DataFrame:
    p = N.co_change_pairs(_commits(s), 2, 1_000_000).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("CO_CHANGED").alias("relationship"), "weight")
    files = s.activity("file_path").where("file_path LIKE 'src/a%'").select(F.col("file_path").alias("id"))
    return V.co_changed(p, files, 0.0).withColumn("weight", F.round("weight", 9))


@query("m05_test_impact")
def _(s: Store) -> DataFrame:
    n, e = s.nodes("kind", "label", "payload"), s.edges("src", "dst", "relationship")
    return V.test_impact(n, e, _seeds(s), 4, tests=F.col("kind") == "method")


# ---- N: code health -----------------------------------------------------------------


@query("n01_co_change_pairs", f"WITH {_COMMITS}, k AS (SELECT hash, count(*) AS k FROM c GROUP BY 1 HAVING count(*) <= 50) SELECT a.file AS a, b.file AS b, count(*) AS n, round(count(*) / (SELECT count(DISTINCT hash) FROM c), 9) AS weight FROM c AS a JOIN c AS b ON a.hash = b.hash AND a.file < b.file WHERE a.hash IN (SELECT hash FROM k) GROUP BY 1, 2 HAVING count(*) >= 2")
def _(s: Store) -> DataFrame:
    return N.co_change_pairs(_commits(s)).withColumn("weight", F.round("weight", 9))


@query("n01_file_stats", f"WITH {_COMMITS} SELECT file, count(*) AS commits, count(DISTINCT author) AS authors, count(*) / 3.0 AS churn FROM c GROUP BY 1")
def _(s: Store) -> DataFrame:
    return N.file_stats(_commits(s))


@query("n02_security_names")
def _(s: Store) -> DataFrame:
    return N.security_names(s.nodes("kind", "label"))


@query("n03_security_scan")
def _(s: Store) -> DataFrame:
    """A line is put behind three of four texts: the code of the test data has nothing to be found."""
    turn = F.col("chunk_index") % 4
    line = F.when(turn == 0, '\napi_key = "abcdefgh1"').when(turn == 1, "\nunsafe { x }; unsafe{}").when(turn == 2, "\nq = SELECT a + name").otherwise("")
    c = s.chunks("chunk_index", "text").where("chunk_index IS NOT NULL AND text IS NOT NULL")
    return N.security_scan(c.withColumn("text", F.concat("text", line)))


@query("n04_coupling", "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edg UNION ALL SELECT dst FROM edg ) GROUP BY 1 HAVING count(*) > 15")
def _(s: Store) -> DataFrame:
    return N.coupling(s.edges("src", "dst"))


@query("n04_symbols_per_file", "SELECT json_extract_string(payload, '$.file_path') AS file_path, count(DISTINCT id) AS symbols FROM nod WHERE kind IN ('function', 'method') AND json_extract_string(payload, '$.file_path') IS NOT NULL GROUP BY 1")
def _(s: Store) -> DataFrame:
    return N.symbols_per_file(s.nodes("kind", "payload"))


@query("n05_complexity")
def _(s: Store) -> DataFrame:
    return N.complexity(s.chunks("text"))


@query("n06_code_smells")
def _(s: Store) -> DataFrame:
    return N.code_smells(s.chunks("text", "file_path", "line_start", "line_end", "node_kind"))


@query("n07_architecture")
def _(s: Store) -> DataFrame:
    return N.architecture(s.edges("src", "dst", "relationship"))


def _with_tests(s: Store) -> DataFrame:
    """The functions, with the methods as their tests: the test data name none."""
    n = s.nodes("kind", "label", "payload").where("kind IN ('function', 'method')")
    return n.withColumn("label", F.when(F.col("kind") == "method", F.concat(F.lit("test_"), F.coalesce("label", "id"))).otherwise(F.col("label")))


@query("n08_test_mapping")
def _(s: Store) -> DataFrame:
    return N.test_mapping(_with_tests(s), s.edges("src", "dst", "relationship"))


@query("n08_untested")
def _(s: Store) -> DataFrame:
    return N.untested(_with_tests(s), s.edges("src", "dst", "relationship"))


@query("n09_ownership", f"WITH {_COMMITS}, k AS (SELECT file, author, count(*) AS k FROM c GROUP BY 1, 2) SELECT file, author AS owner, k AS owned, count(*) OVER (PARTITION BY file) AS contributors, count(*) OVER (PARTITION BY file) > 5 AS crowded FROM k QUALIFY row_number() OVER (PARTITION BY file ORDER BY k DESC, author) = 1")
def _(s: Store) -> DataFrame:
    return N.ownership(_commits(s))


@query("n10_reassessed", "SELECT id, i AS importance FROM (SELECT id, coalesce(importance, 0.5) AS was, CASE WHEN list_contains(tags, 'critical') THEN greatest(coalesce(importance, 0.5), 0.8) WHEN list_contains(tags, 'signal') THEN least(greatest(coalesce(importance, 0.5), 0.5), 0.7) WHEN list_contains(tags, 'noise') THEN least(coalesce(importance, 0.5), 0.3) ELSE coalesce(importance, 0.5) END AS i FROM mem ) WHERE abs(i - was) > 0.01")
def _(s: Store) -> DataFrame:
    return N.reassessed(s.memories("tags", "importance"))


@query("n11_change_impact", "WITH x AS (SELECT DISTINCT src, dst FROM edg WHERE relationship = 'CALLS'), a AS (SELECT dst AS id, count(*) AS callers FROM x GROUP BY 1), b AS (SELECT src AS id, count(*) AS callees FROM x GROUP BY 1) SELECT id, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, 0 AS co_changed, least(greatest((coalesce(callers, 0) + coalesce(callees, 0)) / 20.0, 0.4), 0.9) AS importance FROM a FULL JOIN b USING (id)")
def _(s: Store) -> DataFrame:
    return N.change_impact(s.edges("src", "dst", "relationship", "weight"))


@query("n12_dead_code", "WITH f AS (SELECT DISTINCT id, label, json_extract_string(payload, '$.file_path') AS file_path FROM nod WHERE kind IN ('function', 'method')) SELECT id, file_path FROM f WHERE NOT coalesce(regexp_matches(lower(label), '^(main|new|test_.*|.*_test)$'), false) AND id NOT IN (SELECT dst FROM edg WHERE relationship IN ('CALLS', 'IMPORTS', 'INHERITS', 'IMPLEMENTS') AND dst IS NOT NULL) AND (SELECT count(*) FROM f) >= 10")
def _(s: Store) -> DataFrame:
    return N.dead_code(s.nodes("kind", "label", "payload"), s.edges("src", "dst", "relationship"))


@query("n16_activity_insights")
def _(s: Store) -> DataFrame:
    return N.activity_insights(s.memories("tags"), s.nodes("kind", "label"))


# ---- O: consolidation -----------------------------------------------------------------


@query("o01_decay", f"SELECT id, round(least(greatest(importance * pow(0.9, d / 30.0) * (1 + 0.1 * log2(greatest(coalesce(access_count, 0), 1))), 0), 1), 9) AS importance FROM (SELECT *, date_sub('second', last_accessed_at, TIMESTAMP '{NOW}') / 86400.0 AS d FROM mem ) WHERE importance IS NOT NULL AND d > 30")
def _(s: Store) -> DataFrame:
    return C.decayed(s.memories("importance", "access_count", "last_accessed_at"), NOW)


@query("o02_decay_flat", f"SELECT id, importance * 0.5 AS importance FROM mem WHERE last_accessed_at < TIMESTAMP '{BEFORE}'")
def _(s: Store) -> DataFrame:
    return C.decayed_flat(s.memories("importance", "last_accessed_at"), BEFORE, 0.5)


@query("o03_themes")
def _(s: Store) -> DataFrame:
    return C.themes(s.memories("memory_type"), s.embeddings(), s.edges("src", "dst")).withColumn("weight", F.round("weight", 6))


@query("o04_clusters")
def _(s: Store) -> DataFrame:
    m = s.memories("namespace", "memory_type", "importance", "tags")
    return C.clusters(m, C.near_duplicates(m, s.embeddings(), 0.8))


@query("o07_summaries")
def _(s: Store) -> DataFrame:
    comp = G.components(s.nodes("kind").where("kind = 'memory'"), s.edges("src", "dst", "relationship").where("relationship = 'SHARES_THEME'"))
    return C.summaries(comp, s.memories("content")).select("component", "n", F.length("text").alias("chars"))


@query("o10_tag_links")
def _(s: Store) -> DataFrame:
    return C.tag_links(s.memories("created_at", "namespace", "tags"))


@query("o11_code_links", "WITH w AS (SELECT DISTINCT m AS id, regexp_replace(regexp_replace(o, '^(sym|file|pkg|chunk|doc|ext|commit|pr|dir):', ''), '#\\d+$', '') AS word FROM (SELECT src AS m, dst AS o FROM edg WHERE relationship = 'RELATES_TO' UNION SELECT dst, src FROM edg WHERE relationship = 'RELATES_TO') AS e WHERE m IN (SELECT id FROM mem )), k AS (SELECT DISTINCT id AS dst, regexp_replace(id, '#\\d+$', '') AS name FROM nod WHERE kind <> 'memory') SELECT DISTINCT w.id AS src, k.dst, CAST(0.5 AS DOUBLE) AS weight FROM w JOIN k ON k.name IN ('file:' || word, 'sym:' || word)")
def _(s: Store) -> DataFrame:
    """The texts are the names of what each memory relates to: the contents of the test data name no node."""
    e = G.both_ways(s.edges("src", "dst", "relationship").where("relationship = 'RELATES_TO'")).distinct()
    name = F.regexp_replace(S.path_of("dst"), r"#\d+$", "")
    named = e.join(s.memories("created_at").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.concat(F.lit("see "), name, F.lit(" .")).alias("content"))
    return C.code_links(named, s.nodes("kind"))


@query("o09_merged")
def _(s: Store) -> DataFrame:
    m = s.memories("content", "importance", "confidence", "tags", "session_id")
    return C.merged(m, m.where("session_id IS NOT NULL").select(F.col("session_id").alias("key"), "id")).select("key", F.length("content").alias("chars"), "importance", F.size("tags").alias("tags"))


# ---- P: patterns ------------------------------------------------------------------------


@query("p_patterns")
def _(s: Store) -> DataFrame:
    return A.patterns(s.activity()).withColumn("confidence", F.round("confidence", 9))


@query("p_session_context", f"WITH r AS (SELECT 'recent' AS what, id, created_at AS at FROM mem WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND created_at <= TIMESTAMP '{NOW}'), w AS (SELECT 'pending' AS what, id, created_at AS at FROM mem WHERE list_contains(tags, 'pending-analysis') AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')), l AS (SELECT 'summary' AS what, id, ended_at AS at FROM ses WHERE summary IS NOT NULL AND ended_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY ended_at DESC, id DESC) = 1) SELECT * FROM r UNION ALL SELECT * FROM w UNION ALL SELECT * FROM l")
def _(s: Store) -> DataFrame:
    return A.session_context(s.memories("content", "created_at", "tags", "expires_at"), s.sessions(), NOW).select("what", "id", "at")


@query("p_categorised")
def _(s: Store) -> DataFrame:
    return A.categorised(s.memories("session_id", "metadata", "memory_type"))


# ---- Q: indexing ---------------------------------------------------------------------------


@query("q05_package_tree", "WITH RECURSIVE f AS (SELECT DISTINCT file_path FROM chk WHERE file_path LIKE '%/%'), p AS (SELECT regexp_replace(file_path, '/[^/]*$', '') AS d, 'file:' || file_path AS c FROM f UNION SELECT regexp_replace(d, '/[^/]*$', ''), 'pkg:' || d FROM p WHERE d LIKE '%/%') SELECT DISTINCT 'pkg:' || d AS src, c AS dst FROM p")
def _(s: Store) -> DataFrame:
    return L.package_tree(s.chunks("file_path").select("file_path").distinct())


@query("q06_reference_edges")
def _(s: Store) -> DataFrame:
    e = s.edges("src", "dst", "relationship", "weight").withColumn("confidence", F.coalesce("weight", F.lit(1.0))).drop("weight")
    return L.reference_edges(e).select("id", F.round("weight", 9).alias("weight"))


@query("q12_change_detection", "WITH n AS (SELECT file_path, sha256(string_agg(text, chr(10) ORDER BY chunk_index, id)) AS h FROM (SELECT DISTINCT id, file_path, chunk_index, text FROM chk WHERE text IS NOT NULL) GROUP BY 1), o AS (SELECT file_path, CASE WHEN file_path LIKE 'src/a%' THEN 'old' ELSE h END AS h FROM n WHERE file_path NOT LIKE 'src/b%') SELECT file_path, CASE WHEN o.h IS NULL THEN 'added' ELSE 'modified' END AS change FROM n LEFT JOIN o USING (file_path) WHERE o.h IS NULL OR o.h <> n.h")
def _(s: Store) -> DataFrame:
    c = s.chunks("file_path", "chunk_index", "text").where("text IS NOT NULL")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "text"))), lambda x: x["text"]), "\n")
    now = c.groupBy("file_path").agg(F.sha2(text, 256).alias("content_hash"))
    old = now.where("file_path NOT LIKE 'src/b%'").withColumn("content_hash", F.when(F.col("file_path").like("src/a%"), "old").otherwise(F.col("content_hash")))
    return R.changed_hashes(now, old)


@query(
    "q01_resolve",
    r"""WITH sy AS (SELECT parent_symbol AS symbol, min(file_path) AS sf FROM chk WHERE parent_symbol IS NOT NULL GROUP BY 1), s1 AS (SELECT symbol, sf, regexp_extract(symbol, '[^:]*$') AS simple FROM sy),
rf AS (SELECT DISTINCT id AS ref_id, file_path AS rf, CASE chunk_index % 4 WHEN 0 THEN parent_symbol WHEN 1 THEN 'crate::' || parent_symbol WHEN 2 THEN regexp_extract(parent_symbol, '[^:]*$') ELSE 'other::' || regexp_extract(parent_symbol, '[^:]*$') END AS name, chunk_index % 8 = 2 AS imp FROM chk WHERE parent_symbol IS NOT NULL AND chunk_index IS NOT NULL),
h AS (SELECT ref_id, 1 AS rule, 1.0 AS c, symbol FROM rf JOIN sy ON symbol = name UNION ALL SELECT ref_id, 2, 0.95, symbol FROM rf JOIN sy ON starts_with(name, 'crate::') AND symbol = substr(name, 8) UNION ALL SELECT ref_id, 3, 0.85, symbol FROM rf JOIN sy ON starts_with(name, 'crate::') AND ends_with(symbol, '::' || substr(name, 8)) UNION ALL SELECT ref_id, 4, 0.9, symbol FROM rf JOIN sy ON contains(name, '::') AND symbol = 'crate::' || name UNION ALL SELECT ref_id, 5, 0.8, symbol FROM rf JOIN sy ON contains(name, '::') AND ends_with(symbol, '::' || name)),
im AS (SELECT rf, name AS i FROM rf WHERE imp), al AS (SELECT simple, count(*) AS k FROM s1 GROUP BY 1),
l AS (SELECT ref_id, symbol, name, simple, k, CASE WHEN EXISTS (SELECT 1 FROM im WHERE im.rf = rf.rf AND (im.i = symbol OR ends_with(im.i, simple))) THEN 0.4 ELSE 0 END + CASE WHEN sf = rf THEN 0.3 ELSE 0 END + CASE WHEN simple = name THEN 0.2 ELSE 0 END + CASE WHEN regexp_replace(sf, '/[^/]*$', '') = regexp_replace(rf, '/[^/]*$', '') THEN 0.1 ELSE 0 END AS sc FROM rf JOIN s1 ON simple = regexp_extract(name, '[^:]*$') JOIN al USING (simple)),
e AS (SELECT * FROM h UNION ALL SELECT ref_id, 6, CASE WHEN k = 1 THEN CASE WHEN simple = name THEN 0.9 ELSE 0.7 END ELSE 0.3 + 0.5 * least(sc, 1.0) END, symbol FROM l)
SELECT ref_id, symbol, CAST(round(c, 9) AS DOUBLE) AS confidence FROM e QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY rule, round(c, 9) DESC, length(symbol), symbol) = 1""",
)
def _(s: Store) -> DataFrame:
    c = s.chunks("parent_symbol", "file_path", "chunk_index").where("parent_symbol IS NOT NULL AND chunk_index IS NOT NULL")
    simple, turn = F.element_at(F.split("parent_symbol", "::"), -1), F.col("chunk_index") % 4
    name = F.when(turn == 0, F.col("parent_symbol")).when(turn == 1, F.concat(F.lit("crate::"), "parent_symbol")).when(turn == 2, simple).otherwise(F.concat(F.lit("other::"), simple))
    refs = c.select(F.col("id").alias("ref_id"), name.alias("name"), "file_path", F.when(F.col("chunk_index") % 8 == 2, "import").otherwise("call").alias("kind")).distinct()
    every = s.chunks("parent_symbol", "file_path").where("parent_symbol IS NOT NULL")
    return L.resolve(refs, every.select(F.col("parent_symbol").alias("symbol"), "file_path"))


@query("q04_merge_small")
def _(s: Store) -> DataFrame:
    c = s.chunks("file_path", "chunk_index", "text").where("text IS NOT NULL AND file_path IS NOT NULL AND chunk_index IS NOT NULL").groupBy("file_path", "chunk_index").agg(F.min("text").alias("text"))
    return L.merge_small(c.withColumn("size", S.non_whitespace("text")), 200, 1500).select("file_path", "first_index", "last_index", "size")


# ---- composed operators ------------------------------------------------------------------------


@query("c03_active_edges", f"SELECT DISTINCT id, relationship FROM edg WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{NOW}') AND (valid_to IS NULL OR valid_to >= TIMESTAMP '{NOW}')")
def _(s: Store) -> DataFrame:
    return J.active_edges(s.edges("relationship", "valid_from", "valid_to"), NOW).select("id", "relationship").distinct()


@query(
    "h07_search_code",
    f"""WITH {_UNIT}, q AS (SELECT * FROM e WHERE memory_id LIKE '%00'),
s AS (SELECT q.memory_id AS query_id, e.memory_id AS id, CASE WHEN q.n * e.n < 1e-12 THEN 0.0 ELSE list_inner_product(CAST(q.v AS DOUBLE[]), CAST(e.v AS DOUBLE[])) / (q.n * e.n) END AS score FROM q JOIN e ON e.d = q.d WHERE e.memory_id <> q.memory_id AND e.memory_id LIKE 'chunk:%')
SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 5""",
)
def _(s: Store) -> DataFrame:
    return J.search_code(s.embeddings(), _probe(s), 5).select("query_id", "id", F.round("score", 6).alias("score"))


@query("h08_hybrid_code")
def _(s: Store) -> DataFrame:
    embed = E.hashed_words(64)  # texts and labels alike: the model of the stored vectors can't be asked here
    rows = [("q1", "shard"), ("q2", "parser"), ("q3", "HistogramFrame"), ("q4", "zzz nothing")]
    asked = s.spark.createDataFrame(rows, "query_id string, query string").withColumn("vector", embed(F.col("query")))
    nodes = s.nodes("label").where(J.is_code("id"))
    vectors = nodes.where("label IS NOT NULL").select(F.col("id").alias("memory_id"), embed(F.col("label")).alias("embedding"))
    return J.hybrid_code(J.search_code(vectors, asked, 5), J.symbol_hits(nodes, asked, 8), 8)


@query("k18_traverse_at", f"WITH RECURSIVE v AS (SELECT src, dst FROM edg WHERE {_VALID.format(BEFORE)}), b AS (SELECT src AS id, 0 AS depth FROM {_HUB} UNION SELECT x.b, depth + 1 FROM b JOIN (SELECT src AS a, dst AS b FROM v UNION SELECT dst, src FROM v) AS x ON x.a = b.id WHERE depth < 2) SELECT id, min(depth) AS depth FROM b WHERE id IN (SELECT id FROM nod WHERE {_VALID.format(BEFORE)}) GROUP BY 1")
def _(s: Store) -> DataFrame:
    return J.traverse_at(s.nodes("valid_from", "valid_to"), s.edges("src", "dst", "valid_from", "valid_to"), _hub(s), 2, BEFORE)


@query("k23_symbol_graph", f"WITH h AS {_HUB} SELECT e.id, e.src, e.dst, relationship, 'out' AS way FROM (SELECT DISTINCT id, src, dst, relationship FROM edg ) AS e JOIN h ON e.src = h.src UNION ALL SELECT e.id, e.src, e.dst, relationship, 'in' FROM (SELECT DISTINCT id, src, dst, relationship FROM edg ) AS e JOIN h ON e.dst = h.src")
def _(s: Store) -> DataFrame:
    return J.symbol_graph(s.edges("src", "dst", "relationship"), _hub(s))


@query("k24_impact_subgraph", f"WITH RECURSIVE b AS (SELECT src AS id, 0 AS depth FROM {_HUB} UNION SELECT x.b, depth + 1 FROM b JOIN (SELECT src AS a, dst AS b FROM edg UNION SELECT dst, src FROM edg ) AS x ON x.a = b.id WHERE depth < 2) SELECT DISTINCT id, src, dst FROM edg WHERE src IN (SELECT id FROM b) AND dst IN (SELECT id FROM b)")
def _(s: Store) -> DataFrame:
    return J.impact_subgraph(s.edges("src", "dst"), _hub(s), 2).select("id", "src", "dst")


@query("k04_shortest_path")
def _(s: Store) -> DataFrame:
    """From the function with most calls to the farthest one that it reaches."""
    e = s.edges("src", "dst", "relationship").where("relationship = 'CALLS'")
    hub = _hub(s).first()
    far = G.bfs(e, _hub(s), 1 << 30, "out").orderBy(F.col("depth").desc(), F.col("id").desc()).first() if hub else None
    return G.shortest_path(e, hub["id"] if hub else "", far["id"] if far else "")


@query("d02_cross_namespace_edges", 'WITH n AS (SELECT DISTINCT id, namespace FROM nod ) SELECT e.id FROM (SELECT DISTINCT id, src, dst FROM edg ) AS e JOIN n AS a ON a.id = e.src JOIN n AS b ON b.id = e.dst WHERE a.namespace IS DISTINCT FROM b.namespace')
def _(s: Store) -> DataFrame:
    return R.namespace_edges(s.nodes("namespace"), s.edges("src", "dst")).where("cross").select("id")


@query("e18_session_count", "SELECT namespace, count(*) AS n FROM ses GROUP BY 1")
def _(s: Store) -> DataFrame:
    return s.sessions("namespace").groupBy("namespace").agg(F.count("*").alias("n"))


@query("e02_last_runs", "SELECT namespace AS cycle_type, started_at AS run_at FROM ses WHERE namespace IS NOT NULL QUALIFY rank() OVER (PARTITION BY namespace ORDER BY started_at DESC) = 1")
def _(s: Store) -> DataFrame:
    log = s.sessions("namespace", "started_at").where("namespace IS NOT NULL").select(F.col("namespace").alias("cycle_type"), F.col("started_at").alias("run_at"))
    return A.last_runs(log)


@query("b05_delete_expired", f"SELECT id FROM mem WHERE NOT (expires_at IS NOT NULL AND expires_at <= TIMESTAMP '{NOW}')")
def _(s: Store) -> DataFrame:
    return s.memories("expires_at").where(S.not_expired(S.ts(NOW))).select("id")


@query("b21_delete_namespace", "WITH gone AS (SELECT id FROM mem WHERE namespace = 'orbit-core') SELECT id FROM mem WHERE id NOT IN (SELECT id FROM gone)")
def _(s: Store) -> DataFrame:
    m = s.memories("namespace")
    return R.delete_cascade(m.where("namespace = 'orbit-core'"), m, s.embeddings(), s.nodes("memory_id"), s.edges("src", "dst"))["memories"].select("id")


@query("b27_backfill_embeddings", "SELECT id AS memory_id, 64 AS dims FROM mem WHERE content IS NOT NULL AND id NOT IN (SELECT memory_id FROM emb WHERE memory_id IS NOT NULL)")
def _(s: Store) -> DataFrame:
    return E.backfill(s.memories("content"), s.embeddings(), E.hashed_words(64), "hashed-64").select("memory_id", F.size("embedding").alias("dims"))


@query("o06_forget", "WITH gone AS (SELECT id FROM mem WHERE importance < 0.1 AND coalesce(access_count, 0) <= 0), dead AS (SELECT n.id FROM nod AS n JOIN gone ON n.memory_id = gone.id UNION SELECT id FROM gone) SELECT DISTINCT id FROM edg WHERE src NOT IN (SELECT id FROM dead) AND dst NOT IN (SELECT id FROM dead)")
def _(s: Store) -> DataFrame:
    return J.forget(s.memories("importance", "access_count"), s.embeddings(), s.nodes("memory_id"), s.edges("src", "dst"))["graph_edges"].select("id")


@query("o08_consolidate")
def _(s: Store) -> DataFrame:
    m = s.memories("content", "importance", "access_count", "last_accessed_at", "memory_type", "namespace", "tags")
    out = J.consolidate(m, s.embeddings(), s.nodes("kind"), s.edges("src", "dst", "relationship"), None, NOW)
    return out["clusters"].select("id", "component").union(out["forgotten"].select("id", F.lit("forgotten")))


@query("p_start_context")
def _(s: Store) -> DataFrame:
    return J.start_context(s.memories("importance", "expires_at", "namespace"), s.sessions(), s.activity(), NOW)


@query("f04_top_per_file")
def _(s: Store) -> DataFrame:
    c = s.chunks("file_path", "text").where("text IS NOT NULL").withColumn("score", F.least(F.lit(1.0), S.non_whitespace("text") / 1000.0))
    return N.per_file_top(c, "file_path", "score", "id", 0.2, 3).select("file_path", "id")


@query("l03_compact_bots")
def _(s: Store) -> DataFrame:
    return T.compact_bots(_commits(s).withColumn("author", F.concat("author", F.lit("-bot"))))


@query("g02_files_between", f"WITH a AS (SELECT id FROM nod WHERE kind = 'file' AND {_VALID.format(BEFORE)}), b AS (SELECT id FROM nod WHERE kind = 'file' AND {_VALID.format(NOW)}) SELECT id, 'added' AS what FROM (SELECT id FROM b EXCEPT SELECT id FROM a) UNION ALL SELECT id, 'removed' FROM (SELECT id FROM a EXCEPT SELECT id FROM b)")
def _(s: Store) -> DataFrame:
    d = T.drift(s.nodes("kind", "valid_from", "valid_to"), s.edges("src", "dst", "valid_from"), BEFORE, NOW)
    return d.where("what IN ('added', 'removed')").select(F.col("subject").alias("id"), "what")


# ---- the star schema: plain SQL over registered views ---------------------------------------


@query("w_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_price, round(avg(l_discount), 9) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def _(s: Store) -> DataFrame:
    li = s.raw("lineitem").where(F.col("l_shipdate") <= S.ts("1998-09-02 00:00:00"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 4).alias("sum_price"), F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count("*").alias("n"))


@query("w_containment_counts", "SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def _(s: Store) -> DataFrame:
    for name in ("region", "nation", "customer", "orders"):
        s.raw(name).createOrReplaceTempView(f"quillon_{name}")
    return s.spark.sql("SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM quillon_region JOIN quillon_nation ON n_regionkey = r_regionkey JOIN quillon_customer ON c_nationkey = n_nationkey LEFT JOIN quillon_orders ON o_custkey = c_custkey GROUP BY 1, 2")


from . import extended  # noqa: E402, F401  (registers its queries)
