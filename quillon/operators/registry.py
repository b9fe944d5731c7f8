"""Writes that span tables, the registry of files, packages and endpoints, and what dashboards ask for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import text as T
from .enrich import coupling
from .records import insert_new, upsert

# ---- existence, counts ------------------------------------------------------


def exists(keys: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """(key, found) of the distinct keys."""
    known = table.select(key).distinct().withColumn("found", F.lit(True))
    return keys.select(key).distinct().join(known, key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))


def directory_reads(activity: DataFrame) -> DataFrame:
    """(session_id, directory, n): reads of a directory in a session."""
    return activity.where("tool_name = 'Read' AND session_id IS NOT NULL AND directory IS NOT NULL").groupBy("session_id", "directory").agg(F.count("*").alias("n"))


def pattern_searches(activity: DataFrame) -> DataFrame:
    """(session_id, pattern, n): searches for a pattern in a session."""
    own = activity.where(F.col("tool_name").isin("Grep", "Glob") & F.col("session_id").isNotNull() & F.col("pattern").isNotNull())
    return own.groupBy("session_id", "pattern").agg(F.count("*").alias("n"))


def patterns_elsewhere(activity: DataFrame, session: str, least: int = 2) -> DataFrame:
    """(pattern): what other sessions searched for ``least`` times and this session did not."""
    counts = pattern_searches(activity)
    others = counts.where(F.col("session_id") != session).groupBy("pattern").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return others.join(counts.where(F.col("session_id") == session).select("pattern"), "pattern", "left_anti").select("pattern")


# ---- writes -----------------------------------------------------------------


def memory_nodes(memories: DataFrame) -> DataFrame:
    """The graph node of each memory: its id, kind memory, the first 80 characters as label."""
    return memories.select("id", F.lit("memory").alias("kind"), F.left("content", F.lit(80)).alias("label"), F.col("id").alias("memory_id"), "namespace")


def associate(src: str, dst: str, relationship: str, weight: str | None = None) -> list[Column]:
    """The columns of an edge out of columns of a table; its id is src-RELATIONSHIP-dst."""
    rel = F.col(relationship) if relationship.islower() else F.lit(relationship)
    return [S.edge_id(src, rel, dst).alias("id"), F.col(src).alias("src"), F.col(dst).alias("dst"), rel.alias("relationship"), (F.col(weight) if weight else F.lit(1.0)).alias("weight")]


def store_with_links(memories: DataFrame, nodes: DataFrame, edges: DataFrame, incoming: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """memories, graph_nodes and graph_edges with new memories, a node for each and RELATES_TO edges to what they are linked with.

    incoming as memories; links (id, target). Memories that are there already
    (content and namespace) are not stored and get no links; links to what is
    no node are left out.
    """
    fresh = insert_new(memories.select("id", "content", "namespace", "created_at"), incoming.select("id", "content", "namespace", "created_at"))
    new = fresh.select("id", "content", "namespace", "created_at")
    own = memory_nodes(new)
    known = nodes.select(F.col("id").alias("target")).union(own.select("id")).distinct()
    edge = links.join(new.select("id"), "id", "left_semi").join(known, "target", "left_semi").distinct()
    return {
        "memories": memories.select("id", "content", "namespace", "created_at").unionByName(new),
        "graph_nodes": upsert(nodes.select("id", "kind", "label", "memory_id", "namespace"), own),
        "graph_edges": upsert(edges.select("id", "src", "dst", "relationship", "weight"), edge.select(*associate("id", "target", "RELATES_TO"))),
    }


def delete_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges without those between the given ends (src, dst[, relationship])."""
    return edges.join(pairs.distinct(), [c for c in ("src", "dst", "relationship") if c in pairs.columns], "left_anti")


def cleanup_file(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """graph_nodes and graph_edges without what belongs to files (file_path) that are gone: the file, its symbols, its chunks, their edges."""
    path = F.coalesce(S.json_text("payload", "$.file_path"), F.when(F.col("kind") == "file", S.path_of("id")), F.when(F.col("kind") == "chunk", F.regexp_replace(S.path_of("id"), r":\d+$", "")))
    gone = nodes.withColumn("file_path", path).join(files.select("file_path").distinct(), "file_path", "left_semi").select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return {"graph_nodes": nodes.join(gone, "id", "left_anti"), "graph_edges": left.select(*edges.columns)}


def pattern_memories(patterns: DataFrame, namespace: str, now: str | Column) -> DataFrame:
    """A memory of type pattern and importance 0.5 for each pattern (kind, subject, n, confidence); its id is the hash of its content."""
    content = F.concat_ws(" ", F.col("kind"), F.col("subject"), F.concat(F.lit("("), F.col("n").cast("string"), F.lit(" times)")))
    own = patterns.select(content.alias("content"), F.lit("pattern").alias("memory_type"), F.lit(0.5).alias("importance"), "confidence", F.array(F.lit("pattern"), "kind").alias("tags"), F.lit(namespace).alias("namespace"), S.when_of(now).alias("created_at"))
    return own.withColumn("content_hash", S.sha256("content")).withColumn("id", F.left("content_hash", F.lit(32)))


# ---- the registry of files, packages and endpoints ---------------------------


def file_hashes(chunks: DataFrame) -> DataFrame:
    """(namespace, file_path, content_hash): the hash of each file, out of the hashes of its chunks in order, so that no file has to be held whole."""
    part = chunks.where("file_path IS NOT NULL AND text IS NOT NULL").select(F.coalesce("namespace", F.lit("")).alias("namespace"), "file_path", F.struct("chunk_index", F.sha2("text", 256).alias("h")).alias("c"))
    return part.groupBy("namespace", "file_path").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["h"]), ""), 256).alias("content_hash"))


def unresolved(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References (src, dst, ...) whose target is no symbol (id)."""
    return references.join(symbols.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti")


def packages(files: DataFrame) -> DataFrame:
    """(package, namespace, files): the folders that hold files (file_path, namespace), as packages."""
    own = files.select(S.directory_of(F.col("file_path")).alias("package"), "namespace", "file_path").where("package <> ''").distinct()
    return own.groupBy("package", "namespace").agg(F.count("*").alias("files"))


#: How a call is recognised as one of a client of HTTP: start of the name (lower-case), library.
CLIENTS = (("requests.", "requests"), ("httpx.", "httpx"), ("axios.", "axios"), ("fetch", "fetch"), ("http.", "net/http"))
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")


def client_calls(references: DataFrame) -> DataFrame:
    """(ref_id, library, method): calls (ref_id, name, kind) of HTTP clients; the method is that in the last segment of the name, null if none."""
    low = F.lower("name")
    library = F.coalesce(*(F.when((low == p) if not p.endswith(".") else F.startswith(low, F.lit(p)), lib) for p, lib in CLIENTS))
    last = F.element_at(F.split(low, r"\."), -1)
    method = F.coalesce(*(F.when(F.startswith(last, F.lit(v)), v.upper()) for v in VERBS))
    return references.where("kind = 'call'").select("ref_id", library.alias("library"), method.alias("method")).where("library IS NOT NULL")


def declared_endpoints(symbols: DataFrame) -> DataFrame:
    """(symbol, method, path): endpoints by the decorators of symbols (symbol, attributes array): route(), verbs as calls and mappings; ANY if no method is named."""
    from .linking import normal_path

    each = symbols.select("symbol", F.explode("attributes").alias("a")).withColumn("low", F.lower("a"))
    verb = F.coalesce(F.nullif(F.regexp_extract("low", r"(?:\.|^@?)(get|post|put|delete|patch)\(", 1), F.lit("")), F.nullif(F.regexp_extract("low", r"(get|post|put|delete|patch)mapping", 1), F.lit("")), F.nullif(F.regexp_extract("low", r"method\w*\s*=\s*\W*(?:requestmethod\.)?(get|post|put|delete|patch)", 1), F.lit("")))
    known = each.where(F.col("low").rlike(r"route\(|mapping\(|(?:\.|^@?)(?:get|post|put|delete|patch)\(")).withColumn("path", F.regexp_extract("a", r"""["']([^"']*)["']""", 1)).where("path <> ''")
    return known.select("symbol", F.coalesce(F.upper(verb), F.lit("ANY")).alias("method"), normal_path("path").alias("path")).distinct()


# ---- dashboards ---------------------------------------------------------------


def security_insights(nodes: DataFrame) -> DataFrame:
    """One row: nodes flagged sensitive (or to do with authentication), exposed endpoints, security functions; flags are payload.security_flags."""
    flags = F.from_json(S.json_text("payload", "$.security_flags"), "array<string>")
    has = lambda *f: F.count_if(F.coalesce(F.arrays_overlap("f", F.array(*map(F.lit, f))), F.lit(False)))
    own = nodes.select("id", flags.alias("f")).distinct()
    return own.agg(has("sensitive", "auth_related").alias("sensitive"), has("exposed_endpoint").alias("endpoints"), has("security_function").alias("functions"))


def performance_insights(edges: DataFrame, layers: DataFrame, ranks: DataFrame, nodes: DataFrame, above: int = 15, top: int = 10) -> DataFrame:
    """(what, id, n): the ``top`` most coupled nodes, the number of layers, the ``top`` files by rank."""
    busy = coupling(edges, above).orderBy(F.col("degree").desc(), "id").limit(top).select(F.lit("coupling").alias("what"), "id", F.col("degree").cast("double").alias("n"))
    depth = layers.agg(F.coalesce(F.max("layer") + 1, F.lit(0)).cast("double").alias("n")).select(F.lit("layers"), F.lit(""), "n")
    files = nodes.where("kind = 'file'").select("id").distinct()
    path = ranks.join(files, "id", "left_semi").where("rank > 0").orderBy(F.round("rank", 12).desc(), "id").limit(top).select(F.lit("rank"), "id", F.col("rank"))
    return busy.union(depth).union(path)


def session_checkpoint(memories: DataFrame, activity: DataFrame, session: str) -> DataFrame:
    """(what, subject, n) of a session so far: its summary, its hot directories, its searches (2 and more) and hotspots (3 and more), its insights."""
    from . import analytics as A

    own = activity.where(F.col("session_id") == session)
    summary = A.session_summary(own).select(F.posexplode(F.create_map(*(x for c in ("files_read", "files_edited", "searches", "actions") for x in (F.lit(c), F.col(c).cast("long"))))).alias("i", "subject", "n")).select(F.lit("summary").alias("what"), "subject", "n")
    dirs = A.hot_directories(own, 5).select(F.lit("directory"), "directory", "n")
    found = A.repeated_searches(own, 2).select(F.lit("search"), "pattern", "n").union(A.file_hotspots(own, 3).select(F.lit("hotspot"), "file_path", "n"))
    insights = memories.where((F.col("session_id") == session) & (S.memory_type() == "insight")).select(F.lit("insight"), "id", F.lit(1).cast("long"))
    return summary.union(dirs).union(found).union(insights)


#: Analyses by name: a function from the tables (a dict) to a DataFrame.
Analysis = Callable[[dict[str, DataFrame]], DataFrame]


def run_enrichments(tables: dict[str, DataFrame], analyses: dict[str, Analysis], only: Sequence[str] = ()) -> DataFrame:
    """(analysis, n): the rows that each analysis finds; all of them or those named."""
    out = None
    for name, run in analyses.items():
        if only and name not in only:
            continue
        one = run(tables).agg(F.count("*").alias("n")).select(F.lit(name).alias("analysis"), "n")
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("no analysis of that name")
    return out


def score_texts(texts: DataFrame, queries: DataFrame, docs: DataFrame, key: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score): BM25 of texts that are not in the collection, by the collection's frequencies."""
    terms = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))
    base = T.postings(docs, key, text).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    stats = F.broadcast(T.collection(docs, key, text))  # one row
    weights = terms.join(base, "term", "left").crossJoin(stats).select("query_id", "term", "avgdl", T.idf(F.col("n"), F.coalesce("df", F.lit(0))).alias("idf"))
    most = weights.groupBy("query_id").agg(F.sum(F.col("idf") * T.saturation(F.lit(10.0), F.col("avgdl"), F.col("avgdl"), k1, b)).alias("most"))
    raw = T.postings(texts, key, text).join(weights, "term").groupBy("query_id", key).agg(F.sum(F.col("idf") * T.saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("raw"))
    return raw.join(most, "query_id").select("query_id", key, F.when(F.col("most") > 0, F.least(F.lit(1.0), F.col("raw") / F.col("most"))).otherwise(0.0).alias("score"))
