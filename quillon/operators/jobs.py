"""Operators composed of others: code search, subgraphs, session start and end, the whole consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S
from . import analytics as A
from . import consolidate as C
from .graph import bfs
from .records import delete_cascade, forgettable, induced_edges
from .vectors import nearest

CODE = ("sym:", "chunk:", "doc:")


def is_code(column: str) -> Column:
    out = F.lit(False)
    for p in CODE:
        out = out | F.startswith(column, F.lit(p))
    return out


def search_code(embeddings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, position): the nearest symbols, chunks and document sections; sections count 5 % more, 1 at most. Filtered before the cut."""
    near = nearest(embeddings.where(is_code("memory_id")), queries, 2 * k, key="memory_id", vector="embedding")
    score = F.when(F.startswith("id", F.lit("doc:")), F.least(F.lit(1.0), F.col("score") * 1.05)).otherwise(F.col("score"))
    ranked = near.select("query_id", "id", F.round(score, 9).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return ranked.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def symbol_hits(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, position): the k symbols whose label or qualified name contains the text of each query (query_id, query), each name once, the shortest first. The queries are a stated, small set."""
    symbols = nodes.where(F.startswith("id", F.lit("sym:"))).select(S.path_of("id").alias("name"), "id", "label").groupBy("name").agg(F.min("id").alias("id"), F.collect_set(F.lower("label")).alias("labels"))
    asked = queries.where("query <> ''").select("query_id", F.lower("query").alias("q")).distinct()
    hit = symbols.join(asked, F.contains(F.lower("name"), F.col("q")) | F.exists("labels", lambda x: F.contains(x, F.col("q"))))
    order = W.partitionBy("query_id").orderBy(F.length("name"), "name")
    return hit.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("query_id", "id", "position")


def hybrid_code(semantic: DataFrame, textual: DataFrame, k: int) -> DataFrame:
    """(query_id, id, position): semantic hits first, then textual ones (both query_id, id, position), each id once."""
    both = semantic.select("query_id", "id", F.lit(0).alias("source"), "position").union(textual.select("query_id", "id", F.lit(1), "position"))
    first = both.groupBy("query_id", "id").agg(F.min(F.struct("source", "position")).alias("m"))
    order = W.partitionBy("query_id").orderBy("m", "id")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).drop("m")


def new_insights(incoming: DataFrame, vectors: DataFrame, existing: DataFrame, above: float = 0.9) -> DataFrame:
    """Insights (id, ...) whose vector (query_id, vector) has no existing one closer than ``above``."""
    near = nearest(existing, vectors, 1, key="memory_id", vector="embedding").where(F.col("score") > above)
    return incoming.join(near.select(F.col("query_id").alias("id")), "id", "left_anti")


def active_edges(edges: DataFrame, when: str | Column) -> DataFrame:
    return edges.where(S.edge_active(S.when_of(when)))


def traverse_at(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, when: str | Column, direction: str = "both") -> DataFrame:
    """(id, depth): bfs over what is valid at a moment."""
    w = S.when_of(when)
    out = bfs(edges.where(S.valid_at(w)), seeds, depth, direction)
    return out.join(nodes.where(S.valid_at(w)).select("id").distinct(), "id", "left_semi")


def symbol_graph(edges: DataFrame, seeds: DataFrame, direction: str = "both") -> DataFrame:
    """(id, src, dst, relationship, way): the edges at the seeds."""
    out = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").withColumn("way", F.lit("out"))
    into = edges.join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi").withColumn("way", F.lit("in"))
    names = ("id", "src", "dst", "relationship", "way")
    both = {"out": out.select(*names), "in": into.select(*names)}
    return both[direction] if direction != "both" else both["out"].union(both["in"])


def impact_subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """The edges among the nodes within ``depth`` steps of the seeds."""
    return induced_edges(edges, bfs(edges, seeds, depth, "both").select("id"))


def forget(memories: DataFrame, embeddings: DataFrame, nodes: DataFrame, edges: DataFrame, importance_below: float = 0.1, most_accesses: int = 0, tags: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The four tables without what can be forgotten."""
    return delete_cascade(forgettable(memories, importance_below, most_accesses, tags).select("id"), memories, embeddings, nodes, edges)


def consolidate(memories: DataFrame, embeddings: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame | None, now: str) -> dict[str, DataFrame]:
    """One whole round: decayed importances, new theme links (of the queries, or of all memories), clusters with their winners, what is forgotten, summaries."""
    from .graph import components
    from .records import update_importance

    kept = update_importance(memories, C.decayed(memories, now))
    themes = C.themes(kept, embeddings, edges, queries)
    clusters = C.clusters(kept, C.near_duplicates(kept, embeddings))
    lost = forgettable(kept).select("id")
    comp = components(nodes.where("kind = 'memory'"), edges.where("relationship = 'SHARES_THEME'"))
    return {"memories": kept.join(lost, "id", "left_anti"), "themes": themes, "clusters": clusters, "forgotten": lost, "summaries": C.summaries(comp, kept)}


def folded_sessions(events: DataFrame) -> DataFrame:
    """(id, namespace, started_at, ended_at, summary) of start and end events (id, what, at, namespace, summary): the first start, the last end."""
    start, end = F.col("what") == "start", F.col("what") == "end"
    return events.groupBy("id").agg(
        F.min_by(F.when(start, F.col("namespace")), F.when(start, F.col("at"))).alias("namespace"),
        F.min(F.when(start, F.col("at"))).alias("started_at"),
        F.max(F.when(end, F.col("at"))).alias("ended_at"),
        F.max_by(F.when(end, F.col("summary")), F.when(end, F.col("at"))).alias("summary"),
    )


def start_context(memories: DataFrame, sessions: DataFrame, activity: DataFrame, now: str | Column, key_importance: float = 0.8) -> DataFrame:
    """(what, subject, n): what a new session is told: last five summaries, key memories of each namespace (five), hotspots of five touches, searches made three times."""
    last = sessions.where("summary IS NOT NULL AND ended_at IS NOT NULL").orderBy(F.col("ended_at").desc(), "id").limit(5).select(F.lit("summary").alias("what"), F.col("id").alias("subject"), F.lit(1).cast("long").alias("n"))
    live = memories.where((F.col("importance") >= key_importance) & S.not_expired(S.when_of(now)) & F.col("namespace").isNotNull())
    # the five best of each slice of a namespace, then of the namespace
    order = [F.col("importance").desc(), F.col("id")]
    part = live.withColumn("r", F.row_number().over(W.partitionBy("namespace", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy(*order))).where("r <= 5")
    best = part.withColumn("r", F.row_number().over(W.partitionBy("namespace").orderBy(*order))).where("r <= 5").select(F.lit("key_memory"), "id", F.col("r").cast("long"))
    hot = A.file_hotspots(activity, 5).select(F.lit("hotspot"), "file_path", "n")
    searched = A.repeated_searches(activity, 3).select(F.lit("search"), "pattern", "n")
    return last.union(best).union(hot).union(searched)


def stop_summary(memories: DataFrame, session: str) -> DataFrame:
    """One row with the insight text of a session: what it read, edited, searched and decided."""
    row = A.categorised(memories.where(F.col("session_id") == session))
    text = F.format_string("Session %s: %d files read, %d edited, %d searches, %d decisions", "session_id", "files_read", "files_edited", "searches", "decisions")
    return row.select("session_id", text.alias("content"), F.array(F.lit("session-summary"), F.lit("pending-analysis")).alias("tags"))


__all__ = ["search_code", "symbol_hits", "hybrid_code", "new_insights", "active_edges", "traverse_at", "symbol_graph", "impact_subgraph", "forget", "consolidate", "folded_sessions", "start_context", "stop_summary"]
