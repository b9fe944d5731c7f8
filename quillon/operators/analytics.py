"""Counts, groupings and patterns over memories, sessions and their activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S

SEARCH, EDIT, READ = ("Grep", "Glob"), ("Edit", "Write"), ("Read",)


def totals(memories: DataFrame, nodes: DataFrame, edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(what, n): the rows of the four stores."""
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return one(memories, "memories").union(one(embeddings, "embeddings")).union(one(nodes, "nodes")).union(one(edges, "edges"))


def grouped_activity(activity: DataFrame, tools: tuple[str, ...], by: str, least: int) -> DataFrame:
    """(by, n, sessions, tools) of what the tools were used on at least ``least`` times."""
    used = activity.where(F.col("tool_name").isin(*tools) & F.col(by).isNotNull())
    return used.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.array_join(F.array_sort(F.collect_set("tool_name")), ",").alias("tools")).where(F.col("n") >= least)


def repeated_searches(activity: DataFrame, least: int = 3) -> DataFrame:
    return grouped_activity(activity, SEARCH, "pattern", least)


def file_hotspots(activity: DataFrame, least: int = 5) -> DataFrame:
    return grouped_activity(activity, (*READ, *EDIT), "file_path", least)


def edit_chains(activity: DataFrame, least: int = 2) -> DataFrame:
    """Files changed again and again."""
    return grouped_activity(activity, EDIT, "file_path", least)


def tool_usage(activity: DataFrame) -> DataFrame:
    """(tool_name, n, share) over all uses of a named tool; a tool has a share only if there are two at least."""
    n = activity.where("tool_name IS NOT NULL").groupBy("tool_name").agg(F.count("*").alias("n"))
    every = W.partitionBy()  # one row a tool
    return n.withColumn("share", F.when(F.count("*").over(every) >= 2, F.col("n") / F.sum("n").over(every)))


def session_summary(activity: DataFrame) -> DataFrame:
    """A row a session: distinct files read and edited, searches, actions; 0 where there is nothing."""
    tool = F.col("tool_name")
    return activity.where("session_id IS NOT NULL").groupBy("session_id").agg(
        F.countDistinct(F.when(tool.isin(*READ), F.col("file_path"))).alias("files_read"),
        F.countDistinct(F.when(tool.isin(*EDIT), F.col("file_path"))).alias("files_edited"),
        F.coalesce(F.sum(F.when(tool.isin(*SEARCH), 1).otherwise(0)), F.lit(0)).alias("searches"),
        F.count("*").alias("actions"),
    )


def hot_directories(activity: DataFrame, most: int = 5) -> DataFrame:
    """(session_id, directory, n): the busiest directories of each session; counted before they are ranked."""
    n = activity.where("session_id IS NOT NULL AND directory IS NOT NULL").groupBy("session_id", "directory").agg(F.count("*").alias("n"))
    order = W.partitionBy("session_id").orderBy(F.col("n").desc(), "directory")
    return n.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def namespace_stats(memories: DataFrame) -> DataFrame:
    """A row a namespace: number, means of importance and confidence, first and last creation, number of kinds."""
    return memories.where("namespace IS NOT NULL").groupBy("namespace").agg(
        F.count("*").alias("n"),
        F.round(F.avg("importance"), 9).alias("avg_importance"),
        F.round(F.avg("confidence"), 9).alias("avg_confidence"),
        F.countDistinct(S.memory_type()).alias("kinds"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )


def tag_counts(memories: DataFrame) -> DataFrame:
    """(namespace, tag, n): memories that carry the tag (trimmed, lower-case)."""
    tags = F.array_distinct(F.transform("tags", lambda t: F.lower(F.trim(t))))
    each = memories.select("namespace", F.explode(tags).alias("tag")).where("tag <> ''")
    return each.groupBy("namespace", "tag").agg(F.count("*").alias("n"))


def timeline(memories: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """(day, kind, n), days inclusive at both ends."""
    day = F.date_format("created_at", "yyyy-MM-dd")
    out = memories.select(day.alias("day"), S.memory_type().alias("kind"))
    out = out.where(F.col("day") >= first) if first else out
    out = out.where(F.col("day") <= last) if last else out
    return out.groupBy("day", "kind").agg(F.count("*").alias("n"))


def importance_histogram(memories: DataFrame) -> DataFrame:
    """(bucket 0-9, n); the last bucket holds 1.0 and more."""
    bucket = S.clamp(F.floor(F.col("importance") * 10), 0, 9).cast("int")
    return memories.where("importance IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes by kind and edges by relationship."""
    n = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    return n.union(edges.groupBy("relationship").agg(F.count("*").alias("n")).select(F.lit("edge"), "relationship", "n"))


def latency_percentiles(samples: DataFrame, name: str, value: str) -> DataFrame:
    """name, n, total, least, most, p50, p95, p99 by nearest rank round(q (n - 1)).

    Values are counted before they are ranked, so a name with most of all rows
    is ranked over its distinct values.
    """
    ties = samples.where(F.col(name).isNotNull() & F.col(value).isNotNull()).groupBy(name, value).agg(F.count("*").alias("c"))
    upto = W.partitionBy(name).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    run = ties.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(W.partitionBy(name)))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("n") - 1) + 0.5), F.col(value)))
    return run.groupBy(name).agg(F.max("n").alias("n"), F.sum(F.col("c") * F.col(value)).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def sessions_with_counts(sessions: DataFrame, memories: DataFrame) -> DataFrame:
    """Sessions with the number of their memories as counted, not as stored."""
    n = memories.where("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("counted"))
    return sessions.join(n, sessions["id"] == n["session_id"], "left").select("id", "namespace", "started_at", "ended_at", F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("memory_count", F.lit(0)).alias("stored"))


def last_runs(log: DataFrame) -> DataFrame:
    """The latest runs of each cycle (cycle_type, run_at, affected_count); runs at the same time stay."""
    order = W.partitionBy("cycle_type").orderBy(F.col("run_at").desc())
    return log.withColumn("r", F.rank().over(order)).where("r = 1").drop("r")


def cycle_status(log: DataFrame) -> DataFrame:
    """A row for each of the five cycles, run or not."""
    cycles = log.sparkSession.createDataFrame([(c,) for c in ("decay", "creative", "cluster", "forget", "summarize")], "cycle_type string")
    last = last_runs(log).groupBy("cycle_type").agg(F.max("run_at").alias("run_at"), F.max("affected_count").alias("affected_count"))
    return cycles.join(last, "cycle_type", "left").select("cycle_type", "run_at", F.coalesce("affected_count", F.lit(0)).alias("affected_count"))


def patterns(activity: DataFrame, least_searches: int = 2, least_touches: int = 3) -> DataFrame:
    """(kind, subject, n, confidence): repeated searches, hotspots, edit chains and tool preferences.

    Confidence of the first three is ln n over ln sessions, at most 1; of a
    tool its share of all uses.
    """
    sessions = activity.agg(F.countDistinct("session_id").alias("s"))  # one row
    kinds = [("repeated_search", repeated_searches(activity, least_searches), "pattern"), ("file_hotspot", file_hotspots(activity, least_touches), "file_path"), ("decision_chain", edit_chains(activity, least_touches), "file_path")]
    found = None
    for kind, df, by in kinds:
        part = df.select(F.lit(kind).alias("kind"), F.col(by).alias("subject"), "n")
        found = part if found is None else found.union(part)
    sure = found.crossJoin(F.broadcast(sessions)).select("kind", "subject", "n", S.log_confidence(F.col("n"), F.col("s")).alias("confidence"))
    tools = tool_usage(activity).where("share IS NOT NULL").select(F.lit("tool_preference").alias("kind"), F.col("tool_name").alias("subject"), "n", F.col("share").alias("confidence"))
    return sure.unionByName(tools)


def pattern_report(found: DataFrame, most: int = 10) -> str:
    """Markdown, the top patterns of each kind."""
    top = found.withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy(F.col("n").desc(), "subject"))).where(F.col("r") <= most)
    lines: list[str] = []
    last = None
    for row in top.orderBy("kind", "r").collect():  # most rows for each of four kinds
        if row["kind"] != last:
            lines += ["", f"## {row['kind'].replace('_', ' ').title()}"]
            last = row["kind"]
        lines.append(f"- {row['subject']}: {row['n']} (confidence {row['confidence']:.2f})")
    return "\n".join(["# Patterns", *lines]) + "\n"


def session_context(memories: DataFrame, sessions: DataFrame, now: str | Column, hours: int = 24) -> DataFrame:
    """(what, id, text, at): memories of the last hours, those waiting for analysis, and the last summary of each namespace."""
    end = S.when_of(now)
    since = F.timestamp_add("HOUR", F.lit(-hours), end)
    recent = memories.where((F.col("created_at") > since) & (F.col("created_at") <= end)).select(F.lit("recent").alias("what"), "id", F.col("content").alias("text"), F.col("created_at").alias("at"))
    pending = memories.where(F.array_contains("tags", "pending-analysis") & S.not_expired(end)).select(F.lit("pending"), "id", "content", "created_at")
    last = sessions.where("summary IS NOT NULL AND ended_at IS NOT NULL").groupBy("namespace").agg(F.max(F.struct("ended_at", "id", "summary")).alias("m")).select(F.lit("summary"), F.col("m.id"), F.col("m.summary"), F.col("m.ended_at"))
    return recent.union(pending).union(last)


def categorised(memories: DataFrame) -> DataFrame:
    """A row a session: distinct files read and edited (from tags and metadata), searches and decisions of its memories."""
    tool, path = S.json_text("metadata", "$.tool"), S.json_text("metadata", "$.file_path")
    return memories.where("session_id IS NOT NULL").groupBy("session_id").agg(
        F.countDistinct(F.when(tool == "Read", path)).alias("files_read"),
        F.countDistinct(F.when(tool.isin(*EDIT), path)).alias("files_edited"),
        F.count(F.when(tool.isin(*SEARCH), 1)).alias("searches"),
        F.count(F.when(S.memory_type() == "decision", 1)).alias("decisions"),
        F.count("*").alias("memories"),
    )


def cubed(activity: DataFrame) -> DataFrame:
    """Uses by tool, by directory, by both and in all (grouping sets)."""
    known = activity.select(F.coalesce("tool_name", F.lit("-")).alias("tool"), F.coalesce("directory", F.lit("-")).alias("directory"))
    return known.cube("tool", "directory").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def gap_sessions(activity: DataFrame, minutes: int = 30) -> DataFrame:
    """(session_id, bursts): stretches of activity without a pause of more than ``minutes``.

    Pauses inside a day are found in windows of that day, those between days
    from the days' ends, so a session that holds most rows is many windows.
    """
    own = activity.where("session_id IS NOT NULL AND created_at IS NOT NULL").select("session_id", F.to_date("created_at").alias("day"), "created_at")
    long = lambda a, b: F.when(F.timestamp_diff("SECOND", a, b) > minutes * 60, 1).otherwise(0)
    within = W.partitionBy("session_id", "day").orderBy("created_at")
    inside = own.withColumn("cut", F.coalesce(long(F.lag("created_at").over(within), F.col("created_at")), F.lit(0)))
    days = inside.groupBy("session_id", "day").agg(F.sum("cut").alias("cuts"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    between = W.partitionBy("session_id").orderBy("day")
    before = F.lag("last").over(between)
    joined = days.withColumn("cut", F.when(before.isNull(), 1).otherwise(long(before, F.col("first"))))
    return joined.groupBy("session_id").agg(F.sum(F.col("cut") + F.col("cuts")).alias("bursts"))
