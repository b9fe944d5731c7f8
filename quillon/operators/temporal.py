"""The graph as of a moment, its changes, and commits as part of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Authors and files by which a commit counts as made by a machine.
BOT_AUTHOR = r"\[bot\]|-bot$|bot\)$|^renovate$|^github-actions$"
LOCK_FILE = r"\.lock$|lock\.json$|lock\.yaml$|^CHANGELOG\.md$|^go\.sum$"


def graph_at(nodes: DataFrame, edges: DataFrame, when: str | Column) -> DataFrame:
    """(what, kind, n): nodes and edges that are valid at the moment."""
    w = S.when_of(when)
    n = nodes.where(S.valid_at(w)).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    return n.union(edges.where(S.valid_at(w)).groupBy("relationship").agg(F.count("*").alias("n")).select(F.lit("edge"), "relationship", "n"))


def is_bot() -> Column:
    """Over author and files: by name, or all files are lock files."""
    return F.col("author").rlike(BOT_AUTHOR) | ((F.size("files") > 0) & F.forall("files", lambda f: f.rlike(LOCK_FILE)))


def pull_request(subject: str = "subject") -> Column:
    """The number in the last "(#n)" or in "Merge pull request #n"; null if none."""
    squash = F.regexp_extract(subject, r"^(?:.*)\(#(\d+)\)", 1)
    merge = F.regexp_extract(subject, r"^Merge pull request #(\d+)", 1)
    return F.when(squash != "", squash).when(merge != "", merge)


def compact_bots(commits: DataFrame) -> DataFrame:
    """(author, file, hash, n): bot commits grouped by author and first file, the latest standing for them."""
    bots = commits.where(is_bot()).withColumn("file", F.when(F.size("files") > 0, F.col("files")[0]).otherwise(""))
    return bots.groupBy("author", "file").agg(F.max_by("hash", F.struct("date", "hash")).alias("hash"), F.count("*").alias("n"))


def pull_requests(commits: DataFrame) -> DataFrame:
    """(pr, hash, date): the first commit of each pull request."""
    own = commits.withColumn("pr", pull_request()).where("pr IS NOT NULL")
    return own.groupBy("pr").agg(F.min(F.struct("date", "hash")).alias("m")).select("pr", F.col("m.hash").alias("hash"), F.col("m.date").alias("date"))


def ingest_commits(commits: DataFrame, after: str | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Commits as nodes and MODIFIED_BY edges from their files; only those after the high-water mark if one is given."""
    own = commits.where(F.col("date") > S.when_of(after)) if after is not None else commits
    people = own.where(~F.coalesce(is_bot(), F.lit(False)))
    node = people.select(F.concat(F.lit("commit:"), F.col("hash")).alias("id"), F.lit("commit").alias("kind"), F.col("subject").alias("label"), F.col("date").alias("valid_from"))
    each = people.select("hash", "date", F.explode("files").alias("file")).distinct()
    edge = each.select(F.concat(F.lit("file:"), F.col("file")).alias("src"), F.concat(F.lit("commit:"), F.col("hash")).alias("dst"), F.lit("MODIFIED_BY").alias("relationship"), F.lit(0.4).alias("weight"), F.col("date").alias("valid_from"))
    return node, edge.withColumn("id", S.edge_id("src", F.col("relationship"), "dst"))


def expire_deleted(nodes: DataFrame, deletions: DataFrame) -> DataFrame:
    """Nodes with valid_to set to the last deletion (file_path, date) of the file they are of or in."""
    gone = deletions.groupBy(F.col("file_path").alias("_p")).agg(F.max("date").alias("_d"))
    path = F.coalesce(S.json_text("payload", "$.file_path"), F.when(F.startswith("id", F.lit("file:")), S.path_of("id")))
    return nodes.withColumn("_p", path).join(gone, "_p", "left").withColumn("valid_to", F.coalesce("_d", "valid_to")).drop("_p", "_d").select(*nodes.columns)


def what_changed(edges: DataFrame, first: str | Column, last: str | Column) -> DataFrame:
    """(relationship, day, added, ended): edges that began or ended in [first, last], by day."""
    a, b = S.when_of(first), S.when_of(last)
    began = edges.where((F.col("valid_from") >= a) & (F.col("valid_from") <= b)).select("relationship", F.date_format("valid_from", "yyyy-MM-dd").alias("day"), F.lit(1).alias("p"), F.lit(0).alias("q"))
    ended = edges.where((F.col("valid_to") >= a) & (F.col("valid_to") <= b)).select("relationship", F.date_format("valid_to", "yyyy-MM-dd").alias("day"), F.lit(0).alias("p"), F.lit(1).alias("q"))
    return began.union(ended).groupBy("relationship", "day").agg(F.sum("p").alias("added"), F.sum("q").alias("ended"))


def commits_between(nodes: DataFrame, edges: DataFrame, first: str | Column, last: str | Column) -> DataFrame:
    """(id, at, files): commits of a period with the sorted files they modified."""
    a, b = S.when_of(first), S.when_of(last)
    own = nodes.where((F.col("kind") == "commit") & (F.col("valid_from") >= a) & (F.col("valid_from") <= b)).select("id", F.col("valid_from").alias("at"))
    files = edges.where("relationship = 'MODIFIED_BY'").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set(S.path_of("src"))).alias("files"))
    return own.join(files, "id", "left")


def stale_files(nodes: DataFrame, edges: DataFrame, now: str | Column, days: int = 90) -> DataFrame:
    """(id, last_at, centrality, incoming): files not deleted, last MODIFIED_BY a commit more than ``days`` (3650 at most) ago, that still matter (central or referred to).

    Files without any MODIFIED_BY edge are not known to be stale.
    """
    limit = F.timestamp_add("DAY", F.lit(-min(days, 3650)), S.when_of(now))
    files = nodes.where((F.col("kind") == "file") & F.col("valid_to").isNull()).groupBy("id").agg(F.max("centrality").alias("centrality"))
    touched = edges.where((F.col("relationship") == "MODIFIED_BY") & F.startswith("src", F.lit("file:"))).groupBy(F.col("src").alias("id")).agg(F.max("valid_from").alias("last_at"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("incoming"))
    joined = files.join(touched.where(F.col("last_at") < limit), "id").join(into, "id", "left").withColumn("incoming", F.coalesce("incoming", F.lit(0)))
    return joined.where((F.coalesce("centrality", F.lit(0.0)) > 0) | (F.col("incoming") > 0)).select("id", "last_at", "centrality", "incoming")


def drift(nodes: DataFrame, edges: DataFrame, first: str | Column, last: str | Column, top: int = 10) -> DataFrame:
    """(what, subject, n) between two moments: files added and removed, new edges between modules, the busiest ends and pairs of modules."""
    a, b = S.when_of(first), S.when_of(last)
    files = nodes.where("kind = 'file'")
    at = lambda w: files.where(S.valid_at(w)).select("id").distinct()
    added = at(b).join(at(a), "id", "left_anti").select(F.lit("added").alias("what"), F.col("id").alias("subject"), F.lit(1).cast("long").alias("n"))
    removed = at(a).join(at(b), "id", "left_anti").select(F.lit("removed"), "id", F.lit(1).cast("long"))
    new = edges.where((F.col("valid_from") > a) & (F.col("valid_from") <= b))
    module = lambda c: S.directory_of(F.regexp_replace(S.path_of(c), ":\\d+$", ""))
    pairs = new.where(F.startswith("src", F.lit("file:")) & F.startswith("dst", F.lit("file:"))).select(module("src").alias("p"), module("dst").alias("q")).where("p <> q").groupBy("p", "q").agg(F.count("*").alias("n"))
    cross = pairs.select(F.lit("coupling"), F.concat_ws(" -> ", "p", "q"), "n").orderBy(F.col("n").desc(), F.col("p"), F.col("q")).limit(top)
    hot = new.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "src").limit(top).select(F.lit("hotspot"), "src", "n")
    return added.union(removed).union(cross).union(hot)


def symbol_history(edges: DataFrame, node: str) -> DataFrame:
    """(edge_id, other, relationship, at): what happened at a node, newest first."""
    ends = edges.where((F.col("src") == node) | (F.col("dst") == node))
    other = F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src"))
    return ends.select(F.col("id").alias("edge_id"), other.alias("other"), "relationship", F.coalesce("valid_from", "created_at").alias("at")).orderBy(F.col("at").desc(), "edge_id")
