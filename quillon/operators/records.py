"""Scans, filters, upserts and set operations over records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S

# ---- reading ---------------------------------------------------------------


def by_ids(df: DataFrame, ids: Sequence[str], key: str = "id") -> DataFrame:
    """The rows of the given keys (a predicate that reaches the scan)."""
    return df.where(F.col(key).isin(*ids))


def by_keys(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is in a table of keys, of any size."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def newest(df: DataFrame, limit: int | None = None, at: str = "created_at", key: str = "id") -> DataFrame:
    """Newest first, ties by key; all rows unless a limit is given."""
    out = df.orderBy(F.col(at).desc(), key)
    return out.limit(limit) if limit is not None else out


def listing(memories: DataFrame, now: str | Column, namespace: str | None = None, memory_type: str | None = None) -> DataFrame:
    """Memories that are not expired, of a namespace and a type if given."""
    out = memories.where(S.not_expired(S.when_of(now)))
    if namespace is not None:
        out = out.where(F.col("namespace") == namespace)
    return out.where(S.memory_type() == memory_type.lower()) if memory_type is not None else out


def touched(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """Memories with an access log (id, accessed_at) folded in: access_count grows by the accesses, last_accessed_at is the latest."""
    log = accesses.groupBy("id").agg(F.count("*").alias("_n"), F.max("accessed_at").alias("_at"))
    return (
        memories.join(log, "id", "left")
        .withColumn("access_count", (F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int"))
        .withColumn("last_accessed_at", F.greatest("last_accessed_at", "_at"))
        .drop("_n", "_at")
    )


def quality(memories: DataFrame, now: str | Column, exclude_tags: Sequence[str] = (), min_importance: float | None = None, min_confidence: float | None = None, git_ref: str | None = None) -> DataFrame:
    """What recall may return: not expired, without excluded tags, important and sure enough, of the git ref (or of none)."""
    out = memories.where(S.not_expired(S.when_of(now)))
    if exclude_tags:
        out = out.where(~F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, exclude_tags))), F.lit(False)))
    if min_importance is not None:
        out = out.where(F.col("importance") >= min_importance)
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    return out.where(F.col("git_ref") == git_ref) if git_ref is not None else out


def with_tag(memories: DataFrame, tag: str, now: str | Column) -> DataFrame:
    """Memories that carry the tag and are not expired; each once, however often it repeats the tag."""
    return memories.where(F.array_contains("tags", tag) & S.not_expired(S.when_of(now)))


def tag_siblings(memories: DataFrame, most: int = 50) -> DataFrame:
    """(id, tag, sibling): for each tag of a memory the newest others with that tag in the same namespace (null being one), ``most`` a tag.

    Only the newest most + 1 of a tag and namespace can be siblings, so a tag
    on a third of all memories costs no pairs beyond the result. These are
    found in slices by hash, then among the slices' best.
    """
    each = memories.select("id", "created_at", F.coalesce("namespace", F.lit("\0")).alias("ns"), F.explode(F.array_distinct("tags")).alias("tag"))
    order = [F.col("created_at").desc(), F.col("id")]
    sliced = W.partitionBy("ns", "tag", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy(*order)
    part = each.withColumn("r", F.row_number().over(sliced)).where(F.col("r") <= most + 1)
    top = part.withColumn("r", F.row_number().over(W.partitionBy("ns", "tag").orderBy(*order))).where(F.col("r") <= most + 1)
    pairs = each.select("id", "ns", "tag").join(top.select("ns", "tag", F.col("id").alias("sibling"), "r"), ["ns", "tag"]).where("id <> sibling")
    own = top.select(F.col("id"), "ns", "tag", F.col("r").alias("own"))
    ranked = pairs.join(own, ["id", "ns", "tag"], "left").where((F.col("r") <= most) | (F.col("own") <= most))
    return ranked.select("id", "tag", "sibling")


def label_search(nodes: DataFrame, text: str, namespace: str | None = None) -> DataFrame:
    """Nodes whose label contains the text, whatever the letter case, most central first. ``%`` and ``_`` are ordinary characters."""
    out = nodes.where(F.contains(F.lower("label"), F.lower(F.lit(text))))
    out = out.where(F.col("namespace") == namespace) if namespace is not None else out
    return out.orderBy(F.col("centrality").desc_nulls_last(), "id")


def symbol_search(nodes: DataFrame, text: str, kinds: Sequence[str] = ("function", "method"), limit: int = 20) -> DataFrame:
    """Symbols by substring of the label or of the qualified name, each qualified name once; the shortest first."""
    name = S.path_of("id")
    hit = F.contains(F.lower("label"), F.lit(text.lower())) | F.contains(F.lower(name), F.lit(text.lower()))
    return nodes.where(F.col("kind").isin(*kinds) & hit).select("id", name.alias("name"), "kind", "label").dropDuplicates(["name"]).orderBy(F.length("name"), "name").limit(limit)


def browse(nodes: DataFrame, edges: DataFrame, namespace: str | None = None, kind: str | None = None, offset: int = 0, limit: int = 200) -> DataFrame:
    """A page of nodes by centrality with their degree. The page is the feature: ``limit`` is at most 200."""
    out = nodes
    if namespace is not None:
        out = out.where(F.col("namespace") == namespace)
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    page = out.orderBy(F.col("centrality").desc_nulls_last(), "id").offset(offset).limit(min(limit, 200))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return page.join(ends, "id", "left").select("id", "kind", "label", "centrality", F.coalesce("degree", F.lit(0)).alias("degree"))


def forgettable(memories: DataFrame, importance_below: float = 0.1, most_accesses: int = 0, tags: Sequence[str] = ()) -> DataFrame:
    """Memories of little importance that were (hardly) used; with tags, only those that carry one."""
    out = memories.where((F.col("importance") < importance_below) & (F.coalesce("access_count", F.lit(0)) <= most_accesses))
    return out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else out


def stale(memories: DataFrame, before: str | Column) -> DataFrame:
    return memories.where(F.col("last_accessed_at") < S.when_of(before))


# ---- changing --------------------------------------------------------------


def insert_new(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming memories that are new: no equal (content hash, namespace), nor an earlier such row among them. Null namespaces are equal."""
    keyed = lambda df: df.withColumn("content_hash", S.sha256("content")).withColumn("_ns", F.coalesce("namespace", F.lit("")))
    first = F.min_by(F.struct(*incoming.columns), F.struct("created_at", "id")).alias("_row")
    once = keyed(incoming).groupBy("content_hash", "_ns").agg(first)
    fresh = once.join(keyed(existing).select("content_hash", "_ns").distinct(), ["content_hash", "_ns"], "left_anti")
    return fresh.select("_row.*").withColumn("content_hash", S.sha256("content"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows replace existing ones of the same key; within the incoming ones the greatest row counts."""
    new = incoming.groupBy(key).agg(F.max(F.struct(*[c for c in existing.columns if c != key])).alias("_row")).select(key, "_row.*").select(*existing.columns)
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def update_memories(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (id, content, updated_at[, importance]); content, its hash, the time and the importance where given."""
    c = changes.select("id", F.col("content").alias("_c"), F.col("updated_at").alias("_u"), (F.col("importance") if "importance" in changes.columns else F.lit(None).cast("double")).alias("_i"))
    joined = memories.join(c, "id", "left")
    hit = F.col("_u").isNotNull()
    return (
        joined.withColumn("content", F.when(hit, F.col("_c")).otherwise(F.col("content")))
        .withColumn("content_hash", F.when(hit, F.sha2("_c", 256)).otherwise(F.col("content_hash")))
        .withColumn("updated_at", F.when(hit, F.col("_u")).otherwise(F.col("updated_at")))
        .withColumn("importance", F.coalesce("_i", "importance"))
        .drop("_c", "_u", "_i")
    )


def update_importance(memories: DataFrame, values: DataFrame) -> DataFrame:
    """values (id, importance)."""
    v = values.groupBy("id").agg(F.max("importance").alias("_v"))
    return memories.join(v, "id", "left").withColumn("importance", F.coalesce("_v", "importance")).drop("_v")


def delete_cascade(ids: DataFrame, memories: DataFrame, embeddings: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the memories of the given ids, their vectors, nodes and edges."""
    gone = ids.select("id").distinct()
    dead = nodes.join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_semi").select("id").unionByName(gone).distinct()
    keep = edges.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return {
        "memories": memories.join(gone, "id", "left_anti"),
        "memory_embeddings": embeddings.join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti"),
        "graph_nodes": nodes.join(dead, "id", "left_anti"),
        "graph_edges": keep.select(*edges.columns),
    }


def delete_prefix(nodes: DataFrame, prefix: str) -> DataFrame:
    """Nodes without those whose id begins with the prefix, taken literally."""
    return nodes.where(~F.startswith("id", F.lit(prefix)))


def expire_for_file(memories: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, now: str | Column) -> DataFrame:
    """Static-analysis memories of a file get expires_at = now: those whose node names it or whose RELATES_TO edge leads to it."""
    named = nodes.where(S.json_text("payload", "$.file_path") == path).where(F.col("memory_id").isNotNull()).select(F.col("memory_id").alias("id"))
    ends = edges.where((F.col("relationship") == "RELATES_TO") & ((F.col("dst") == f"file:{path}") | (F.col("src") == f"file:{path}")))
    linked = ends.select(F.explode(F.array("src", "dst")).alias("id"))
    hit = named.unionByName(linked).distinct().withColumn("_hit", F.lit(True))
    mark = F.col("_hit") & F.array_contains("tags", "static-analysis")
    return memories.join(hit, "id", "left").withColumn("expires_at", F.when(mark, S.when_of(now)).otherwise(F.col("expires_at"))).drop("_hit")


def unembedded(memories: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Memories without a vector."""
    return memories.join(embeddings.select(F.col("memory_id").alias("id")), "id", "left_anti")


def hash_duplicates(memories: DataFrame, prefix: int = 16) -> DataFrame:
    """(id, first_id, copies): memories whose content hash begins alike in one namespace, each with the smallest id of its group.

    One row a memory rather than one a pair, so a hash that a third of all rows
    share stays linear.
    """
    key = F.left(F.lower("content_hash"), F.lit(prefix))
    own = memories.where(F.col("content_hash").isNotNull()).select("id", key.alias("h"), F.coalesce("namespace", F.lit("")).alias("ns"))
    groups = own.groupBy("h", "ns").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return own.join(groups, ["h", "ns"]).select("id", "first_id", "copies")


def latest_per_hash(memories: DataFrame) -> DataFrame:
    """One memory for each content hash: the latest by updated_at, created_at, id."""
    row = F.max(F.struct("updated_at", "created_at", "id")).alias("m")
    return memories.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(row).select("content_hash", F.col("m.id").alias("id"))


def changed_hashes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_path, change): added, modified or removed against the stored hashes (file_path, content_hash)."""
    j = current.select("file_path", F.col("content_hash").alias("new")).join(stored.select("file_path", F.col("content_hash").alias("old")), "file_path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return j.select("file_path", change.alias("change")).where("change IS NOT NULL")


# ---- sets ------------------------------------------------------------------


def namespaces(memories: DataFrame, nodes: DataFrame) -> DataFrame:
    return memories.select("namespace").union(nodes.select("namespace")).where("namespace IS NOT NULL").distinct()


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id").distinct()
    no_src = edges.select("id", "src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    no_dst = edges.select("id", "src", "dst").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return no_src.select("id", "src", "dst").union(no_dst.select("id", "src", "dst")).distinct()


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    one = ids.select("id").distinct()
    return edges.join(one.withColumnRenamed("id", "src"), "src", "left_semi").join(one.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def namespace_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, src_ns, dst_ns, cross): each edge between two nodes with their namespaces."""
    one = nodes.select("id", "namespace").distinct()
    src, dst = one.select(F.col("id").alias("src"), F.col("namespace").alias("src_ns")), one.select(F.col("id").alias("dst"), F.col("namespace").alias("dst_ns"))
    both = edges.select("id", "src", "dst").join(src, "src").join(dst, "dst")
    return both.select("id", "src_ns", "dst_ns", (~F.col("src_ns").eqNullSafe(F.col("dst_ns"))).alias("cross"))


def export_rows(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """Each memory with its incident edges in order, for write.json (or csv with tags joined by ';')."""
    ends = edges.select(F.col("src").alias("id"), "relationship", F.col("dst").alias("other"), F.lit("out").alias("way")).union(edges.select(F.col("dst").alias("id"), "relationship", F.col("src").alias("other"), F.lit("in").alias("way")))
    packed = ends.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("relationship", "way", "other"))).alias("edges"))
    return memories.join(packed, "id", "left")
