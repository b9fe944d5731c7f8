"""Jobs that keep a store in shape: decay, themes, merging, forgetting, links."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S
from ..functions.lineage import durable
from .graph import components
from .records import tag_siblings
from .vectors import nearest


def decayed(memories: DataFrame, now: str | Column, idle_days: int = 30) -> DataFrame:
    """(id, importance): importance * 0.9^(days / 30) * (1 + 0.1 log2(max(access, 1))) in [0, 1] of memories idle for longer."""
    when = S.when_of(now)
    days = S.days_since(F.col("last_accessed_at"), when)
    access = F.greatest(F.coalesce("access_count", F.lit(0)), F.lit(1)).cast("double")
    new = S.clamp(F.col("importance") * F.pow(F.lit(0.9), days / 30.0) * (1 + 0.1 * F.log2(access)), 0.0, 1.0)
    return memories.where((F.col("importance").isNotNull()) & (days > idle_days)).select("id", F.round(new, 9).alias("importance"))


def decayed_flat(memories: DataFrame, before: str | Column, factor: float) -> DataFrame:
    return memories.where(F.col("last_accessed_at") < S.when_of(before)).select("id", (F.col("importance") * factor).alias("importance"))


def themes(memories: DataFrame, embeddings: DataFrame, edges: DataFrame, queries: DataFrame | None = None, k: int = 7, unlike: float = 0.35, alike: float = 0.5) -> DataFrame:
    """(src, dst, weight): SHARES_THEME links between near memories that are not linked yet.

    queries (query_id, vector) is the stated set of memories to link (the new
    ones), by default all that have a vector; they are compared with all. Kinds
    that differ need less similarity.
    """
    if queries is None:
        own = embeddings.where("embedding IS NOT NULL").join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
        queries = own.groupBy(F.col("memory_id").alias("query_id")).agg(F.max("embedding").alias("vector"))
    near = nearest(embeddings, queries, k, key="memory_id", vector="embedding", per_pass=16_384)
    kind = memories.select("id", S.memory_type().alias("kind"))
    both = near.join(kind.select(F.col("id").alias("query_id"), F.col("kind").alias("a")), "query_id").join(kind.select("id", F.col("kind").alias("b")), "id")
    close = both.where(F.col("score") >= F.when(F.col("a") == F.col("b"), alike).otherwise(unlike))
    pairs = close.select(F.least("query_id", "id").alias("src"), F.greatest("query_id", "id").alias("dst"), "score").groupBy("src", "dst").agg(F.max("score").alias("weight"))
    known = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return pairs.join(known, ["src", "dst"], "left_anti")


#: Tags of memories that someone has looked at.
REVIEWED = ("agent-curated", "agent-verified", "human-verified")


def clusters(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component, keep): memories joined by near pairs (src, dst) within a namespace and kind; the winner of each is kept.

    The winner is the one of the first tier (tagged as curated or verified, then
    the rest, then archived) and of the greatest importance; ties by id.
    """
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    tier = F.when(F.arrays_overlap(tags, F.array(*map(F.lit, REVIEWED))), 0).when(F.array_contains(tags, "archived"), 2).otherwise(1)
    own = memories.select("id", F.coalesce("namespace", F.lit("")).alias("ns"), S.memory_type().alias("kind"), F.coalesce("importance", F.lit(0.0)).alias("importance"), tier.alias("tier"))
    a, b = own.select(F.col("id").alias("src"), F.col("ns").alias("na"), F.col("kind").alias("ka")), own.select(F.col("id").alias("dst"), F.col("ns").alias("nb"), F.col("kind").alias("kb"))
    same = durable(pairs.join(a, "src").join(b, "dst").where((F.col("na") == F.col("nb")) & F.col("ka").eqNullSafe(F.col("kb"))).select("src", "dst"))  # read twice
    ids = same.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    comp = components(ids, same)
    joined = comp.join(own, "id")
    win = joined.groupBy("component").agg(F.min(F.struct(F.col("tier").alias("t"), (-F.col("importance")).alias("i"), "id")).alias("m")).select("component", F.col("m.id").alias("winner"))
    return joined.join(win, "component").select("id", "component", (F.col("id") == F.col("winner")).alias("keep"))


#: Vectors of a block that a tile holds from each side.
TILE = 2048


def _tile_pairs(least: float):
    """Pairs of one tile: the vectors of part i against those of part j of the same block."""

    def run(tile: pa.Table) -> pa.Table:
        ids = np.array(tile.column("memory_id").to_pylist(), object)
        part, i, j = tile.column("part").to_numpy(), tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
        x = tile.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)
        a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
        found = []
        for lo in range(0, len(a), 512):
            s = x[a[lo : lo + 512]] @ x[b].T
            r, c = np.nonzero(s >= least)
            p, q = ids[a[lo + r]], ids[b[c]]
            own = p < q if i == j else p != q  # inside a part each pair occurs both ways
            p, q = p[own], q[own]
            found.append(pa.table({"src": pa.array(np.where(p < q, p, q), pa.string()), "dst": pa.array(np.where(p < q, q, p), pa.string()), "cosine": pa.array(s[r, c][own], pa.float64())}))
        return pa.concat_tables(found) if found else pa.table({"src": pa.array([], pa.string()), "dst": pa.array([], pa.string()), "cosine": pa.array([], pa.float64())})

    return run


def close_pairs(embeddings: DataFrame, blocks: DataFrame, least: float = 0.92, per_tile: int = TILE) -> DataFrame:
    """(src, dst, cosine): all pairs of vectors of one block (memory_id, block) with a cosine of ``least``, exact; of several vectors of an id the nearest count.

    A block of any size is cut into parts of about ``per_tile`` vectors by the
    hash of the id; each pair of parts is a tile and a task of its own.
    Vectors of other length are no pair.
    """
    usable = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("memory_id", F.col("embedding").cast("array<float>").alias("embedding"))
    own = usable.join(blocks.select("memory_id", "block").where("block IS NOT NULL").distinct(), "memory_id").withColumn("d", F.size("embedding"))
    parts = own.groupBy("block", "d").agg(F.ceil(F.count("*") / per_tile).cast("int").alias("parts"))
    cut = own.join(parts, ["block", "d"]).withColumn("part", F.pmod(F.xxhash64("memory_id"), F.col("parts")).cast("int"))
    tiles = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select("block", "d", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "memory_id", "embedding")
    pairs = tiles.groupBy("block", "d", "i", "j").applyInArrow(_tile_pairs(least), "src string, dst string, cosine double")
    return pairs.groupBy("src", "dst").agg(F.max("cosine").alias("cosine"))


def near_duplicates(memories: DataFrame, embeddings: DataFrame, least: float = 0.92) -> DataFrame:
    """(src, dst, cosine): close pairs of the memories of each namespace and kind, whatever edges there are."""
    blocks = memories.select(F.col("id").alias("memory_id"), F.to_json(F.struct(F.coalesce("namespace", F.lit("")).alias("n"), S.memory_type().alias("k"))).alias("block"))
    return close_pairs(embeddings, blocks, least)


def first_lines(contents: Column) -> Column:
    """A writer for summaries: the first line of each content, 120 characters at most."""
    return F.array_join(F.transform(contents, lambda x: S.signature(x["content"])), "\n")


def joined(contents: Column) -> Column:
    """A writer for summaries: the whole contents."""
    return F.array_join(F.transform(contents, lambda x: x["content"]), "\n---\n")


def summaries(comp: DataFrame, memories: DataFrame, least: int = 5, writer: Callable[[Column], Column] = joined) -> DataFrame:
    """(component, n, text): a text for each component of ``least`` memories; writer is a column function over the whole contents (id, content), sorted by id."""
    packed = comp.join(memories.select("id", "content"), "id").groupBy("component").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "content"))).alias("contents")).where(F.col("n") >= least)
    return packed.select("component", "n", writer(F.col("contents")).alias("text"))


def tag_links(memories: DataFrame, most: int = 50) -> DataFrame:
    """(src, dst, relationship, weight): one edge to each sibling by tag; session tags give PRECEDED_BY 0.8, others SHARES_THEME 0.5."""
    pairs = tag_siblings(memories, most).withColumn("session", F.startswith("tag", F.lit("session:")))
    one = pairs.groupBy(F.col("id").alias("src"), F.col("sibling").alias("dst")).agg(F.max("session").alias("s"))
    return one.select("src", "dst", F.when(F.col("s"), "PRECEDED_BY").otherwise("SHARES_THEME").alias("relationship"), F.when(F.col("s"), 0.8).otherwise(0.5).alias("weight"))


def code_links(memories: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, weight): memories to the files and symbols that their words name, weight 0.5."""
    word = F.explode(F.array_distinct(F.transform(F.split("content", r"\s+"), lambda w: F.regexp_replace(w, r"^[^\w./:]+|[^\w/]+$", "")))).alias("word")
    each = memories.where("content IS NOT NULL").select("id", word).where("word <> ''")
    wanted = each.select("id", F.explode(F.array(F.concat(F.lit("file:"), "word"), F.concat(F.lit("sym:"), "word"))).alias("dst"))
    known = nodes.where("kind <> 'memory'").select(F.col("id").alias("dst"), F.regexp_replace("id", r"#\d+$", "").alias("name")).distinct()
    hit = wanted.join(known.select("dst", "name").withColumnRenamed("dst", "node").withColumnRenamed("name", "dst"), "dst")
    return hit.select(F.col("id").alias("src"), F.col("node").alias("dst"), F.lit(0.5).alias("weight")).distinct()


def enriched_text(memories: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(id, text): the content with up to ``most`` of its edges and their neighbours' labels below. The cut is the feature."""
    label = nodes.groupBy("id").agg(F.min(F.coalesce("label", "id")).alias("label"))
    e = edges.select(F.col("src").alias("id"), F.col("id").alias("edge"), "relationship", F.col("dst").alias("other")).union(edges.select("dst", "id", "relationship", "src"))
    own = e.join(memories.select("id"), "id", "left_semi").join(label.withColumnRenamed("id", "other"), "other")
    sliced = W.partitionBy("id", F.pmod(F.xxhash64("edge"), F.lit(16))).orderBy("edge", "other")
    few = own.withColumn("r", F.row_number().over(sliced)).where(F.col("r") <= most).withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("edge", "other"))).where(F.col("r") <= most)
    lines = few.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" ", "relationship", "label").alias("x")))), lambda x: x["x"]), "\n").alias("lines"))
    return memories.select("id", "content").join(lines, "id", "left").select("id", F.concat_ws("\n", "content", "lines").alias("text"))


def evolved(parents: DataFrame, children: DataFrame, how: str = "EVOLVED_INTO") -> DataFrame:
    """(src, dst, relationship): refine (EVOLVED_INTO), split (PART_OF, from the parts) and merge (SUMMARIZES, to the sources). parents (key, id), children (key, id)."""
    pair = parents.select("key", F.col("id").alias("p")).join(children.select("key", F.col("id").alias("c")), "key")
    src, dst = ("p", "c") if how == "EVOLVED_INTO" else ("c", "p")
    return pair.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(how).alias("relationship"))


def merged(memories: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, content, importance, confidence, tags): a memory for each group (key, id): contents in id order, the greatest importance, the mean confidence, all tags."""
    own = groups.join(memories, "id")
    return own.groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda x: x["content"]), "\n\n").alias("content"),
        F.max("importance").alias("importance"),
        F.avg("confidence").alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags"),
    )
