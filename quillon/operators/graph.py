"""Graph algorithms over edge tables (src, dst, ...).

Traversals, components, layers and PageRank are loops of joins whose state is
checkpointed each round; they hold for graphs of any size. Betweenness and
communities work on a compact copy of the graph and refuse one beyond a stated
number of edges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S
from ..functions.lineage import durable

#: Edges up to which a graph may be held whole by a kernel (24 bytes each).
KERNEL_EDGES = 5_000_000

#: Groups up to which their sums are broadcast.
BROADCAST_GROUPS = 100_000

HERITAGE = ("EXTENDS", "IMPLEMENTS", "INHERITS")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", relationships: Sequence[str] | None = None) -> DataFrame:
    """(id, depth): what is reached from the seeds (id) within ``depth`` steps, each at its least depth.

    direction is "out", "in" or "both". Only the frontier is joined each round.
    """
    e = edges if relationships is None else edges.where(F.col("relationship").isin(*relationships))
    e = e.select("src", "dst")
    steps = {"out": e, "in": e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "both": both_ways(e)}[direction].distinct()
    seen = durable(seeds.select("id").where("id IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        new = frontier.select(F.col("id").alias("src")).join(steps, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = durable(new.withColumn("depth", F.lit(level)))
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    return seen


def bfs_filtered(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, exclude_kinds: Sequence[str] = (), relationships: Sequence[str] | None = None, direction: str = "out") -> DataFrame:
    """As bfs; nodes of excluded kinds are passed through but not given."""
    out = bfs(edges, seeds, depth, direction, relationships)
    return out.join(nodes.where(F.col("kind").isin(*exclude_kinds)).select("id"), "id", "left_anti") if exclude_kinds else out


def reachable(edges: DataFrame, seeds: DataFrame, direction: str = "both", relationships: Sequence[str] | None = None) -> DataFrame:
    """The closure: what depth-first search visits when depth is no bound."""
    return bfs(edges, seeds, 1 << 30, direction, relationships).select("id")


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """(step, id) of a shortest directed path, the smallest parent at each step; no rows if there is none."""
    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    seen = durable(spark.createDataFrame([(start, None, 0)], "id string, parent string, depth int"))
    frontier = seen
    level = 0
    while True:
        level += 1
        if frontier.where(F.col("id") == goal).limit(1).count():
            break
        new = frontier.select(F.col("id").alias("src")).join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent")).join(seen, "id", "left_anti")
        frontier = durable(new.withColumn("depth", F.lit(level)))
        if not frontier.limit(1).count():
            break
        seen = durable(seen.unionByName(frontier))
    path, at = [], goal
    while at is not None:  # one row a step of the path
        row = seen.where(F.col("id") == at).first()
        if row is None:
            return spark.createDataFrame([], "step int, id string")
        path.append((row["depth"], at))
        at = row["parent"]
    return spark.createDataFrame(path[::-1], "step int, id string")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node is connected with.

    Least labels pass along the edges, then along the labels (pointer jumping),
    so rounds grow with the logarithm of the longest chain.
    """
    ids = nodes.select("id").distinct()
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    steps = durable(both_ways(e).where("src <> dst").distinct())
    label = durable(ids.withColumn("l", F.col("id")))
    while True:
        near = steps.join(label.select(F.col("id").alias("dst"), "l"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("l").alias("n"))
        new = label.join(near, "id", "left").select("id", "l", F.least("l", F.coalesce("n", "l")).alias("m"))
        new = durable(new.join(new.select(F.col("id").alias("m"), F.col("m").alias("k")), "m").select("id", "l", F.least("m", "k").alias("m")))
        done = not new.where("m <> l").limit(1).count()
        label = new.select("id", F.col("m").alias("l"))
        if done:
            return label.select("id", F.col("l").alias("component"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, centrality): ends of edges at each node, over N - 1."""
    n = nodes.agg(F.countDistinct("id").alias("n"))  # one row
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    own = nodes.select("id").distinct().join(ends, "id", "left").crossJoin(F.broadcast(n))
    d = F.coalesce("d", F.lit(0))
    return own.select("id", d.alias("degree"), F.when(F.col("n") > 1, d / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, seeds: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """(id, rank): parallel edges count each, weights do not; what dangling nodes hold is spread over all nodes.

    seeds (id) make it personalised: teleport and dangling mass go to them.
    by: a column of nodes (namespace) whose values are ranked each by itself,
    over edges that stay inside. Edges with an end that is no node are ignored.
    Stops when the ranks move by less than ``tolerance`` in all (L1), which is
    looked at every third round.
    """
    group = F.coalesce(F.col(by), F.lit("")) if by else F.lit("")
    own = nodes.groupBy("id").agg(F.min(group).alias("g"))
    own = own.join(seeds.select("id").distinct().withColumn("s", F.lit(1.0)), "id", "left").fillna(0.0, ["s"]) if seeds is not None else own.withColumn("s", F.lit(1.0))
    own = durable(own)
    # all nodes may be of one group: its sums are broadcast, unless there are very many groups
    few = F.broadcast if not by or own.select("g").distinct().count() <= BROADCAST_GROUPS else lambda df: df
    sums = few(own.groupBy("g").agg(F.sum("s").alias("total")))
    ends = edges.select("src", "dst").join(own.select(F.col("id").alias("src"), F.col("g").alias("gs")), "src").join(own.select(F.col("id").alias("dst"), F.col("g").alias("gd")), "dst").where("gs = gd").groupBy("src", "dst").agg(F.count("*").alias("c"))
    ends = durable(ends)
    out = ends.groupBy("src").agg(F.sum("c").alias("out"))
    steps = durable(ends.join(out, "src").select("src", "dst", (F.col("c") / F.col("out")).alias("w")))
    rank = own.join(sums, "g").where("total > 0").join(out.select(F.col("src").alias("id"), F.lit(False).alias("d")), "id", "left")
    rank = durable(rank.select("id", "g", (F.col("s") / F.col("total")).alias("t"), F.coalesce("d", F.lit(True)).alias("dangling"))).withColumn("r", F.col("t"))
    for i in range(rounds):
        flow = rank.select(F.col("id").alias("src"), "r").join(steps, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("w")).alias("f"))
        lost = few(rank.where("dangling").groupBy("g").agg(F.sum("r").alias("lost")))
        new = rank.join(flow, "id", "left").join(lost, "g", "left").select("id", "g", "t", "dangling", F.col("r").alias("before"), ((1 - damping) * F.col("t") + damping * (F.coalesce("f", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) * F.col("t"))).alias("r"))
        if i % 3 == 2 or i == rounds - 1:
            new = durable(new)
            moved = new.agg(F.sum(F.abs(F.col("r") - F.col("before"))).alias("m")).first()[0]
            if moved is None or moved < tolerance:
                rank = new
                break
        rank = new.drop("before")
    return rank.select("id", F.col("r").alias("rank"))


def strongly_connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, scc): the smallest id of each strongly connected component.

    Forward-backward colouring: nodes without a way in or out are components
    of their own and are trimmed; the others take the smallest id that reaches
    them as colour; those that reach the colour's root inside the colour are
    one component, which leaves the graph.
    """
    ids = durable(nodes.select("id").distinct())
    e = edges.select("src", "dst").where("src <> dst").distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    left, e = ids, durable(e)
    found: DataFrame | None = None
    while True:
        live = e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))
        alone = durable(left.join(live, "id", "left_anti").withColumn("scc", F.col("id")))
        found = alone if found is None else found.union(alone)
        if alone.limit(1).count():
            left = durable(left.join(alone, "id", "left_anti"))
            e = durable(e.join(alone.select(F.col("id").alias("src")), "src", "left_anti").join(alone.select(F.col("id").alias("dst")), "dst", "left_anti"))
            continue
        if not left.limit(1).count():
            return found
        colour = durable(left.withColumn("c", F.col("id")))
        while True:
            near = e.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("n"))
            new = durable(colour.join(near, "id", "left").select("id", F.col("c").alias("b"), F.least("c", F.coalesce("n", "c")).alias("c")))
            done = not new.where("b <> c").limit(1).count()
            colour = new.select("id", "c")
            if done:
                break
        inside = durable(e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst"))
        back = durable(colour.where("id = c"))
        edge = back
        while True:
            more = inside.join(edge.select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c").distinct().join(back, "id", "left_anti")
            edge = durable(more)
            if not edge.limit(1).count():
                break
            back = durable(back.union(edge))
        found = durable(found.union(back.select("id", F.col("c").alias("scc"))))
        left = durable(left.join(back, "id", "left_anti"))
        e = durable(e.join(back.select(F.col("id").alias("src")), "src", "left_anti").join(back.select(F.col("id").alias("dst")), "dst", "left_anti"))


def topological_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, layer): layer 0 has no way in; components that are cycles lie in one layer."""
    scc = durable(strongly_connected(nodes, edges))
    one = lambda end, name: scc.select(F.col("id").alias(end), F.col("scc").alias(name))
    dag = durable(edges.select("src", "dst").join(one("src", "a"), "src").join(one("dst", "b"), "dst").where("a <> b").select("a", "b").distinct())
    left, layers, level = durable(scc.select(F.col("scc").alias("n")).distinct()), None, 0
    while left.limit(1).count():
        top = durable(left.join(dag.select(F.col("b").alias("n")).distinct(), "n", "left_anti"))
        layer = top.withColumn("layer", F.lit(level))
        layers = layer if layers is None else layers.union(layer)
        left = durable(left.join(top, "n", "left_anti"))
        dag = durable(dag.join(top.select(F.col("n").alias("a")), "a", "left_anti"))
        level += 1
    if layers is None:
        return scc.select("id", F.lit(0).alias("layer")).limit(0)
    return scc.join(layers.withColumnRenamed("n", "scc"), "scc").select("id", "layer")


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scc, size, severity): components of two nodes at least."""
    size = strongly_connected(nodes, edges).groupBy("scc").agg(F.count("*").alias("size")).where("size >= 2")
    return size.withColumn("severity", F.when(F.col("size") >= 5, "critical").when(F.col("size") >= 3, "warning").otherwise("info"))


def _held(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list]:
    n = edges.count()
    if n > most:
        raise ValueError(f"{n} edges; this kernel holds {most} at most (parameter most_edges)")
    ids = [r["id"] for r in nodes.select("id").distinct().orderBy("id").limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"more than {most} nodes")
    place = {k: i for i, k in enumerate(ids)}
    rows = [(place[r["src"]], place[r["dst"]], r["w"], r["rel"]) for r in edges.select("src", "dst", F.coalesce(F.col("weight") if "weight" in edges.columns else F.lit(1.0), F.lit(1.0)).alias("w"), (F.col("relationship") if "relationship" in edges.columns else F.lit("")).alias("rel")).collect() if r["src"] in place and r["dst"] in place]
    src, dst, w = (np.array([r[i] for r in rows], t) for i, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
    return ids, src, dst, w, [r[3] for r in rows]


def brandes(n: int, offsets: np.ndarray, targets: np.ndarray, source: int) -> np.ndarray:
    """Dependencies of all nodes on one source, level by level."""
    dist, sigma = np.full(n, -1), np.zeros(n)
    dist[source], sigma[source] = 0, 1.0
    levels, frontier = [], np.array([source])
    while len(frontier):
        counts = offsets[frontier + 1] - offsets[frontier]
        start = np.repeat(offsets[frontier] - np.cumsum(counts) + counts, counts)
        out = targets[start + np.arange(counts.sum())]
        via = np.repeat(frontier, counts)
        level = dist[frontier[0]] + 1
        fresh = np.unique(out[dist[out] < 0])
        dist[fresh] = level
        ok = dist[out] == level
        np.add.at(sigma, out[ok], sigma[via[ok]])
        levels.append((via[ok], out[ok]))
        frontier = fresh
    delta = np.zeros(n)
    for via, out in reversed(levels):
        np.add.at(delta, via, sigma[via] / sigma[out] * (1 + delta[out]))
    delta[source] = 0.0
    return delta


def betweenness(nodes: DataFrame, edges: DataFrame, most_edges: int = KERNEL_EDGES) -> DataFrame:
    """(id, betweenness) by Brandes, directed, over (n-1)(n-2); sources in parallel over a broadcast copy of the graph.

    Above 1000 nodes the sources are sqrt(n) evenly spaced ones in the order of
    the ids, scaled up. Up to two nodes: 0. Parallel edges count each.
    """
    spark = nodes.sparkSession
    ids, src, dst, _, _ = _held(nodes, edges, most_edges)
    n = len(ids)
    if n <= 2:
        return nodes.select("id").distinct().withColumn("betweenness", F.lit(0.0))
    order = np.argsort(src, kind="stable")
    targets, offsets = dst[order], np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
    sources = list(range(n)) if n <= 1000 else [i * (n // int(n**0.5)) for i in range(int(n**0.5))]
    scale = (n / len(sources) if n > 1000 else 1.0) / ((n - 1) * (n - 2))
    shared = spark.sparkContext.broadcast((n, offsets, targets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, offsets, targets = shared.value
        total = np.zeros(n)
        for b in batches:
            for s in b["source"]:
                total += brandes(n, offsets, targets, int(s))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"node": at, "b": total[at]})

    parts = spark.createDataFrame([(s,) for s in sources], "source int").repartition(min(len(sources), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "node long, b double")
    sums = parts.groupBy("node").agg(F.sum("b").alias("b"))
    named = spark.createDataFrame(pd.DataFrame({"node": range(n), "id": ids}))
    return named.join(sums, "node", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def local_moving(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float = 1.0, passes: int = 100) -> np.ndarray:
    """Single-level local moving of modularity: the community of each node; of equal gains the smallest community."""
    lo, hi = np.minimum(src, dst), np.maximum(src, dst)
    pair, at = np.unique(lo * max(n, 1) + hi, return_inverse=True)
    weight = np.bincount(at, weights=w, minlength=len(pair)) if len(pair) else np.zeros(0)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for p, x in zip(pair.tolist(), weight.tolist()):
        a, b = divmod(p, n)
        near[a].append((b, x))
        if a != b:
            near[b].append((a, x))
    m = float(weight.sum())
    community = np.arange(n)
    if m <= 0:
        return community
    strength = np.array([sum(x for _, x in row) for row in near])
    held = strength.copy()
    for _ in range(passes):
        moved = False
        for i in range(n):
            own, k = community[i], strength[i]
            shares: dict[int, float] = {}
            for j, x in near[i]:
                shares[community[j]] = shares.get(community[j], 0.0) + x
            stay = shares.get(own, 0.0) / m - resolution * k * (held[own] - k) / (2 * m * m)
            best, gain = own, 0.0
            for c in sorted(shares):
                g = shares[c] / m - resolution * k * held[c] / (2 * m * m) - stay
                if c != own and g > gain:
                    best, gain = c, g
            if best != own:
                held[own] -= k
                held[best] += k
                community[i] = best
                moved = True
        if not moved:
            break
    return community


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, most_edges: int = KERNEL_EDGES) -> DataFrame:
    """(id, community): local moving over the undirected graph, heritage edges at half weight; a community is named by its smallest id."""
    spark = nodes.sparkSession
    ids, src, dst, w, rel = _held(nodes, edges, most_edges)
    if not ids:
        return nodes.select("id", F.col("id").alias("community")).limit(0)
    w = w * np.array([0.5 if r in HERITAGE else 1.0 for r in rel])
    com = local_moving(len(ids), src, dst, w, resolution)
    least: dict[int, str] = {}
    for i, c in zip(ids, com.tolist()):
        least[c] = min(least.get(c, i), i)
    return spark.createDataFrame([(i, least[c]) for i, c in zip(ids, com.tolist())], "id string, community string")


def community_labels(assigned: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, label): the two most frequent parent folders of its members, "+k more" if there are more."""
    path = S.json_text("payload", "$.file_path")
    folder = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    own = assigned.join(nodes.select("id", folder.alias("d")), "id", "left").groupBy("community", "d").agg(F.count("*").alias("c"))
    real = F.col("d").isNotNull() & (F.col("d") != "")
    order = W.partitionBy("community").orderBy(F.col("c").desc(), "d")
    top = own.where(real).withColumn("r", F.row_number().over(order))
    two = top.groupBy("community").agg(F.max("r").alias("k"), F.max(F.when(F.col("r") == 1, F.col("d"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("b"))
    label = F.when(F.col("k") == 1, F.col("a")).when(F.col("k") == 2, F.concat_ws("+", "a", "b")).otherwise(F.concat(F.concat_ws("+", "a", "b"), F.lit(" +"), (F.col("k") - 2).cast("string"), F.lit(" more")))
    return assigned.select("community").distinct().join(two, "community", "left").select("community", F.coalesce(F.when(F.col("k").isNotNull(), label), F.lit("unknown")).alias("label"))


def top_subgraph(nodes: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n most central nodes, up to max(n / 5, 1) neighbours over edges that are no containment (by edge id), and the edges among them."""
    top = nodes.orderBy(F.col("centrality").desc_nulls_last(), "id").limit(n)
    ids = top.select("id")
    loose = edges.where(~F.col("relationship").isin("CONTAINS", "PART_OF"))
    near = loose.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"), F.col("id").alias("e")).union(loose.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"), F.col("id").alias("e")))
    extra = near.join(ids, "id", "left_anti").join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.min("e").alias("e")).orderBy("e", "id").limit(max(n // 5, 1))
    chosen = durable(top.union(nodes.join(extra, "id", "left_semi").select(*top.columns)))
    from .records import induced_edges

    return chosen, induced_edges(edges, chosen)


def summary_tree(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 3) -> DataFrame:
    """(id, parent, depth, path): descent along CONTAINS; a node that is reached twice keeps its first, smallest path."""
    contains = edges.where("relationship = 'CONTAINS'").select("src", "dst").distinct()
    level = durable(nodes.where(F.col("id") == root).select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.col("id").alias("path")).distinct())
    seen = level
    for d in range(1, depth + 1):
        new = level.select(F.col("id").alias("src"), "path").join(contains, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("path", "src")).alias("m"))
        level = durable(new.join(seen.select("id"), "id", "left_anti").select("id", F.col("m.src").alias("parent"), F.lit(d).alias("depth"), F.concat_ws(" > ", F.col("m.path"), "id").alias("path")))
        seen = seen.union(level)
    return seen


def node_memories(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """(memory_id, relationship, depth): memories near a node, by undirected steps that do not pass through chunks, with the relationship of the last step."""
    e = edges.select("src", "dst", "relationship")
    steps = e.union(e.select("dst", "src", "relationship")).distinct()
    kinds = nodes.groupBy("id").agg(F.min("kind").alias("kind"))
    seen = durable(nodes.where(F.col("id") == start).select("id", F.lit(None).cast("string").alias("relationship"), F.lit(0).alias("depth")).distinct())
    level = seen
    for d in range(1, depth + 1):
        new = level.select(F.col("id").alias("src")).join(steps, "src").groupBy(F.col("dst").alias("id")).agg(F.min("relationship").alias("relationship"))
        level = durable(new.join(seen.select("id"), "id", "left_anti").join(kinds.where("kind <> 'chunk'").select("id"), "id", "left_semi").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(level)
    return seen.where("depth > 0").join(kinds.where("kind = 'memory'").select("id"), "id", "left_semi").select(F.col("id").alias("memory_id"), "relationship", "depth")


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, memories): edges between a node that is no memory and memories."""
    mem = nodes.where("kind = 'memory'").select("id").distinct()
    ends = both_ways(edges).join(mem.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("memories"))
    return nodes.where("kind <> 'memory'").select("id").distinct().join(ends, "id", "left").select("id", F.coalesce("memories", F.lit(0)).alias("memories"))


#: Steps by which one decision comes from another.
DECISION_STEPS = ("EVOLVED_INTO", "LEADS_TO", "DERIVED_FROM")


def decision_chain(memories: DataFrame, edges: DataFrame, topic: str | None = None, file_path: str | None = None, relationships: Sequence[str] = DECISION_STEPS) -> DataFrame:
    """(id, created_at): the decisions about a topic or file and all decisions connected with them by evolution, oldest first.

    A decision is about a topic if its content or its joined tags contain it,
    and about a file also if its metadata name it; letter case does not count.
    """
    if topic is None and file_path is None:
        raise ValueError("a topic or a file_path is needed")
    own = memories.where(S.memory_type() == "decision")
    text = F.lit((file_path if file_path is not None else topic).lower())
    about = F.contains(F.lower("content"), text) | F.contains(F.lower(F.array_join("tags", " ")), text)
    if file_path is not None:
        about = F.coalesce(about, F.lit(False)) | F.contains(F.lower(S.json_text("metadata", "$.file_path")), text)
    seeds = own.where(about).select("id")
    e = edges.where(F.col("relationship").isin(*relationships))
    e = e.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi")
    return own.join(reachable(e, seeds), "id", "left_semi").select("id", "created_at").orderBy("created_at", "id")
