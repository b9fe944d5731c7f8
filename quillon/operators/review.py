"""What a change touches: from a diff to symbols, dependents, tests and files that usually change along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import durable

DEPENDS = ("CALLS", "IMPORTS", "INHERITS", "IMPLEMENTS", "OVERRIDES")

TEST_FILE = r"(?i)(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$|_spec\.[a-z]+$"


def symbol_ranges(chunks: DataFrame) -> DataFrame:
    """(symbol, file_path, line_start, line_end): the span of the chunks of each symbol."""
    return chunks.where("parent_symbol IS NOT NULL").groupBy(F.concat(F.lit("sym:"), F.col("parent_symbol")).alias("symbol"), "file_path").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))


def lines_to_ranges(lines: DataFrame, ranges: DataFrame, key: str = "symbol", slot: int = 64) -> DataFrame:
    """(file_path, line, key): every range of the file that holds the line.

    A range join as an equi join: ranges are listed under each slot of ``slot``
    lines that they touch, a line looks into its own.
    """
    spread = ranges.withColumn("slot", F.explode(F.sequence(F.floor(F.col("line_start") / slot), F.floor(F.greatest("line_start", "line_end") / slot))))
    own = lines.select("file_path", "line").distinct().withColumn("slot", F.floor(F.col("line") / slot))
    return own.join(spread, ["file_path", "slot"]).where("line BETWEEN line_start AND line_end").select("file_path", "line", key)


def overlapping(spans: DataFrame, ranges: DataFrame, slot: int = 64) -> DataFrame:
    """(id, symbol): every range of the file that shares a line with the span (id, file_path, line_start, line_end).

    Both sides are listed under the slots that they touch; two that meet do so in the slot in which the later one begins.
    """
    each = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / slot), F.floor(F.greatest(a, b) / slot))).alias("slot")
    own = spans.select("id", "file_path", F.col("line_start").alias("c"), F.col("line_end").alias("d"), each("line_start", "line_end"))
    spread = ranges.select("symbol", "file_path", F.col("line_start").alias("a"), F.col("line_end").alias("b"), each("line_start", "line_end"))
    met = own.join(spread, ["file_path", "slot"]).where((F.col("c") <= F.col("b")) & (F.col("a") <= F.col("d")) & (F.col("slot") == F.floor(F.greatest("a", "c") / slot)))
    return met.select("id", "symbol").distinct()


def innermost(spans: DataFrame, ranges: DataFrame, slot: int = 64) -> DataFrame:
    """(id, symbol): the shortest range of the file that holds the whole span (id, file_path, line_start, line_end)."""
    spread = ranges.select("symbol", "file_path", F.col("line_start").alias("a"), F.col("line_end").alias("b")).withColumn("slot", F.explode(F.sequence(F.floor(F.col("a") / slot), F.floor(F.greatest("a", "b") / slot))))
    own = spans.select("id", "file_path", "line_start", "line_end").withColumn("slot", F.floor(F.col("line_start") / slot))
    inside = own.join(spread, ["file_path", "slot"]).where("a <= line_start AND line_end <= b")
    return inside.groupBy("id").agg(F.min(F.struct((F.col("b") - F.col("a")).alias("n"), "symbol")).alias("m")).select("id", F.col("m.symbol").alias("symbol"))


def definition_extents(definitions: DataFrame) -> DataFrame:
    """(id, line, line_end): a definition (id, file_path, depth, line) ends before the next one of its depth or less in the file; null for the last.

    The next smaller-or-equal depth: per depth d the next line of depth <= d,
    by a running minimum backwards.
    """
    from pyspark.sql.window import Window as W

    depths = definitions.select("file_path", F.col("depth").alias("d")).distinct()
    seen = depths.join(definitions.select("file_path", "line", "depth"), "file_path").where("depth <= d").select("file_path", "d", "line").distinct()
    ahead = W.partitionBy("file_path", "d").orderBy("line")
    nxt = seen.withColumn("next", F.lead("line").over(ahead)).select("file_path", F.col("d").alias("depth"), "line", "next")
    return definitions.join(nxt, ["file_path", "depth", "line"], "left").select("id", "line", (F.col("next") - 1).alias("line_end"))


def changed_symbols(lines: DataFrame, ranges: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, how): symbols whose range holds a changed line, and what contains them."""
    hit = lines_to_ranges(lines, ranges).select(F.col("symbol").alias("id")).distinct()
    parents = edges.where("relationship = 'CONTAINS'").join(hit.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(hit, "id", "left_anti")
    return hit.withColumn("how", F.lit("changed")).union(parents.withColumn("how", F.lit("containing")))


def dependents(edges: DataFrame, changed: DataFrame, depth: int = 2) -> DataFrame:
    """(id, depth): symbols that depend on the changed ones (id), directly at depth 1."""
    steps = edges.where(F.col("relationship").isin(*DEPENDS) & F.startswith("src", F.lit("sym:"))).select("src", "dst").distinct()
    seen = durable(changed.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        new = steps.join(frontier.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = durable(new.withColumn("depth", F.lit(d)))
        seen = seen.union(frontier)
    return seen.where("depth > 0")


def blast_radius(nodes: DataFrame, edges: DataFrame, changed: DataFrame, ranks: DataFrame, depth: int = 2) -> DataFrame:
    """One row: direct and transitive dependents, files and modules concerned, risk = sum of the changed symbols' rank + ln(dependents + 1)."""
    dep = durable(dependents(edges, changed, depth))
    counts = dep.agg(F.count(F.when(F.col("depth") == 1, 1)).alias("direct"), F.count(F.when(F.col("depth") > 1, 1)).alias("transitive"))
    risk = changed.select("id").distinct().join(ranks, "id").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("r"))
    all_ids = changed.select("id").union(dep.select("id")).distinct()
    own = nodes.join(all_ids, "id", "left_semi")
    where = own.agg(F.countDistinct(S.json_text("payload", "$.file_path")).alias("files"), F.countDistinct(F.when(F.col("kind") == "module", F.col("id"))).alias("modules"))
    row = counts.crossJoin(risk).crossJoin(where)  # one row each
    return row.select("direct", "transitive", "files", "modules", F.round(F.col("r") + F.log(F.col("direct") + F.col("transitive") + 1.0), 9).alias("risk"))


def missing_changes(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, n): unchanged symbols that call at least max(changed / 2, 2) of the things that the changed ones call."""
    calls = edges.where("relationship = 'CALLS'").select("src", "dst").distinct()
    own = changed.select(F.col("id").alias("src")).distinct()
    shared = calls.join(own, "src", "left_semi").groupBy("dst").agg(F.count("*").alias("k"))
    others = calls.join(own, "src", "left_anti").join(shared, "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    size = own.agg(F.greatest(F.floor(F.count("*") / 2), F.lit(2)).alias("least"))  # one row
    return others.crossJoin(F.broadcast(size)).where("n >= least").select("id", "n")


def co_changed(edges: DataFrame, files: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, weight): files that usually change with the given ones (id) but are not among them; mean CO_CHANGED weight."""
    e = edges.where("relationship = 'CO_CHANGED'").select("src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    ends = e.union(e.select("dst", "src", "weight"))
    own = files.select("id").distinct()
    near = ends.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return near.groupBy(F.col("dst").alias("id")).agg(F.avg("weight").alias("weight")).where(F.col("weight") >= least)


def is_test() -> Column:
    """Over the columns of a node: by kind, payload or path."""
    path = S.json_text("payload", "$.file_path")
    return F.coalesce((F.col("kind") == "test") | (S.json_text("payload", "$.is_test") == "true") | (S.json_text("payload", "$.kind") == "test") | path.rlike(TEST_FILE) | F.col("label").rlike(TEST_FILE), F.lit(False))


def test_impact(nodes: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 4, tests: Column | None = None) -> DataFrame:
    """(id, depth, how): tests that reach a changed symbol by calls; direct up to depth 2. The depth is the least over all changed symbols."""
    from .graph import bfs

    calls = edges.where("relationship = 'CALLS'")
    near = bfs(calls, changed, depth, "in").where("depth > 0")
    own = nodes.where(is_test() if tests is None else tests).select("id").distinct()
    return near.join(own, "id", "left_semi").select("id", "depth", F.when(F.col("depth") <= 2, "direct").otherwise("transitive").alias("how"))
