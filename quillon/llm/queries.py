"""The pN_ queries: each applies a problem's operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import copies, leakage, mixing, neardup, neighbours, pieces, ranking, spans, terms
from .common import durable, latest, table

SCORES = {"importance": 1.0, "confidence": 1.0, "access_count": 1.0, "centrality": 1.0}


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    scores = ranking.session_scores(table(spark, d, "memories"), table(spark, d, "graph_nodes"))
    return ranking.rank_scores(scores, "session_id", "memory_id", SCORES)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.best_of_groups(_ranked(spark, d), "session_id", "memory_id", by="place", least=12)


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(spark, d).withColumn("place", F.round("place", 9)).withColumn("score", F.round("score", 9) + 0.0)
    return ranking.positions(ranked, "session_id", "memory_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "code_chunks"), table(spark, d, "chunk_configs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).select("chunk_id").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.memory_copies(table(spark, d, "memories")).where("id <> rep_id").select("rep_id", F.col("id").alias("memory_id"))


def p3_copies(spark: SparkSession, d: str) -> DataFrame:
    return copies.memory_copies(table(spark, d, "memories")).where("id = rep_id").select("rep_id", "copies")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.memory_pairs(table(spark, d, "memories"), least=0.7)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(neardup.near_duplicates(latest(table(spark, d, "memories"), "content"), "id", "content", least=0.7))


def _similar(spark: SparkSession, d: str, least: float) -> DataFrame:
    return neighbours.similar_vectors(table(spark, d, "memory_embeddings"), "memory_id", "embedding", "model", k=5, least=least, probes=4)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = _similar(spark, d, 0.8)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.memory_terms(table(spark, d, "memories")).withColumn("score", F.round("score", 9))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    scored = terms.memory_terms(table(spark, d, "memories"))
    rare = scored.where(F.col("df").between(2, 12) & ((F.col("field") == "tags") | (F.col("tf") >= 3)))
    return rare.where("score > 0").select("memory_id", "field", "term")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"), n=12)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    cleaned = leakage.without_spans(table(spark, d, "documents"), durable(_leaks(spark, d)))
    return cleaned.where("removed > 0").select("doc_id", "removed", F.length("text").alias("n_chars"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return mixing.count_tokens(table(spark, d, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_of_target(*_mixed(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mix and its plan."""
    sized = durable(_sized(spark, d))
    plan = mixing.plan_shares(sized, table(spark, d, "mix_targets"))
    return mixing.mix_sources(sized, plan), plan


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares_reached(*_mixed(spark, d))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"), least=320)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("doc_a", "doc_b").distinct()


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"), durable(_spans(spark, d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_ranking, p2_found, p2_pieces, p3_found, p3_copies, p4_found, p4_groups, p5_found, p6_found, p6_terms, p7_found, p7_cleaned, p8_found, p8_mix, p8_shares, p9_found, p9_shared]
    return {f.__name__: f for f in own}
