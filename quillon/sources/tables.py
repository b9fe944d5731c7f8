"""The logical tables of the store, read once and given as DataFrames or SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of the store and the key that names a row of each.
TABLES = {
    "memories": "id",
    "memory_embeddings": "memory_id",
    "graph_nodes": "id",
    "graph_edges": "id",
    "sessions": "id",
    "session_activity": "id",
    "code_chunks": "id",
    "documents": "doc_id",
}


def latest_by(df: DataFrame, key: str, version: str, *columns: str) -> DataFrame:
    """One row per key, that of the greatest version; exact copies fall together. Null keys are left out.

    An aggregate with map-side combine: a key delivered very often is no hot task.
    """
    keep = [c for c in (columns or df.columns) if c not in (key, version)]
    row = F.max(F.struct(version, *keep)).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, *(F.col("_row")[c].alias(c) for c in (version, *keep)))


class Store:
    """A folder of parquet tables. Only the columns that are asked for are read."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.where}/{name}.parquet")

    def memories(self, *columns: str) -> DataFrame:
        """The latest version of each memory."""
        return latest_by(self.raw("memories"), "id", "updated_at", *columns)

    def _once(self, name: str, columns: tuple[str, ...]) -> DataFrame:
        df = self.raw(name)
        return (df.select(*columns) if columns else df).distinct()

    def nodes(self, *columns: str) -> DataFrame:
        """Graph nodes; rows delivered twice count once."""
        return self._once("graph_nodes", ("id", *(c for c in columns if c != "id")) if columns else ())

    def edges(self, *columns: str) -> DataFrame:
        """Graph edges by id; rows delivered twice count once, parallel edges stay."""
        return self._once("graph_edges", ("id", *(c for c in columns if c != "id")) if columns else ())

    def activity(self, *columns: str) -> DataFrame:
        return self._once("session_activity", ("id", *(c for c in columns if c != "id")) if columns else ())

    def sessions(self, *columns: str) -> DataFrame:
        return self._once("sessions", ("id", *(c for c in columns if c != "id")) if columns else ())

    def embeddings(self) -> DataFrame:
        return self._once("memory_embeddings", ())

    def chunks(self, *columns: str) -> DataFrame:
        return self._once("code_chunks", ("id", *(c for c in columns if c != "id")) if columns else ())

    def register(self, prefix: str = "") -> None:
        """Temp views for spark.sql: the cleaned tables under their own names."""
        for name, df in {
            "memories": self.memories(),
            "graph_nodes": self.nodes(),
            "graph_edges": self.edges(),
            "session_activity": self.activity(),
            "sessions": self.sessions(),
            "memory_embeddings": self.embeddings(),
            "code_chunks": self.chunks(),
        }.items():
            df.createOrReplaceTempView(prefix + name)
