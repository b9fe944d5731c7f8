"""What the corpus operators share: tables, words, hashes and the shared folder for checkpoints."""

from __future__ import annotations

import re
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: an unbroken run of letters or digits of any script; ``_`` separates.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The lower-cased words of a text, in order; none for null."""
    return WORD.findall(text.lower()) if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(memories: DataFrame, *columns: str) -> DataFrame:
    """One row per id, the one with the latest ``updated_at``.

    Null ids are left out. Among rows with equal ``updated_at`` (a null counts
    as the earliest) the greatest values of the given columns win, so exact
    copies fall together. An aggregate with map-side combine rather than a
    window, so an id that is delivered a million times is no hot task.
    """
    keep = [c for c in columns if c not in ("id", "updated_at")]
    return (
        memories.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(F.struct("updated_at", *keep)).alias("_row"))
        .select("id", *(F.col("_row")[c].alias(c) for c in keep))
    )


def h64(data: bytes | str) -> int:
    """Signed 64-bit hash, the same on every machine and in every run."""
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


class WordHashes(dict):
    """word -> unsigned 64-bit hash, computed once per distinct word and worker (and dropped when it grows large)."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift-multiply)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Frees the shuffle files of a statement when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: that of ``spark.checkpoint.dir``; only where it is unset (tests, local runs) a local one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="quillon-checkpoint-")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table written into the shared checkpoint folder of the session.

    A compressed table is a fraction of a checkpoint's serialised rows and is
    read by column. The shuffle files behind it are freed as soon as it stands;
    should an executor be lost, the table is still there.
    """
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(where)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(where)


def discard(df: DataFrame) -> None:
    """Delete the table of a durable DataFrame that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
