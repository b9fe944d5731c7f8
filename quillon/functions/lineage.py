"""Cutting the lineage of iterative plans through the session's shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """The same rows, read from a checkpoint that survives the loss of executors.

    The folder is that of ``spark.checkpoint.dir``; a local one is made only
    where a local session names none.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="quillon-checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint()
