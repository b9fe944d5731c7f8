"""Incremental ingest with Structured Streaming: activity, sessions of file events, triggers and upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.readers import hook_events


def hook_stream(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """Hook payloads, one JSON text a line, as typed events; a payload that comes again within ``delay`` counts once."""
    raw = spark.readStream.text(folder)
    typed = hook_events(raw).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return typed.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["hash"])


def watch_batches(events: DataFrame, pause: str = "5 seconds", delay: str = "1 minute") -> DataFrame:
    """(start, end, n, files, importance): bursts of file events (ts, file_path, kind) without a pause; bursts of one event are dropped."""
    own = events.withWatermark("ts", delay)
    # a session window needs a key beside it in a stream; this one is the same for all rows
    n = own.groupBy(F.session_window("ts", pause), F.substring("file_path", 1, 0).alias("all")).agg(F.count("*").alias("n"), F.approx_count_distinct("file_path").alias("files"))
    return n.where("n >= 2").select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "files", F.least(F.lit(0.8), 0.3 + 0.05 * F.col("n")).alias("importance"))


def activity_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """(start, tool_name, n): uses of each tool by tumbling (or sliding) event-time window; later rows than the watermark are dropped."""
    own = events.withWatermark("created_at", delay)
    win = F.window("created_at", length, slide) if slide else F.window("created_at", length)
    return own.groupBy(win, "tool_name").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "tool_name", "n")


FLUSH = "key string, n long, first_at timestamp, last_at timestamp"


def capped_bursts(events: DataFrame, pause_seconds: int = 5, cap: int = 50) -> DataFrame:
    """(key, n, first_at, last_at): bursts per key that end after a pause, or as soon as they hold ``cap`` events. events (key, ts)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last = state.get if state.exists else (0, 0, 0)
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], n, pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"))], columns=["key", "n", "first_at", "last_at"])
            return
        times = sorted(int(t.value // 1000) for b in batches for t in b["ts"])
        for t in times:
            if n and (t - last > pause_seconds * 1_000_000 or n >= cap):
                out.append((key[0], n, pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us")))
                n = 0
            first, last, n = (first if n else t), t, n + 1
        state.update((n, first, last))
        state.setTimeoutTimestamp(max(last // 1000 + pause_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "n", "first_at", "last_at"])

    own = events.withWatermark("ts", "1 second")
    return own.groupBy("key").applyInPandasWithState(step, FLUSH, "n long, first long, last long", "append", GroupStateTimeout.EventTimeTimeout)


TRIGGERS = "session_id string, trigger string, subject string"


def session_triggers(events: DataFrame, idle_ms: int = 3_600_000, delay: str = "10 minutes") -> DataFrame:
    """(session_id, trigger, subject), each once a session: three reads in a folder, an edit of a file read before, a failed Bash call after another, a search made twice.

    events (session_id, tool_name, file_path, directory, pattern, failed, ts). State: counters of the session, dropped after ``idle_ms`` of event time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        import json

        seen = json.loads(state.get[0]) if state.exists else {"dirs": {}, "read": [], "searches": {}, "errors": 0, "fired": []}
        out: list[tuple] = []
        last = 0

        def fire(trigger: str, subject: str) -> None:
            tag = f"{trigger}:{subject}"
            if tag not in seen["fired"]:
                seen["fired"].append(tag)
                out.append((key[0], trigger, subject))

        for b in batches:
            last = max(last, int(b["ts"].max().timestamp() * 1000))
            for r in b.sort_values("ts").itertuples(index=False):
                if r.tool_name == "Read":
                    if r.file_path and r.file_path not in seen["read"]:
                        seen["read"].append(r.file_path)
                    if r.directory:
                        n = seen["dirs"][r.directory] = seen["dirs"].get(r.directory, 0) + 1
                        if n >= 3:
                            fire("exploring", r.directory)
                elif r.tool_name in ("Edit", "Write") and r.file_path in seen["read"]:
                    fire("edit_after_read", r.file_path)
                elif r.tool_name in ("Grep", "Glob") and r.pattern:
                    n = seen["searches"][r.pattern] = seen["searches"].get(r.pattern, 0) + 1
                    if n >= 2:
                        fire("repeated_search", r.pattern)
                elif r.tool_name == "Bash" and r.failed:
                    seen["errors"] += 1
                    if seen["errors"] >= 2:
                        fire("debugging", "Bash")
        state.update((json.dumps(seen),))
        last = max(last, state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(last + idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "trigger", "subject"])

    own = events.withWatermark("ts", delay)
    return own.groupBy("session_id").applyInPandasWithState(step, TRIGGERS, "seen string", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_stream(stream: DataFrame, table: str, key: str, version: str, checkpoint: str) -> StreamingQuery:
    """Keep a parquet table of the latest row of each key: each micro-batch is merged into a new folder beside the old one, which the pointer file then names (so a batch that is run again changes nothing)."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = fs.Path(table)
        h = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted((int(s.getPath().getName()[1:]) for s in h.listStatus(root) if s.getPath().getName().startswith("v") and h.exists(fs.Path(s.getPath(), "_SUCCESS"))) if h.exists(root) else [])
        past = [v for v in done if v < epoch]
        both = spark.read.parquet(f"{table}/v{past[-1]}").unionByName(batch) if past else batch
        row = F.max(F.struct(version, *[c for c in batch.columns if c not in (key, version)])).alias("_r")
        both.groupBy(key).agg(row).select(key, "_r.*").select(*batch.columns).write.mode("overwrite").parquet(f"{table}/v{epoch}")
        for v in past[:-1]:
            h.delete(fs.Path(f"{table}/v{v}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def read_upserted(spark: SparkSession, table: str) -> DataFrame:
    """The newest whole version of a table that upsert_stream keeps."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = fs.Path(table)
    h = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(int(s.getPath().getName()[1:]) for s in h.listStatus(root) if s.getPath().getName().startswith("v") and h.exists(fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(f"{table}/v{done[-1]}")
