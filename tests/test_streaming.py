import json

import pytest

from quillon.streaming import ingest


@pytest.fixture
def stop(spark):
    queries = []
    yield queries
    for q in queries:
        q.stop()


def feed(spark, tmp_path, name, rows):
    d = tmp_path / name
    d.mkdir(exist_ok=True)
    (d / f"{len(list(d.iterdir()))}.json").write_text("\n".join(json.dumps(r) for r in rows))
    return str(d)


def memory(df, name, stop, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    stop.append(q)
    q.processAllAvailable()
    return q


def test_hooks_come_once(spark, tmp_path, stop):
    one = {"tool_name": "Read", "tool_input": {"file_path": "/w/src/a.rs"}, "tool_response": {"file": {"content": "x"}}, "session_id": "s", "cwd": "/w", "ts": "2025-01-01T00:00:00"}
    d = feed(spark, tmp_path, "hooks", [one, one, {"no": 1}])
    memory(ingest.hook_stream(spark, d), "hooks", stop)
    got = spark.table("hooks").collect()
    assert [(r["session_id"], r["tool_name"], r["file_path"], r["directory"], r["response"]) for r in got] == [("s", "Read", "src/a.rs", "src", "x")]


def test_session_triggers(spark, tmp_path, stop):
    base = {"session_id": "s", "file_path": None, "directory": None, "pattern": None, "failed": False}
    ev = [base | {"tool_name": "Read", "file_path": f"d/{i}", "directory": "d", "ts": f"2025-01-01T00:00:0{i}"} for i in range(4)]
    ev += [base | {"tool_name": "Edit", "file_path": "d/1", "ts": "2025-01-01T00:00:05"}, base | {"tool_name": "Grep", "pattern": "x", "ts": "2025-01-01T00:00:06"}, base | {"tool_name": "Grep", "pattern": "x", "ts": "2025-01-01T00:00:07"}]
    ev += [base | {"tool_name": "Bash", "failed": True, "ts": f"2025-01-01T00:00:1{i}"} for i in range(3)]
    schema = "session_id string, tool_name string, file_path string, directory string, pattern string, failed boolean, ts timestamp"
    s = spark.readStream.schema(schema).json(feed(spark, tmp_path, "ev", ev))
    memory(ingest.session_triggers(s), "triggers", stop, "append")
    got = {(r["trigger"], r["subject"]) for r in spark.table("triggers").collect()}
    assert got == {("exploring", "d"), ("edit_after_read", "d/1"), ("repeated_search", "x"), ("debugging", "Bash")}


def test_bursts(spark, tmp_path, stop):
    d = feed(spark, tmp_path, "b", [{"key": "k", "ts": f"2025-01-01T00:00:{i:02d}"} for i in (0, 1, 2, 20, 21)])
    s = spark.readStream.schema("key string, ts timestamp").json(d)
    memory(ingest.capped_bursts(s, 5, 50), "bursts", stop)
    assert (3, "00:00:00", "00:00:02") in [(r["n"], f"{r['first_at']:%H:%M:%S}", f"{r['last_at']:%H:%M:%S}") for r in spark.table("bursts").collect()]


def test_watch_batches_and_windows(spark, tmp_path, stop):
    rows = [{"ts": f"2025-01-01T00:00:0{i}", "file_path": f"f{i}", "kind": "modify"} for i in range(3)] + [{"ts": "2025-01-01T00:10:00", "file_path": "z", "kind": "modify"}]
    s = spark.readStream.schema("ts timestamp, file_path string, kind string").json(feed(spark, tmp_path, "w", rows))
    memory(ingest.watch_batches(s), "watch", stop)
    assert [(r["n"], round(r["importance"], 2)) for r in spark.table("watch").collect()] == [(3, 0.45)]


def test_upsert_keeps_the_latest(spark, tmp_path, stop):
    d = feed(spark, tmp_path, "u", [{"id": "a", "v": 1, "x": "old"}, {"id": "b", "v": 1, "x": "b"}])
    table, check = str(tmp_path / "t"), str(tmp_path / "c")
    s = spark.readStream.schema("id string, v int, x string").json(d)
    q = ingest.upsert_stream(s, table, "id", "v", check)
    stop.append(q)
    q.processAllAvailable()
    feed(spark, tmp_path, "u", [{"id": "a", "v": 2, "x": "new"}, {"id": "b", "v": 0, "x": "late"}])
    q.processAllAvailable()
    got = ingest.read_upserted(spark, table).select("id", "x").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", "new"), ("b", "b")]
