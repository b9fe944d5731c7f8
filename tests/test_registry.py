"""Writes across tables, the registry and the API surface on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from quillon.operators import registry as Y
from quillon.operators import review as V
from quillon.operators import text as X

T0 = dt.datetime(2025, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_client_calls_and_endpoints(spark):
    refs = spark.createDataFrame([("1", "requests.get", "call"), ("2", "axios.postForm", "call"), ("3", "fetch", "call"), ("4", "http.Get", "call"), ("5", "requests.get", "import"), ("6", "self.fetcher", "call"), ("7", None, "call")], "ref_id string, name string, kind string")
    assert rows(Y.client_calls(refs).fillna("-")) == [("1", "requests", "GET"), ("2", "axios", "POST"), ("3", "fetch", "-"), ("4", "net/http", "GET")]
    marks = [("a", ['@app.route("/users/<int:id>", methods=["POST"])']), ("b", ["@router.get('/x/')"]), ("c", ['@GetMapping("/y/:id")']), ("d", ['@Delete("/z")']), ("e", ["@cached", None]), ("f", None), ("g", ['@app.route("/any")'])]
    got = rows(Y.declared_endpoints(spark.createDataFrame(marks, "symbol string, attributes array<string>")))
    assert got == [("a", "POST", "/users/{id}"), ("b", "GET", "/x"), ("c", "GET", "/y/{id}"), ("d", "DELETE", "/z"), ("g", "ANY", "/any")]


def test_store_with_links(spark):
    m = spark.createDataFrame([("a", "one", "n", T0)], "id string, content string, namespace string, created_at timestamp_ntz")
    new = spark.createDataFrame([("b", "two", None, T0), ("c", "one", "n", T0), ("d", "two", None, T0)], m.schema)
    n = spark.createDataFrame([("a", "memory", "one", "a", "n"), ("f", "file", None, None, None)], "id string, kind string, label string, memory_id string, namespace string")
    e = spark.createDataFrame([], "id string, src string, dst string, relationship string, weight double")
    links = spark.createDataFrame([("b", "f"), ("b", "f"), ("b", "nothing"), ("c", "f")], "id string, target string")
    out = Y.store_with_links(m, n, e, new, links)
    assert rows(out["memories"].select("id")) == [("a",), ("b",)]
    assert rows(out["graph_nodes"].select("id", "kind")) == [("a", "memory"), ("b", "memory"), ("f", "file")]
    assert rows(out["graph_edges"].select("id")) == [("b-RELATES_TO-f",)]
    none = Y.store_with_links(m.limit(0), n.limit(0), e, new.limit(0), links.limit(0))
    assert all(df.count() == 0 for df in none.values())


def test_overlaps_cross_slots(spark):
    r = spark.createDataFrame([("s", "f", 60, 70), ("t", "f", 128, 128), ("u", "g", 1, 500)], "symbol string, file_path string, line_start int, line_end int")
    c = spark.createDataFrame([("x", "f", 1, 60), ("y", "f", 70, 200), ("z", "f", 71, 127)], "id string, file_path string, line_start int, line_end int")
    assert rows(V.overlapping(c, r)) == [("x", "s"), ("y", "s"), ("y", "t")]


def test_texts_outside_the_collection_score_as_inside(spark):
    docs = spark.createDataFrame([("a", "alpha beta beta"), ("b", "beta"), ("c", "gamma delta"), ("d", None), ("e", "")], "id string, content string")
    q = spark.createDataFrame([("q", "beta gamma zzz"), ("none", "")], "query_id string, query string")
    inside = rows(X.bm25(docs, q, "id", "content").select("query_id", "id", F.round("score", 9)))
    assert rows(Y.score_texts(docs, q, docs, "id", "content").select("query_id", "id", F.round("score", 9))) == inside and len(inside) == 3


def test_counts_and_existence(spark):
    a = spark.createDataFrame([(1, "s", "Read", "d", None), (2, "s", "Read", "d", None), (3, "s", "Grep", None, "p"), (4, "t", "Glob", None, "q"), (5, "t", "Glob", None, "q"), (6, "t", "Grep", None, "p"), (7, None, "Read", "d", None)], "id long, session_id string, tool_name string, directory string, pattern string")
    assert rows(Y.directory_reads(a)) == [("s", "d", 2)]
    assert rows(Y.patterns_elsewhere(a, "s")) == [("q",)] and rows(Y.patterns_elsewhere(a, "nobody", 2)) == [("p",), ("q",)]
    k = spark.createDataFrame([("x",), ("y",), ("x",)], "id string")
    assert rows(Y.exists(k, k.where("id = 'x'"))) == [("x", True), ("y", False)]
