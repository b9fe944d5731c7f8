import datetime as dt

from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import analytics as A
from quillon.operators import consolidate as C
from quillon.operators import enrich as N
from quillon.operators import linking as L
from quillon.operators import records as R
from quillon.operators import review as V
from quillon.operators import temporal as T
from quillon.operators import text as X
from quillon.operators import vectors as H
from quillon.sources import readers
from quillon.sources.tables import latest_by


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tokens_split_code_words(spark):
    df = spark.createDataFrame([("parseHTTPResponse2xx fooBar_baz Überlauf x",)], "t string")
    assert df.select(X.tokens(F.col("t"))).first()[0] == ["parse", "http", "response", "xx", "foo", "bar", "baz", "überlauf"]


def test_bm25_prefers_the_rare_term_and_stays_in_range(spark):
    d = spark.createDataFrame([("a", "loader loader crate"), ("b", "loader"), ("c", "zebra loader"), ("d", None), ("e", "")], "id string, content string")
    q = spark.createDataFrame([("q", "zebra loader"), ("none", "")], "query_id string, query string")
    got = {r["id"]: r["score"] for r in X.bm25(d, q, "id", "content").collect()}
    assert max(got, key=got.get) == "c" and all(0 < s <= 1 for s in got.values()) and "d" not in got
    assert X.bm25(d.limit(0), q, "id", "content").count() == 0


def test_cosine_of_unlike_lengths_and_zero_is_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.select(H.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0]


def test_nearest_in_blocks_equals_one_pass(spark):
    v = spark.createDataFrame([(f"v{i}", [float(i), 1.0]) for i in range(30)] + [("z", None)], "id string, embedding array<float>")
    q = v.where("embedding IS NOT NULL").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    assert rows(H.nearest(v, q, 3)) == rows(H.nearest(v, q, 3, per_pass=7))
    assert H.nearest(v.limit(0), q, 3).count() == 0


def test_pca_of_a_line(spark):
    v = spark.createDataFrame([(str(i), [float(i), 2.0 * i, 0.0]) for i in range(10)], "id string, v array<float>")
    got = [r["c1"] for r in H.pca(v, "id", "v", 2).orderBy(F.col("id").cast("int")).collect()]
    steps = [b - a for a, b in zip(got, got[1:])]
    assert max(steps) - min(steps) < 1e-6 and abs(abs(steps[0]) - 5**0.5) < 1e-6


def test_latest_version_counts_and_null_keys_go(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    df = spark.createDataFrame([("a", t(1), "old"), ("a", t(2), "new"), ("a", t(2), "new"), (None, t(3), "x"), ("b", None, "n")], "id string, updated_at timestamp_ntz, c string")
    assert rows(latest_by(df, "id", "updated_at").select("id", "c")) == [("a", "new"), ("b", "n")]


def test_insert_new_takes_null_namespaces_as_equal(spark):
    t = dt.datetime(2025, 1, 1)
    old = spark.createDataFrame([("a", "x", None, t)], "id string, content string, namespace string, created_at timestamp_ntz")
    new = spark.createDataFrame([("b", "x", None, t), ("c", "x", "n", t), ("d", "x", "n", t)], old.schema)
    assert [r["id"] for r in R.insert_new(old, new).collect()] == ["c"]


def test_forget_decay_and_expiry(spark):
    now = "2025-03-01 00:00:00"
    m = spark.createDataFrame([("a", 0.5, 8, dt.datetime(2025, 1, 29)), ("b", 0.5, None, dt.datetime(2025, 2, 27)), ("c", None, 1, None)], "id string, importance double, access_count int, last_accessed_at timestamp_ntz")
    got = rows(C.decayed(m, now))
    assert got == [("a", round(0.5 * 0.9 ** (31 / 30) * (1 + 0.1 * 3), 9))]


def test_clusters_keep_the_first_tier(spark):
    kind = "id string, namespace string, memory_type string, importance double, tags array<string>"
    m = spark.createDataFrame([("a", "n", "decision", 0.1, ["human-verified"]), ("b", "n", "decision", 0.9, None), ("c", "n", "context", 1.0, []), ("d", "n", "decision", 1.0, ["archived"])], kind)
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d")], "src string, dst string")
    assert rows(C.clusters(m, p).where("keep").select("id")) == [("a",)]
    assert rows(C.clusters(m, p.where("src = 'b' AND dst = 'd'")).where("keep").select("id")) == [("b",)]


def test_ranges_and_extents(spark):
    c = spark.createDataFrame([("s", "f", 1, 100), ("t", "f", 10, 20)], "symbol string, file_path string, line_start int, line_end int")
    lines = spark.createDataFrame([("f", 15), ("f", 99), ("g", 15)], "file_path string, line int")
    assert rows(V.lines_to_ranges(lines, c, slot=8)) == [("f", 15, "s"), ("f", 15, "t"), ("f", 99, "s")]
    spans = spark.createDataFrame([("x", "f", 11, 12), ("y", "f", 11, 50)], "id string, file_path string, line_start int, line_end int")
    assert rows(V.innermost(spans, c, slot=8)) == [("x", "t"), ("y", "s")]


def test_commits(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("COMMIT:h1|p1 p2|Ann|2025-01-02T03:04:05+00:00|Fix it (#12)\nsrc/a.rs\nsrc/b.rs\n\nCOMMIT:h2||dependabot[bot]|2025-01-03T00:00:00+00:00|Bump|x\nCargo.lock\n")
    c = readers.git_log(spark, str(log))
    assert rows(c.select("hash", "author", "subject", F.size("files"))) == [("h1", "Ann", "Fix it (#12)", 2), ("h2", "dependabot[bot]", "Bump|x", 1)]
    assert rows(c.select("hash", T.is_bot())) == [("h1", False), ("h2", True)]
    assert rows(T.pull_requests(c).select("pr", "hash")) == [("12", "h1")]
    nodes, edges = T.ingest_commits(c)
    assert nodes.count() == 1 and edges.count() == 2
    assert rows(N.co_change_pairs(c, 1)) == [("src/a.rs", "src/b.rs", 1, 0.5)]


def test_diff_lines():
    text = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n a\n-b\n+c\n d\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n"
    assert readers.diff_lines(text) == [("x.py", "removed", 2), ("x.py", "added", 2), ("y", "removed", 1)]


def test_manifests_and_specs():
    assert readers.manifest_rows("Cargo.toml", '[package]\nname="q"\nversion="1"\n[dependencies]\nserde={version="2"}\n') == [("package", "q", "1"), ("dependency", "serde", "2")]
    assert readers.manifest_rows("package.json", '{"name":"n","dependencies":{"a":"^1"}}') == [("package", "n", ""), ("dependency", "a", "^1")]
    assert readers.manifest_rows("go.mod", "module ex.com/m\nrequire (\n\tex.com/a v1.2.3\n)\n") == [("package", "ex.com/m", ""), ("dependency", "ex.com/a", "v1.2.3")]
    assert readers.manifest_rows("package.json", "{") == []
    assert readers.spec_rows('{"openapi":"3.0","paths":{"/a/{id}":{"get":{"operationId":"g","summary":"s"}}}}') == [("endpoint", "GET", "/a/{id}", "g", "s")]
    assert readers.spec_rows('{"asyncapi":"3.0.0","channels":{"c":{"address":"x.y"}},"operations":{"o":{"action":"send","channel":{"$ref":"#/channels/c"}}}}') == [("channel", "publish", "x.y", "o", "")]


def test_document_sections(spark):
    assert readers.sections("intro\n## A\nx\n```\n## no\n```\n### B\ny") == [(0, "", "intro"), (1, "A", "## A\nx\n```\n## no\n```"), (2, "B", "### B\ny")]
    df = spark.createDataFrame([("f.yaml", "a: 1\n---\nb: 2")], "file_path string, text string")
    assert rows(readers.document_sections(df)) == [("f.yaml", 0, "", "a: 1"), ("f.yaml", 1, "", "b: 2")]


def test_import_and_export(spark, tmp_path):
    f = tmp_path / "in.jsonl"
    f.write_text('{"content":"x","tags":["a","b"]}\nnot json\n{"id":"1"}\n')
    good, bad = readers.import_jsonl(spark, str(f))
    assert good.count() == 1 and good.first()["memory_type"] == "context" and bad.count() == 2
    for how in ("jsonl", "csv", "markdown"):
        readers.export(good, str(tmp_path / how), how)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["tags"] == "a;b"


def test_matching(spark):
    calls = spark.createDataFrame([("c1", "GET", "http://h/users/12?x=1"), ("c2", None, "/users"), ("c3", "POST", "/users"), ("c4", "GET", "/users/12/posts")], "call_id string, method string, url string")
    ends = spark.createDataFrame([("e1", "GET", "/users/<int:id>"), ("e2", "GET", "/users/")], "endpoint_id string, method string, path string")
    assert rows(L.match_calls(calls, ends)) == [("c1", "e1", 0.9), ("c2", "e2", 0.9), ("c4", "e1", 0.7)]
    p = spark.createDataFrame([("p1", "kafka", "a.b"), ("p2", "kafka", None)], "id string, protocol string, channel string")
    c = spark.createDataFrame([("c1", "kafka", "a.*"), ("c2", "kafka", "a.b"), ("c3", "nats", "a.b"), ("c4", "kafka", None)], p.schema)
    assert rows(L.match_events(p, c)) == [("p1", "c1", 0.8), ("p1", "c2", 0.95)]


def test_resolve_and_fuse(spark):
    names = [("r1", "a::f"), ("r2", "f"), ("r3", "g"), ("r4", "nope"), ("r5", "crate::a::f"), ("r6", "crate::h"), ("r7", "h"), ("r8", "m::h"), ("r9", "z::g"), ("ra", "n::k")]
    ref = spark.createDataFrame([(i, n, "d/x.rs", "call") for i, n in names] + [("im", "b::f", "d/x.rs", "import")], "ref_id string, name string, file_path string, kind string")
    sym = spark.createDataFrame([("a::f", "d/a.rs"), ("b::f", "q/b.rs"), ("c::g", "q/c.rs"), ("l::m::h", "q/c.rs"), ("crate::n::k", "q/k.rs")], "symbol string, file_path string")
    got = {r["ref_id"]: (r["symbol"], r["confidence"]) for r in L.resolve(ref, sym).collect()}
    assert got == {
        "r1": ("a::f", 1.0), "r2": ("a::f", 0.65), "r3": ("c::g", 0.9), "r5": ("a::f", 0.95), "r6": ("l::m::h", 0.85), "r7": ("l::m::h", 0.9),
        "r8": ("l::m::h", 0.8), "r9": ("c::g", 0.7), "ra": ("crate::n::k", 0.9), "im": ("b::f", 1.0),
    }
    hints = spark.createDataFrame([("./a", "import"), ("crate::x", "import"), ("@s/p/q", "import"), ("github.com/a/b", "import"), ("lodash/merge", "import"), ("tokio::sync", "import"), ("requests.api", "import"), ("json", "import"), ("flask", "import"), ("flask", "call")], "name string, kind string")
    assert [r[0] for r in hints.select(L.package_hint()).collect()] == [None, None, "@s/p", "github.com/a/b", "lodash", "tokio", "requests", None, "flask", None]
    e = spark.createDataFrame([("a", "b", "CALLS", 0.6)], "src string, dst string, relationship string, confidence double")
    assert rows(L.fuse_edges(e, e)) == [("a", "b", "CALLS", 1.0, True)]


def test_merge_small_chunks(spark):
    c = spark.createDataFrame([("f", 0, 10, "a"), ("f", 1, 20, "b"), ("f", 2, 100, "c"), ("f", 3, 5, "d")], "file_path string, chunk_index int, size int, text string")
    assert rows(L.merge_small(c, 50, 60).select("first_index", "last_index", "size")) == [(0, 1, 30), (2, 2, 100), (3, 3, 5)]


def test_patterns_report_and_percentiles(spark):
    a = spark.createDataFrame([(i, "s1", "Grep", None, None, "x") for i in range(4)] + [(9, "s2", "Read", "f", "d", None)], "id long, session_id string, tool_name string, file_path string, directory string, pattern string")
    p = A.patterns(a)
    assert ("repeated_search", "x", 4) in {(r["kind"], r["subject"], r["n"]) for r in p.collect()} and "x: 4" in A.pattern_report(p)
    s = spark.createDataFrame([("m", float(i)) for i in range(101)], "name string, v double")
    r = A.latency_percentiles(s, "name", "v").first()
    assert (r["p50"], r["p95"], r["p99"], r["n"]) == (50.0, 95.0, 99.0, 101)
    assert A.patterns(a.limit(0)).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([("src/a/b.rs", "/w", "/w/src/x")], "p string, cwd string, q string")
    r = df.select(S.path_tags(F.col("p")), S.relative_path(F.col("q"), F.col("cwd")), S.directory_of(F.col("p"))).first()
    assert list(r) == [["ext:rs", "dir:a", "file:b.rs"], "src/x", "src/a"]


def test_near_duplicates_are_all_pairs_of_a_namespace_and_kind(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 6))
    own = [(f"m{i:03d}", "n" if i % 3 else None, "decision" if i % 2 else "context", [float(np.float32(x)) for x in base[i % 12] + rng.normal(size=6) * 0.2]) for i in range(120)]
    m = spark.createDataFrame([o[:3] for o in own], "id string, namespace string, memory_type string")
    e = spark.createDataFrame([(o[0], o[3]) for o in own] + [("m000", [1.0, 2.0]), ("m001", None)], "memory_id string, embedding array<float>")
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = sorted((a[0], b[0]) for a in own for b in own if a[0] < b[0] and a[1:3] == b[1:3] and cos(a[3], b[3]) >= 0.92)
    blocks = m.selectExpr("id AS memory_id", "concat(coalesce(namespace, ''), '/', memory_type) AS block")
    assert len(want) > 50 and rows(C.near_duplicates(m, e).select("src", "dst")) == want
    assert rows(C.close_pairs(e, blocks, per_tile=5).select("src", "dst")) == want


def test_clusters_hold_pairs_far_from_any_probe_and_linked_ones(spark):
    from quillon.operators import jobs as J

    t = dt.datetime(2025, 1, 1)
    m = spark.createDataFrame([(i, "n", "context", 0.5, 1, t, t, "x", None) for i in ("a", "b", "c")], "id string, namespace string, memory_type string, importance double, access_count int, last_accessed_at timestamp_ntz, updated_at timestamp_ntz, content string, tags array<string>")
    e = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "memory_id string, embedding array<float>")
    n = spark.createDataFrame([("a", "memory"), ("b", "memory")], "id string, kind string")
    g = spark.createDataFrame([("1", "a", "b", "SHARES_THEME")], "id string, src string, dst string, relationship string")
    probes = spark.createDataFrame([("c", [0.0, 1.0])], "query_id string, vector array<float>")
    assert rows(J.consolidate(m, e, n, g, probes, "2025-01-02 00:00:00")["clusters"].select("id", "component")) == [("a", "a"), ("b", "a")]


def test_o03_links_every_memory(spark, data):
    import numpy as np

    from quillon.plans import catalog
    from quillon.sources.tables import Store

    s = Store(spark, data)
    kind = {r["id"]: (r["memory_type"] or "").strip().lower() for r in s.memories("memory_type").collect()}
    vectors = [(r["memory_id"], r["embedding"]) for r in s.embeddings().where("embedding IS NOT NULL").collect()]
    asked = {}
    for i, v in vectors:
        asked[i] = max(asked.get(i, v), v)
    known = {frozenset((r["src"], r["dst"])) for r in s.edges("src", "dst").collect()}
    cos = lambda a, b: float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))
    want = set()
    for q, v in asked.items():
        score = {}
        for i, x in vectors:
            if i != q and len(x) == len(v):
                score[i] = max(score.get(i, -2.0), cos(x, v))
        near = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:7]
        want |= {frozenset((q, i)) for i, c in near if q in kind and i in kind and c >= (0.5 if kind[q] == kind[i] else 0.35)} - known
    got = {frozenset((r["src"], r["dst"])) for r in catalog.queries()["o03_themes"](spark, data).collect()}
    assert want and got == want


def test_recall_answers_more_than_100_000_queries(spark):
    from quillon.operators.recall import recall

    t = dt.datetime(2025, 1, 1)
    m = spark.createDataFrame([("m", "loader crate", ["x"], 0.5, 0.5, t, t, None)], "id string, content string, tags array<string>, importance double, confidence double, updated_at timestamp_ntz, last_accessed_at timestamp_ntz, expires_at timestamp_ntz")
    n = spark.createDataFrame([("m", "memory", None, None)], "id string, kind string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    e = spark.createDataFrame([], "id string, src string, dst string, weight double, valid_from timestamp_ntz, valid_to timestamp_ntz")
    q = spark.range(100_050).selectExpr("concat('q', id) AS query_id", "'loader' AS query")
    assert recall(m, n, e, q, "2025-01-02 00:00:00").count() == 100_050


def test_summaries_keep_the_whole_contents(spark):
    m = spark.createDataFrame([("b", "two\nmore " + "y" * 200), ("a", "one")], "id string, content string")
    comp = spark.createDataFrame([("a", "a"), ("b", "a")], "id string, component string")
    assert C.summaries(comp, m, least=2).first()["text"] == "one\n---\ntwo\nmore " + "y" * 200
    assert C.summaries(comp, m, least=2, writer=C.first_lines).first()["text"] == "one\ntwo"
    assert C.summaries(comp, m, least=2, writer=lambda c: c[1]["content"]).first()["text"].endswith("y" * 200)


def test_pca_projects_every_model_and_length(spark):
    line = [("m", f"a{i}", [float(i), 2.0 * i, 0.0]) for i in range(10)] + [("n", f"b{i}", [float(i), 0.0, 0.0]) for i in range(4)] + [(None, f"c{i}", [float(i), 1.0]) for i in range(3)]
    v = spark.createDataFrame(line, "model string, id string, v array<float>")
    got = {r["id"]: r for r in H.pca(v, "id", "v", 3, model="model").collect()}
    assert len(got) == 17
    for p, n, step in (("a", 10, 5**0.5), ("b", 4, 1.0), ("c", 3, 1.0)):
        c = [got[f"{p}{i}"]["c1"] for i in range(n)]
        assert all(abs(abs(y - x) - step) < 1e-6 for x, y in zip(c, c[1:]))
    assert got["c0"]["d"] == 2 and got["c0"]["c3"] is None


def test_recall_query_uses_vectors_and_centrality(spark, data):
    from quillon.plans import catalog

    got = catalog.queries()["j05_recall"](spark, data).collect()
    assert any(r["vector"] > 0 for r in got)
    impact = catalog.queries()["j08_recall_with_impact"](spark, data).collect()
    assert impact and any(r["pagerank"] > 0 for r in impact) and "betweenness" in impact[0].asDict()


def test_impact_gives_file_paths_and_values(spark):
    from quillon.operators.recall import with_impact

    found = spark.createDataFrame([("q", "m")], "query_id string, id string")
    n = spark.createDataFrame([("f", "file", "src/a", None), ("s", "function", "go", '{"file_path": "src/b"}')], "id string, kind string, label string, payload string")
    e = spark.createDataFrame([("m", "f"), ("s", "m")], "src string, dst string")
    d = spark.createDataFrame([("m", "context")], "id string, memory_type string")
    ranks, between = spark.createDataFrame([("m", 0.25)], "id string, rank double"), spark.createDataFrame([("m", 0.5)], "id string, betweenness double")
    assert rows(with_impact(found, n, e, d, ranks, between)) == [("q", "m", 0.25, 0.5, ["src/a", "src/b"], [])]


def test_textual_hits_contain_the_query(spark):
    from quillon.operators import jobs as J

    n = spark.createDataFrame([("sym:a::loadShard", "loadShard"), ("sym:b::x", "SHARD"), ("sym:c", "other"), ("file:shard", "shard")], "id string, label string")
    q = spark.createDataFrame([("q1", "shard"), ("q2", "c"), ("q3", "zzz"), ("q4", "")], "query_id string, query string")
    assert rows(J.symbol_hits(n, q, 8)) == [("q1", "sym:a::loadShard", 2), ("q1", "sym:b::x", 1), ("q2", "sym:c", 1)]


def test_h08_takes_other_symbols_for_other_queries(spark, data):
    from quillon.plans import catalog

    got = {}
    for r in catalog.queries()["h08_hybrid_code"](spark, data).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert any("shard" in i.lower() for i in got["q1"]) and got["q1"] != got["q2"]


def test_an_edge_counts_when_it_ends_but_a_node_does_not(spark):
    from quillon.operators.jobs import active_edges

    t = dt.datetime(2025, 1, 2)
    e = spark.createDataFrame([("at", None, t), ("before", None, dt.datetime(2025, 1, 1)), ("later", dt.datetime(2025, 1, 3), None), ("begins", t, None)], "id string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    assert rows(active_edges(e, "2025-01-02 00:00:00").select("id")) == [("at",), ("begins",)]


def test_recall_filters_falls_back_and_expands(spark):
    from quillon.operators.recall import named_memories, recall, recall_expanded

    t = dt.datetime(2025, 1, 1)
    old = dt.datetime(2024, 1, 1)
    m = spark.createDataFrame(
        [("a", "alpha beta", ["x"], "context", "n", 0.5, None), ("b", "gamma", ["beta"], "decision", "n", 0.5, None), ("c", "delta", None, "context", "o", 0.9, None), ("d", "alpha", ["noise"], "context", "n", 1.0, None), ("gone", "alpha", None, "context", "n", 1.0, old)],
        "id string, content string, tags array<string>, memory_type string, namespace string, importance double, expires_at timestamp_ntz",
    )
    from pyspark.sql import functions as F

    m = m.select("*", F.lit(0.5).alias("confidence"), F.lit(t).cast("timestamp_ntz").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("last_accessed_at"), F.lit(None).cast("string").alias("git_ref"))
    kinds = [(i, "memory") for i in "abcd"] + [("gone", "memory"), ("sym:Foo", "function"), ("Foo", "function"), ("ch", "chunk"), ("sym:FooBar", "function")]
    n = spark.createDataFrame([(i, k, None, None, None) for i, k in kinds], "id string, kind string, valid_from timestamp_ntz, valid_to timestamp_ntz, memory_id string")
    e = spark.createDataFrame(
        [("e1", "sym:FooBar", "b", "RELATES_TO", None, None), ("e2", "a", "c", "SHARES_THEME", None, old), ("e3", "a", "b", "LEADS_TO", None, None), ("e4", "b", "ch", "CONTAINS", None, None), ("e5", "ch", "d", "CONTAINS", None, None), ("e6", "sym:FooBar", "d", "RELATES_TO", None, old)],
        "id string, src string, dst string, relationship string, valid_from timestamp_ntz, valid_to timestamp_ntz",
    ).withColumn("weight", F.lit(1.0))
    now = "2025-02-01 00:00:00"
    q = spark.createDataFrame([("q1", "FooBar says"), ("q2", "alpha")], "query_id string, query string")
    assert rows(named_memories(n, e, q, now)) == [("q1", "b")]
    got = recall(m, n, e, q, now, k=2).select("query_id", "position", "id").orderBy("query_id", "position").collect()
    assert [tuple(r) for r in got] == [("q1", 1, "b"), ("q2", 1, "d"), ("q2", 2, "a")]
    some = recall(m, n, e, q, now, namespace="n", exclude_tags=("noise",), memory_type="Context").select("query_id", "id")
    assert rows(some) == [("q1", "a"), ("q2", "a")]
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "memory_id string, embedding array<float>")
    asked = q.where("query_id = 'q2'").withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    near = recall_expanded(m, n, e, asked, now, k=10, depth=1, embeddings=v.where("memory_id = 'a'")).select("id", "path").collect()
    assert {tuple(r) for r in near} == {("a", "direct"), ("b", "via LEADS_TO from a"), ("c", "via graph from a")}
    deep = recall_expanded(m, n, e, asked, now, k=10, depth=3, embeddings=v.where("memory_id = 'a'")).select("id", "path").collect()
    assert {tuple(r) for r in deep} == {("a", "direct"), ("b", "via LEADS_TO from a"), ("c", "via graph from a"), ("d", "via graph from a")}


def test_recall_fallback_equals_a_full_scan(spark, data):
    """The best of all memories, without scoring all of them against all queries."""
    from quillon.operators.recall import Weights, _live, _Scorer, _top, recall
    from quillon.plans import catalog
    from quillon.sources.tables import Store
    from pyspark.sql import functions as F

    s = Store(spark, data)
    m, n, e = catalog._recall_tables(s)
    q = catalog._asked(s)
    got = rows(recall(m, n, e, q, catalog.NOW, k=7).select("query_id", "id", "score"))
    live = _live(m, catalog.NOW, None, None, (), None, None, None)
    every = q.select("query_id").crossJoin(live.select("id")).withColumn("vector", F.lit(0.0))
    full = _top(_Scorer(m, live, n, e, q, catalog.NOW, Weights(), None, None).scored(every).where("score > 0.01"), 7)
    assert got == rows(full.select("query_id", "id", "score"))
