import random

import numpy as np
import pytest

from quillon.operators import graph as G


def frames(spark, nodes, edges):
    n = spark.createDataFrame([(x,) for x in nodes], "id string")
    e = spark.createDataFrame([(a, b, 1.0, "CALLS") for a, b in edges], "src string, dst string, weight double, relationship string")
    return n, e


def scc_of(nodes, edges):
    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a, b in edges:
            for x in nodes:
                if a in reach[x]:
                    reach[x].add(b)
    return {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}


@pytest.fixture(params=[1, 2])
def random_graph(request):
    r = random.Random(request.param)
    nodes = [f"n{i:02d}" for i in range(14)]
    return nodes, [(r.choice(nodes), r.choice(nodes)) for _ in range(20)]


def test_components_and_scc(spark, random_graph):
    nodes, edges = random_graph
    n, e = frames(spark, nodes, edges)
    want = scc_of(nodes, edges)
    assert dict(map(tuple, G.strongly_connected(n, e).collect())) == want
    both = scc_of(nodes, edges + [(b, a) for a, b in edges])
    assert dict(map(tuple, G.components(n, e).collect())) == both


def test_layers(spark, random_graph):
    nodes, edges = random_graph
    n, e = frames(spark, nodes, edges)
    scc, layer = scc_of(nodes, edges), dict(map(tuple, G.topological_layers(n, e).collect()))
    assert set(layer) == set(nodes)
    for a, b in edges:
        assert layer[a] < layer[b] if scc[a] != scc[b] else layer[a] == layer[b]


def test_pagerank_of_a_chain_and_dense_solution(spark, random_graph):
    n, e = frames(spark, ["a", "b", "c"], [("a", "b"), ("b", "c")])
    r = dict(map(tuple, G.pagerank(n, e).collect()))
    assert r["c"] > r["b"] > r["a"] and abs(sum(r.values()) - 1) < 1e-6
    nodes, edges = random_graph
    m = np.zeros((len(nodes),) * 2)
    for a, b in edges:
        m[nodes.index(b), nodes.index(a)] += 1
    out = m.sum(0)
    m = np.where(out > 0, m / np.where(out > 0, out, 1), 1 / len(nodes))
    x = np.full(len(nodes), 1 / len(nodes))
    for _ in range(100):
        x = 0.15 / len(nodes) + 0.85 * m @ x
    got = dict(map(tuple, G.pagerank(*frames(spark, nodes, edges)).collect()))
    assert np.allclose([got[k] for k in nodes], x, atol=1e-5)


def test_betweenness(spark):
    n, e = frames(spark, list("abcde"), [("a", "b"), ("b", "c"), ("c", "d"), ("b", "d"), ("d", "e")])
    b = dict(map(tuple, G.betweenness(n, e).collect()))
    assert b["a"] == b["e"] == b["c"] == 0 and abs(b["b"] - 3 / 12) < 1e-9 and abs(b["d"] - 3 / 12) < 1e-9


def test_two_cliques_are_two_communities(spark):
    left, right = "abcd", "wxyz"
    edges = [(a, b) for s in (left, right) for a in s for b in s if a < b] + [("d", "w")]
    c = dict(map(tuple, G.communities(*frames(spark, left + right, edges)).collect()))
    assert {c[x] for x in left} == {"a"} and {c[x] for x in right} == {"w"}


def test_bfs_path_and_empty(spark):
    n, e = frames(spark, list("abcd"), [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")])
    seed = spark.createDataFrame([("a",)], "id string")
    assert dict(map(tuple, G.bfs(e, seed, 2, "out").collect())) == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert [r["id"] for r in G.shortest_path(e, "a", "d").orderBy("step").collect()] == ["a", "c", "d"]
    assert G.shortest_path(e, "d", "a").count() == 0
    n0, e0 = n.limit(0), e.limit(0)
    assert G.components(n0, e0).count() == G.strongly_connected(n0, e0).count() == G.pagerank(n0, e0).count() == G.betweenness(n0, e0).count() == G.topological_layers(n0, e0).count() == 0


def test_kernel_refuses_what_is_too_large(spark):
    n, e = frames(spark, list("abc"), [("a", "b"), ("b", "c")])
    with pytest.raises(ValueError):
        G.communities(n, e, most_edges=1)


def test_shortest_path_longer_than_64_steps(spark):
    e = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)], "src string, dst string")
    assert G.shortest_path(e, "n000", "n070").count() == 71
