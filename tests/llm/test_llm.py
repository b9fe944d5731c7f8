"""The training-data operators against brute force, round trips and edge cases."""

import datetime as dt
import json
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_rows

from quillon.llm import copies, leakage, mixing, neardup, neighbours, oracles, pieces, queries, ranking, spans, terms
from quillon.llm.common import words

T0 = dt.datetime(2025, 1, 1)
MEM = "id string, content string, tags array<string>, session_id string, importance double, confidence double, access_count int, updated_at timestamp_ntz"


def memories(spark, rows):
    full = [(i, c, None, None, None, None, None, T0) if len(r) == 2 else r for r in rows for i, c in [r[:2]]]
    return spark.createDataFrame(full, MEM)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    same_rows(queries.queries()[name](spark, data), duck, oracles.oracle_sql()[name])


# ---- 1 ----


def test_ranking_by_percentiles(spark):
    r = random.Random(1)
    items = [(g, f"{g}{i:03d}", r.choice([None, float("nan"), 1.0, 2.0, r.random() * 1e6, -r.random()]), float(r.randint(0, 3))) for g in "ab" for i in range(40)]
    df = spark.createDataFrame(items, "g string, k string, s double, t double")
    got = {(x["g"], x["k"]): x["place"] for x in ranking.rank_scores(df, "g", "k", {"s": 1.0, "t": 1.0}).collect()}
    for g in "ab":
        own = [x for x in items if x[0] == g]
        low = lambda v: -1e300 if v is None or v != v else v
        for _, k, s, t in own:
            p = [(sum(low(o[c]) < low(v) for o in own) + sum(low(o[c]) == low(v) for o in own) / 2) / len(own) for c, v in ((2, s), (3, t))]
            assert abs(got[g, k] - sum(p) / 2) < 1e-9


def test_inverse_normal_and_positions(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    out = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(ranking.inverse_normal(F.col("p"))).collect()]
    assert np.allclose(out, [NormalDist().inv_cdf(p) for p in ps], atol=1e-7)
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 1.0), ("g", "c", 5.0), (None, "x", 1.0), ("g", None, 2.0)], "g string, k string, s double")
    r = ranking.rank_scores(df, "g", "k", {"s": 1.0})
    assert {x["k"]: x["position"] for x in ranking.positions(r, "g", "k").collect()} == {"c": 1, "a": 2, "b": 3}
    assert ranking.rank_scores(df.limit(0), "g", "k", {"s": 1.0}).count() == 0


# ---- 2 ----


def test_pieces_give_the_text_again():
    r = random.Random(2)
    for _ in range(400):
        text = "".join(r.choice("ab \n\r\n  cdéf\t") for _ in range(r.randint(0, 200)))
        most, overlap = r.randint(1, 30), r.randint(0, 4)
        found = list(pieces.cut([text], [most], [overlap]))
        if not found:
            assert text == ""
            continue
        assert "".join(text[own:end] for _, _, _, own, end, _ in found) == text
        assert all(size <= most and size == len(re.sub(r"\s", "", text[a:e])) for _, _, a, _, e, size in found)
        assert all(q[2] <= q[3] == p[4] for p, q in zip(found, found[1:]))


def test_overlap_repeats_lines_and_doubling_equals_greedy():
    text = "".join(f"line{i}\n" for i in range(20))
    found = list(pieces.cut([text], [30], [2]))
    for p, q in zip(found, found[1:]):
        assert text[q[2] : q[3]].count("\n") == 2 and text[p[2] : p[4]].endswith(text[q[2] : q[3]])
    at, succ, _, _ = pieces._successors(text, 30, 2)
    place, chain = 0, [0]
    while place < len(at) - 1:
        place = int(succ[place])
        chain.append(place)
    assert chain == np.flatnonzero(pieces._reachable(succ, np.array([0]))).tolist()


def test_split_oversized_cases(spark):
    chunks = spark.createDataFrame([("a", "x y z\n" * 3, 5, "rust", "n"), ("a", "x y z\n" * 3, 5, "rust", "n"), ("b", None, 1, "rust", "n"), ("c", "", 1, None, "n"), ("d", "q" * 50, None, "nope", "n")], "id string, text string, line_start int, lang string, piece string")
    conf = spark.createDataFrame([("rust", 3, 1), ("*", 20, None)], "lang string, max_chunk_size int, overlap_lines int")
    out = pieces.split_oversized(chunks, conf).collect()
    assert sorted({(r["chunk_id"], r["pieces"]) for r in out}) == [("a", 3), ("d", 3)]
    assert {r["line_start"] for r in out if r["chunk_id"] == "a"} == {5, 6, 7}
    assert pieces.split_oversized(chunks.limit(0), conf).count() == 0 and pieces.split_oversized(chunks, conf.limit(0)).count() == 0


# ---- 3 ----


def test_copies_by_format(spark):
    rec = {"Tool": "Bash", "note": "a b", "x": {"p": 1, "q": [1, 2]}}
    rows = [("1", "Hello,  WORLD"), ("2", "hello world!"), ("3", json.dumps(rec)), ("4", json.dumps({"x": {"q": [1, 2], "p": "1"}, "note": "A  b", "tool": "bash"})), ("5", json.dumps({"x": {"q": [2, 1], "p": 1}, "note": "a b", "tool": "bash"})), ("6", "a=1; b=2"), ("7", "b = 2;a=1;"), ("8", "* A: 1\n\n* B: 2"), ("9", "b: 2\na: 1"), ("10", None), ("11", ""), ("12", " .,"), (None, "hello world"), ("13", "{bad json; x=1}"), ("14", "w " * 50_000), ("15", "W, " * 50_000)]
    df = memories(spark, rows)
    got = {r["id"]: (r["rep_id"], r["copies"]) for r in copies.memory_copies(df).collect()}
    assert got["1"] == got["2"] == ("1", 2) and got["3"] == got["4"] == ("3", 2) and got["5"] == ("5", 1)
    # "a=1; b=2" and "A: 1 / B: 2" are one sequence of words, which joins the reordered forms of both shapes
    assert got["6"] == got["7"] == got["8"] == got["9"] == ("6", 4)
    assert got["11"] == got["12"] == ("11", 2) and "10" not in got and got["14"] == got["15"] == ("14", 2)
    assert copies.memory_copies(df.limit(0)).count() == 0


# ---- 4 ----


@pytest.mark.parametrize("crowd", [1, 10_000, 10**9])
@pytest.mark.parametrize("least", [0.5, 0.7, 0.8, 0.9])
def test_anchors_lose_no_pair(least, crowd):
    r = random.Random(5)
    voc = [f"w{i}" for i in range(60)]
    sets = []
    for _ in range(50):
        s = set(r.sample(voc, r.choice([0, 1, 2, 3, 5, 8, 12, 20, 30])))
        sets.append(s)
        for _ in range(4):
            z = set(s)
            for _ in range(r.randint(0, 5)):
                z.symmetric_difference_update({r.choice(voc)})
            sets.append(z)
    sets = list({frozenset(s) for s in sets})
    key, rows = neardup.anchor_rows([list(s) for s in sets], neardup.Tokens(voc[:20], [0.5] * 20, crowd), least)
    key, rows = neardup.unpacked(neardup.packed(key, rows).tobytes())
    names = {}
    for i, s in enumerate(sets):
        if s:
            h = neardup._HASHES.of(sorted(s))
            names.setdefault(tuple(int(x[0]) for x in neardup.sketches(h, np.array([0]))), []).append(i)
    found = set()
    for a1, a2, b1, b2 in neardup.within(key, rows, least).T.tolist():
        found |= {(min(i, j), max(i, j)) for i in names[a1, a2] for j in names[b1, b2]}
    found |= {(i, j) for same in names.values() for i in same for j in same if i < j}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-12}
    assert want <= found


@pytest.mark.parametrize("run", [neardup.RUN, 3])
def test_near_duplicates_equal_brute_force(spark, run):
    r = random.Random(4)
    voc = [f"t{i}" for i in range(80)]
    texts = []
    for _ in range(25):
        s = r.sample(voc, 14)
        texts += [" ".join(s), " ".join(reversed(s)), " ".join(s[:-1] + ["new"]).upper(), " ".join(s[2:]), " ".join(s)]
    df = memories(spark, [(f"m{i:03d}", t) for i, t in enumerate(texts)] + [("n1", None), ("n2", ""), ("n3", "")])
    near = neardup.near_duplicates(df, "id", "content", 0.7, run)
    cls = {x["id"]: bytes(x["class_id"]) for x in near.members.collect()}
    got = {(bytes(x["class_a"]), bytes(x["class_b"])) for x in near.links.collect()}
    want = set()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            x, y = set(words(a)), set(words(b))
            ca, cb = cls[f"m{i:03d}"], cls[f"m{j:03d}"]
            if ca != cb and len(x & y) >= 0.7 * len(x | y):
                want.add((min(ca, cb), max(ca, cb)))
    assert got == want
    g = {x["id"]: x["group_id"] for x in neardup.groups(near).collect()}
    assert len(set(g.values())) == 25 and len(g) == len(texts)


@pytest.mark.parametrize("sizes", [(8, 20), (70, 90), (4000, 4200)])
def test_long_runs_equal_all_comparisons(sizes):
    """Rows of one key, more than a strip of them, at all levels: as every two of them compared."""
    r = np.random.default_rng(2)
    n, least = 700, 0.7
    base = r.integers(0, 1 << 32, (2, 20), np.uint64)
    flip = lambda: np.uint64(1) << r.integers(0, 32, n).astype(np.uint64)
    pick, limit = r.integers(0, 20, n), r.integers(0, 3, n)
    head = np.minimum(limit, r.integers(0, 3, n)) << 14 | np.minimum(r.integers(*sizes, n), 4095) << 2 | limit
    rows = np.stack([head.astype(np.uint64), base[0, pick] ^ flip() ^ flip(), base[1, pick] ^ flip() ^ flip() ^ flip()])
    key, rows = neardup.unpacked(neardup.packed(np.full(n, 7, np.uint64), rows).tobytes())
    i, j = np.triu_indices(n, 1)
    keep = neardup._meet(rows[:, i], rows[:, j], least)
    want = set(map(tuple, neardup._both(rows[:, i[keep]], rows[:, j[keep]]).T.tolist()))
    assert want and set(map(tuple, neardup.within(key, rows, least).T.tolist())) == want
    half = r.random(n) < 0.4
    keep = neardup._meet(rows[:, i], rows[:, j], least) & (half[i] != half[j])
    want = set(map(tuple, neardup._both(rows[:, i[keep]], rows[:, j[keep]]).T.tolist()))
    assert set(map(tuple, neardup.between(rows[:, half], rows[:, ~half], least).T.tolist())) == want


def test_words_of_one_frame_make_no_crowd():
    """Sentences of a few frames: far fewer rows share a key where words that come together fall into unlike parts, and no pair is lost."""
    r = random.Random(6)
    parts = max(m for _, m, _ in neardup.families(46, 0.7))
    head = [f"f{k}w{i}" for i in range(4) for k in range(parts)] + [f"v{i}" for i in range(400)]  # by rank alone a frame is one part
    sets = [frozenset([f"f{k}w{i}" for k in r.sample(range(parts), 4) for i in range(4)] + r.sample(head[4 * parts :], 30)) for _ in range(1500)]
    sets += [s - {max(s)} | {"new"} for s in sets[:200]]
    counts, rank = Counter(w for s in sets for w in s), {w: i for i, w in enumerate(head)}
    shares = [counts[w] / len(sets) for w in head]
    together = neardup._together([[rank[w] for w in s] for s in sets[:1000]], shares)
    compared = []
    for tokens in (neardup.Tokens(head, shares, 100_000), neardup.Tokens(head, shares, 100_000, together)):
        key, rows = neardup.unpacked(neardup.packed(*neardup.anchor_rows([sorted(s) for s in sets], tokens, 0.7)).tobytes())
        run = np.unique(key, return_counts=True)[1]
        compared.append(int((run * (run - 1) // 2).sum()))
    assert compared[1] < compared[0] / 4
    found = set(map(tuple, neardup.within(key, rows, 0.7).T.tolist()))
    name = lambda s: tuple(int(x[0]) for x in neardup.sketches(neardup._HASHES.of(sorted(s)), np.array([0])))
    for a, b in zip(sets[:200], sets[1500:]):
        x, y = sorted([name(a), name(b)])
        assert (*x, *y) in found or x == y


def test_near_duplicates_leave_no_table_of_the_texts(spark):
    """The table of all texts that is read once is gone when the sets stand; words of the head and others are verified alike."""
    from pathlib import Path
    from urllib.parse import urlparse

    from quillon.llm import common

    folder = Path(urlparse(common.shared_folder(spark)).path)
    before = set(folder.iterdir())
    df = memories(spark, [(f"m{i:02d}", " ".join([f"h{k}" for k in range(12)] + [f"é{i // 2}", f"only{i}"])) for i in range(20)] + [("none", None), ("dots", "...")])
    near = neardup.near_duplicates(df, "id", "content", 0.85)
    assert near.links.count() == 10 and near.members.count() == 20
    tables = [spark.read.parquet(str(p)).columns for p in set(folder.iterdir()) - before if p.name.startswith("table-")]
    assert tables and not [c for c in tables if {"seq", "set"} <= set(c)]
    shared = type("Shared", (), {"value": neardup.Tokens(["a", "b"], [0.5, 0.5], 2)})
    batch = pa.RecordBatch.from_pydict({"name": [b"n"] * 3, "words": [b"w"] * 3, "set": ["a\nb\né", "b", "c"]})
    assert [neardup._words_of(c) for c in next(neardup._coded(shared)(iter([batch]))).column(2).to_pylist()] == [{0, 1, "é".encode()}, {1}, {b"c"}]


# ---- 5 ----


def test_similar_vectors_equal_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 16))
    rows = [(f"v{i}-{j}", [float(x) for x in (v + r.normal(size=16) * 0.15) * (j + 1)], "m") for i, v in enumerate(base) for j in range(4)]
    rows += [(f"same{i}", [1.0] * 16, "m") for i in range(12)] + [("zero", [0.0] * 16, "m"), ("none", None, "m"), ("nan", [float("nan")] * 16, "m"), ("short", [1.0] * 3, "m"), ("nomodel", [1.0] * 16, None), rows[0]]
    df = spark.createDataFrame(rows, "memory_id string, embedding array<float>, model string")
    got = {(x["id"], x["other"]) for x in neighbours.similar_vectors(df, "memory_id", "embedding", "model", k=5, least=0.8, block=50, most_cells=1).collect()}
    own = {k: np.array(v, np.float32).astype(float) for k, v, m in rows if m and v and len(v) == 16 and np.any(v) and not np.isnan(v).any()}
    names = sorted(own)
    x = np.array([own[k] / np.linalg.norm(own[k]) for k in names])
    c = np.round(x @ x.T, 9)
    want = {(names[i], names[j]) for i in range(len(names)) for j in sorted((j for j in range(len(names)) if j != i), key=lambda j: (-c[i, j], names[j]))[:5] if c[i, j] >= 0.8}
    assert got == want
    assert neighbours.similar_vectors(df.limit(0), "memory_id", "embedding", "model").count() == 0


def test_all_neighbours_without_a_least_cosine(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(120, 1100))  # more dimensions than one exact slice
    df = spark.createDataFrame([(f"v{i:03d}", [float(a) for a in v], "m") for i, v in enumerate(x)], "memory_id string, embedding array<float>, model string")
    got = {(p["id"], p["other"], p["position"]) for p in neighbours.similar_vectors(df, "memory_id", "embedding", "model", k=3, block=40, most_cells=1).collect()}
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    np.fill_diagonal(c, -9)
    assert got == {(f"v{i:03d}", f"v{j:03d}", n + 1) for i in range(120) for n, j in enumerate(np.argsort(-c[i])[:3].tolist())}
    codes = r.integers(-127, 128, (5, 3000)).astype(np.int8)
    assert (neighbours.products(codes, codes) == codes.astype(np.int64) @ codes.astype(np.int64).T).all()


def test_cells_reach_the_recall(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=(1500, 32))
    rows = [(f"{i}-{j}", [float(x) for x in v + r.normal(size=32) * 0.3], "m") for i, v in enumerate(base) for j in range(2)]
    df = spark.createDataFrame(rows, "memory_id string, embedding array<float>, model string")
    got = {(x["id"], x["other"]) for x in neighbours.similar_vectors(df, "memory_id", "embedding", "model", k=5, least=0.8).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(x @ x.T, 1) >= 0.8)
    hit = [(rows[a][0], rows[b][0]) in got for a, b in zip(i, j)]
    assert len(hit) > 1000 and np.mean(hit) >= 0.9


# ---- 6 ----


def test_terms(spark):
    df = memories(spark, [("a", "x x x rare", ["T ", "t", None, ""], None, None, None, None, T0), ("b", "x common", ["t"], None, None, None, None, T0), ("c", None, None, None, None, None, None, T0), ("d", "", [], None, None, None, None, T0)])
    for share in (0.001, 1.0):
        own = terms.text_terms(df, "id", "content", "content")
        size = spark.createDataFrame([("content", 3)], "field string, n long")
        got = {(r["id"], r["term"]): (r["tf"], r["df"], r["score"]) for r in terms.score_terms(own, size, head_share=share).collect()}
        assert got["a", "x"][:2] == (3, 2) and got["a", "rare"][1] == 1 and got["a", "rare"][2] > got["b", "x"][2]
    tags = {(r["memory_id"], r["term"]): r["tf"] for r in terms.memory_terms(df).where("field = 'tags'").collect()}
    assert tags == {("a", "t"): 2, ("b", "t"): 1}
    assert terms.memory_terms(df.limit(0)).count() == 0


# ---- 7 ----


def test_leaks_equal_brute_force(spark):
    r = random.Random(6)
    voc = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(voc, k=r.choice([5, 15, 30])))) for i in range(12)]
    docs = []
    for d in range(40):
        w = r.choices(voc, k=60)
        k, t = r.choice(items)
        part = t.split()[r.randint(0, 5) :][: r.choice([11, 12, 20])]
        docs.append((d, " ".join(w[:20]) + ", " + "  ".join(part).upper() + "! " + " ".join(w[20:])))
    docs += [(100, None), (101, ""), (102, items[1][1] + " " + items[1][1])]
    D, Q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(50, None), (51, items[1][1])], "item_id long, text string")
    want = set()
    for d, t in docs:
        g = {tuple(words(t)[i : i + 12]) for i in range(len(words(t)) - 11)}
        want |= {(d, k) for k, q in [*items, (51, items[1][1])] if any(tuple(words(q)[i : i + 12]) in g for i in range(len(words(q)) - 11))}
    for size in (leakage.GRAMS_PER_PASS, 20):
        found = leakage.leaked_spans(D, Q, 12, size)
        assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == want
    texts = dict(docs)
    for x in found.collect():
        assert words(texts[x["doc_id"]][x["begin"] : x["end"]]) == words(texts[x["doc_id"]])[x["first_word"] : x["first_word"] + x["words"]]
    clean = leakage.without_spans(D, found, 0.9)
    assert leakage.leaked_spans(clean, Q, 12).count() == 0
    assert leakage.leaked_spans(D.limit(0), Q).count() == 0 and leakage.leaked_spans(D, Q.limit(0)).count() == 0


# ---- 8 ----


def test_mix_reaches_its_shares(spark):
    r = random.Random(8)
    docs = [(i, r.choice([" Big", "big", "small", "tiny", "other", None]), r.randint(50, 150)) for i in range(3000)] + [(9999, "big", 0)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("BIG", 0.3, 2), ("small", 0.5, 4), ("tiny", 0.2, 1), ("absent", 0.0, 3)], "source string, target_share double, max_repeats int")
    plan = mixing.plan_shares(sized, targets)
    p = {x["source"]: x for x in plan.collect()}
    total = sum(t for _, s, t in docs if s and s.strip().lower() in ("big", "small", "tiny"))
    assert p["small"]["reachable"] and p["big"]["reachable"] and p["tiny"]["tokens"] < total and p["absent"]["docs"] == 0
    mix = mixing.mix_sources(sized, plan).collect()
    assert {x["doc_id"] for x in mix} == {x["doc_id"] for x in mixing.mix_sources(sized.repartition(7), plan).collect()}
    for s, cap in (("big", 2), ("small", 4), ("tiny", 1)):
        own = [x for x in mix if x["source"] == s]
        assert max(x["copies"] for x in own) <= cap
        assert abs(sum(x["copies"] * x["tokens"] for x in own) - min(p[s]["target_tokens"], p[s]["most_tokens"])) <= 200
    assert abs(sum(x["share"] for x in mixing.shares_reached(mixing.mix_sources(sized, plan), plan).collect()) - 1) < 1e-9
    assert mixing.mix_sources(sized.limit(0), mixing.plan_shares(sized.limit(0), targets)).count() == 0


def test_mix_found_and_weights(spark):
    r = random.Random(18)
    docs = [(i, "a", 100, 0.0 if i % 4 == 0 else 1.0 if i % 4 < 3 else 3.0) for i in range(4000)] + [(i, "b", 100, 1000.0 if i == 5000 else 1.0) for i in range(5000, 5100)] + [(9000, "c", 50, 1.0)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, tokens long, w double")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.01, 1), ("c", 0.4, 2), ("none", 0.09, 5), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    plan = mixing.plan_shares(sized, targets)
    mix = mixing.mix_sources(sized, plan, weight="w")
    assert {x["source"] for x in mixing.short_of_target(mix, plan).collect()} == {x["source"] for x in plan.where("NOT reachable").collect()} == {"c", "none"}
    got = {x["doc_id"] for x in mix.collect()}
    share = [sum(1 for i, s, _, w in docs if s == "a" and w == v and i in got) / sum(1 for _, s, _, w in docs if s == "a" and w == v) for v in (0.0, 1.0, 3.0)]
    assert share[0] < 0.01 and 0.3 < share[1] < 0.6 and share[2] > 0.9  # 0.205 * (0, 1, 1, 3) of 0.41 a document in all: (0, 0.41, 1.0)
    assert 5000 in got  # too heavy for its share: certain
    half = mixing.plan_shares(sized, targets, budget=1000.0)
    assert {x["source"]: x["target_tokens"] for x in half.collect()}["a"] == 500.0


def test_tokens_are_a_round_trip(spark):
    enc = mixing._encoding(*mixing.public_vocabulary())
    texts = ["Hello, wörld 漢字 <|endoftext|>", "", None, "a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["tokens"] for x in mixing.count_tokens(df, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert enc.decode(ids) == (t or "") and got[i] == len(ids)


# ---- 9 ----


def test_spans_equal_brute_force(spark):
    r = random.Random(9)
    rnd = lambda n: "".join(r.choice("abcdefgh é漢") for _ in range(n))
    shared = [rnd(320), rnd(600), ("xyz" * 200)[:330]]
    docs = [(i, rnd(r.randint(0, 400)) + (r.choice(shared) if i % 3 else rnd(319)) + rnd(r.randint(0, 400))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, docs[1][1]), (102, docs[1][1]), (103, "z" * 2000), (104, "z" * 1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    grams: dict = {}
    for d, t in docs:
        for i in range(len(t or "") - 319):
            grams.setdefault(t[i : i + 320], set()).add(d)
    want = {(a, b) for s in grams.values() for a in s for b in s if a < b}
    found = spans.shared_spans(df, 320)
    rows = found.collect()
    assert {(x["doc_a"], x["doc_b"]) for x in rows} == want
    texts = dict(docs)
    for x in rows:
        assert x["length"] >= 320 and texts[x["doc_a"]][x["begin_a"] :][: x["length"]] == texts[x["doc_b"]][x["begin_b"] :][: x["length"]]
    share = {x["doc_id"]: x["share"] for x in spans.shared_share(df, found).collect()}
    assert share[104] == 1.0 and all(0 < s <= 1 for s in share.values())
    assert spans.shared_spans(df.limit(0)).count() == 0


def test_twins_and_hot_keys_lose_no_pair(spark):
    """Sets with equal sketches, and one boilerplate that all texts share, in blocks of 3 rows and with 5 rows held."""
    base = [f"b{i}" for i in range(12)]
    df = memories(spark, [(f"m{i:02d}", " ".join([*base, f"x{i}"])) for i in range(30)])
    near = neardup.near_duplicates(df, "id", "content", 0.8, 3)
    assert near.links.count() == 30 * 29 // 2
    near = neardup.near_duplicates(df, "id", "content", 0.8)
    degrees = {r["links"] for r in neardup.groups(near).collect()}
    assert degrees == {29}
    two = df.where("id < 'm01'").selectExpr("id", "content", "timestamp_ntz'2025-01-01' AS at").unionByName(df.where("id = 'm05'").selectExpr("'m00' AS id", "content", "timestamp_ntz'2025-02-01' AS at"))
    assert [r["words"] for r in neardup.near_duplicates(two, "id", "content", 0.8, version="at").members.collect()] == [r["words"] for r in near.members.where("id = 'm05'").collect()]
    assert neardup.near_duplicates(df.limit(0), "id", "content").links.count() == 0
