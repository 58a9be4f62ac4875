"""Graph, retrieval, packing, state, lifecycle and co-activation operators on small tables."""

import datetime as dt
import math
import random
from itertools import combinations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from mnemora.functions import scores as S
from mnemora.operators import chains, coactivation, dedup, evaluate, graph, lifecycle, packing, retrieval, state


def test_walk_on_a_path(spark):
    pairs = spark.createDataFrame([("h", "m", 1.0), ("m", "t", 1.0)], "a string, b string, w double")
    k = graph.row_normalized(graph.both_ways(pairs))
    start = graph.seeds(spark.createDataFrame([("h", 1.0)], "node string, score double"))
    need = {r.node: r.need for r in graph.discounted_walk(k, start).collect()}
    assert need == {"h": 1.125, "m": 0.625, "t": 0.125}
    longer = spark.createDataFrame([("h", "a", 1.0), ("a", "b", 1.0), ("b", "t", 1.0)], "a string, b string, w double")
    need = {r.node: r.need for r in graph.discounted_walk(graph.row_normalized(graph.both_ways(longer)), start).collect()}
    assert (need["a"], need["b"], need["t"]) == (0.59375, 0.125, 0.03125)
    flat = graph.seeds(spark.createDataFrame([("x", -1.0), ("y", 0.0)], "node string, score double"))
    assert rows(flat) == [("x", 0.5), ("y", 0.5)]


def test_components(spark):
    r = random.Random(2)
    edges = [(f"n{r.randrange(400):03}", f"n{r.randrange(400):03}") for _ in range(260)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(120)] + [("n001", "n001"), (None, "n002"), ("p000", "p001")]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = rows(graph.connected_components(spark.createDataFrame(edges, "src string, dst string")))
    assert got == sorted((n, root(n)) for n in parent)
    assert graph.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_reach_cap_scale(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c"), ("c", "a")], "src string, dst string")
    got = graph.reachable(e, spark.createDataFrame([("a",)], "node string"), 2)
    assert rows(got) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    star = [("hub", f"x{i:03}", 1.0 + i % 7) for i in range(200)]
    df = spark.createDataFrame(star, "a string, b string, w double")
    kept = rows(graph.degree_cap(df, 10))
    assert kept == sorted(sorted(star, key=lambda t: (t[2], t[0], t[1]), reverse=True)[:10])
    scaled = graph.scale_down(df, 4.0).agg(F.sum("scaled")).first()[0]
    assert scaled == pytest.approx(4.0)


def test_first_fit_and_prefix(spark):
    sizes = [(1, i, s) for i, s in enumerate([5, 9, 4, 0, 3, 2])] + [(2, 0, 50)]
    df = spark.createDataFrame(sizes, "g int, o int, s int")
    taken = {(r.g, r.o) for r in packing.first_fit(df, ["g"], ["o"], "s", 12).where("taken").collect()}
    assert taken == {(1, 0), (1, 2), (1, 3), (1, 4)}
    assert [r.o for r in packing.prefix_budget(df.where("g = 1"), [], ["o"], "s", 14).orderBy("o").collect()] == [0, 1]
    assert [(r.g, r.o) for r in packing.prefix_budget(df, ["g"], ["o"], "s", 14).orderBy("g", "o").collect()] == [(1, 0), (1, 1)]
    many = spark.createDataFrame([(1, i, 5 + i % 7) for i in range(20_000)], "g int, o int, s int")
    spent, want = 0, set()
    for i in range(20_000):
        if spent + 5 + i % 7 <= 120:
            spent += 5 + i % 7
            want.add(i)
    walked = packing.first_fit(many, ["g"], ["o"], "s", 120)
    assert walked.count() == 20_000 and {r.o for r in walked.where("taken").collect()} == want


def test_state(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 2, "y"), ("b", None, "z"), ("b", 0, "w")], "k string, t int, v string")
    assert rows(state.latest_per_key(log, ["k"], ["t"])) == [("a", 2, "y"), ("b", 0, "w")]
    assert rows(state.latest_per_key(log, ["k"], ["t"], newest=False)) == [("a", 1, "x"), ("b", 0, "w")]
    cur = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "k string, n int, s string")
    new = spark.createDataFrame([("b", 5, "new"), ("c", 7, "new")], "k string, n int, s string")
    out = state.upsert(cur, new, ["k"], {"n": F.col("cur.n") + F.col("new.n")})
    assert rows(out) == [("a", 1, "old"), ("b", 7, "old"), ("c", 7, "new")]
    v = spark.createDataFrame([("u", i, x) for i, x in enumerate([True, True, None, True, False, True])], "k string, i int, v boolean")
    assert [r.run for r in state.runs(v, ["k"], ["i"], F.col("v")).orderBy("i").collect()] == [1, 2, None, 3, 1, 1]
    t = spark.createDataFrame([("u", 0), ("u", 10), ("u", 3700), ("w", 5)], "k string, t int")
    assert rows(state.rate_limited(t, ["k"], "t", 3600)) == [("u", 0), ("u", 3700), ("w", 5)]


def test_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    g = np.random.default_rng(0)
    x = g.standard_normal((300, 6))
    x[17] = 0
    x[40] = x[41]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id bigint, embedding array<double>")
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    s = u @ u.T
    want = set()
    for q in range(0, 300, 20):
        order = sorted((j for j in range(300) if j != q), key=lambda j: (-s[q, j], j))[:4]
        want |= {(q, j) for j in order}
    got = retrieval.search(df.where("id % 20 = 0"), df, 4).collect()
    assert {(r["query"], r["item"]) for r in got} == want
    above = {(r["query"], r["item"]) for r in retrieval.search(df.where("id % 20 = 0"), df, None, 0.8).collect()}
    assert above == {(q, j) for q in range(0, 300, 20) for j in range(300) if j != q and s[q, j] >= 0.8}
    top = [r.id for r in retrieval.top_k(df, x[3].tolist(), 5, where=F.col("id") != 3).collect()]
    assert top == sorted((i for i in range(300) if i != 3), key=lambda i: (-(x[i] @ x[3]), i))[:5]
    assert retrieval.search(df.limit(0), df, 3).count() == 0


def test_context_bank(spark):
    g = np.random.default_rng(1)
    ev = [("a", float(t), g.standard_normal(4).tolist()) for t in (0, 0, 3600, 90000)] + [("b", 5.0, [0.0] * 4)]
    got = {r.k: np.array(r.bank) for r in retrieval.context_bank(spark.createDataFrame(ev, "k string, t double, q array<double>"), "k", "t", "q", 4).collect()}
    tau, bank, last = np.array(retrieval.CONTEXT_TAUS), np.zeros((6, 4)), None
    unit = lambda v: v / np.linalg.norm(v)
    for t in (0.0, 3600.0, 90000.0):
        q = unit(sum(unit(np.array(e[2])) for e in ev if e[0] == "a" and e[1] == t))
        rho = np.zeros(6) if last is None else np.exp(-(t - last) / tau)
        bank = np.array([unit(r * b + math.sqrt(1 - r * r) * q) for r, b in zip(rho, bank)])
        last = t
    assert np.allclose(got["a"], bank) and np.allclose(got["b"], 0)


def test_weight_fold(spark):
    at = lambda d, h=0: dt.datetime(2020, 1, 1) + dt.timedelta(days=d, hours=h)
    ev = [("a", "b", at(i), "genuine") for i in range(3)] + [("c", "d", at(i), "replay") for i in range(200)]
    ev += [("e", "f", at(0), None)] + [("e", "f", at(i), "replay") for i in range(1, 60)] + [("g", "h", at(i), "genuine") for i in range(2)]
    got = {(r.a, r.b): r for r in coactivation.weight_fold(spark.createDataFrame(ev, "a string, b string, at timestamp, source string"), "at", "source").collect()}
    assert got["a", "b"].w == pytest.approx(0.855) and got["a", "b"].count_genuine == 3
    assert got["c", "d"].w <= 0.83 and got["c", "d"].last_seen is None and got["c", "d"].count_replay == 200
    assert got["e", "f"].w <= 0.83 and got["e", "f"].last_seen == at(0)
    assert got["g", "h"].w < 0.85


def test_accrue_daily_run_gets_strong(spark):
    day = 86400
    t = [("s", "genuine", "a", "b", d * day, 3) for d in range(5)] + [("s", "genuine", "a", "c", 0, 3)]
    touches = spark.createDataFrame([(f"{s}{i}", at, p, a, b, m) for i, (s, p, a, b, at, m) in enumerate(t)], "id string, at bigint, provenance string, a string, b string, m bigint")
    sal = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.9)], "node string, salience double")
    got = {(r.a, r.b): r for r in coactivation.accrue(touches, sal, "id", "at", "provenance", 5.0 * day).collect()}
    assert got["a", "b"].tier == "strong" and got["a", "b"].qualified == 5 and got["a", "b"].reps == 5
    assert got["a", "c"].tier == "none" and got["a", "c"].strength < 1


def test_accrue_credits_and_outcomes(spark):
    """Credit inside a day lifts a burst to weak and never to strong; an outcome lifts by its channel."""
    burst = [(f"s{i}", 3600 * i, "genuine", "a", b, 3) for i in range(12) for b in ("b", "c")]
    touches = spark.createDataFrame(burst, "id string, at bigint, provenance string, a string, b string, m bigint")
    sal = spark.createDataFrame([(n, 0.9) for n in "abc"], "node string, salience double")
    run = lambda **k: {r.b: r for r in coactivation.accrue(touches, sal, "id", "at", "provenance", 86400.0 * 0.9, **k).collect()}
    plain = run()
    more = run(credits=spark.createDataFrame([("a", "b", 0.6)], "a string, b string, credit double"))
    assert plain["b"].strength < more["b"].strength < 3 and more["c"].strength == plain["c"].strength
    out = lambda c, n: spark.createDataFrame([("a", "b", 1, n, c, 0.0)], "a string, b string, sign int, n int, channel string, age_s double")
    auto, human, none = run(outcomes=out("AUTO", 4)), run(outcomes=out("HUMAN", 4)), run(outcomes=out("AUTO", 0))
    assert none["b"].strength == plain["b"].strength and auto["c"].strength == plain["c"].strength
    share = max(0.25, plain["b"].strength / 6)
    assert auto["b"].strength == pytest.approx(plain["b"].strength + 0.15 * share * 3, abs=0.05) and auto["b"].strength < 3
    assert human["b"].strength > auto["b"].strength and human["b"].reps == plain["b"].reps + 3


def test_similar_pairs(spark):
    r = random.Random(8)
    vocabulary = [f"word{i}" for i in range(80)]
    data = [(g, f"k{g}{i}", " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 15)))) for g in "xy" for i in range(60)]
    got = {(x.g, x.a, x.b) for x in dedup.similar_pairs(spark.createDataFrame(data, "g string, k string, t string"), "g", "k", "t", 0.15).collect()}
    want = set()
    for (g, a, s), (h, b, t) in combinations(data, 2):
        u, v = set(s.split()), set(t.split())
        if g == h and u | v and len(u & v) / len(u | v) >= 0.15:
            want.add((g, min(a, b), max(a, b)))
    assert got == want


def test_chain_edges(spark):
    e = spark.createDataFrame([(1, "c", "a", "b", None, None, 0.5), (2, "c", "a", "b", dt.date(2020, 1, 1), None, 0.6), (3, "c", "b", "d", dt.date(2020, 1, 1), dt.date(2020, 2, 1), 0.7)], "edge_id bigint, chain string, src string, dst string, valid_from date, valid_to date, confidence double")
    m = spark.createDataFrame([("c", x) for x in "abdz"] + [("lone", "q")], "chain string, node string")
    assert rows(chains.members_at(m, e, "2021-01-01")) == [("c", "a"), ("c", "b"), ("lone", "q")]
    assert rows(chains.snapshot(e, "2019-12-31")) == [("c", 1, 3)]
    closed = chains.close_edges(e, spark.createDataFrame([("c", "a", "b")], "chain string, src string, dst string"), "2020-03-01")
    assert closed.where("valid_to = date'2020-03-01'").count() == 2
    change = spark.createDataFrame([("c", "a", "b", None, dt.date(2022, 1, 1), 0.9), ("c", "z", "a", None, None, 0.1)], "chain string, src string, dst string, valid_from date, valid_to date, confidence double")
    out = chains.set_edge(e, change)
    assert out.count() == 4 and out.where("edge_id = 2").first().confidence == 0.9 and out.where("edge_id = 1").first().confidence == 0.5
    added = chains.add_edges(e, m, change.withColumn("src", F.when(F.col("src") == "z", "nobody").otherwise(F.col("src"))))
    assert added.count() == 4


def test_lifecycle_round_trip(spark):
    n = spark.createDataFrame([("a", 3, "x" * 40, "live", 0.2), ("b", 1, "y" * 40, "frozen", 0.3), ("c", 1, None, None, None)], "id string, access_count bigint, body string, target_state string, integrity double")
    none = spark.createDataFrame([], "src string, dst string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "zz")], "src string, dst string")
    gone = spark.createDataFrame([("a",), ("nobody",), (None,)], "id string")
    f = lifecycle.forget(n, e, none, gone)
    assert rows(f.nodes.select("id")) == [("b",), ("c",)] and rows(f.chain_edges) == [("b", "c"), ("c", "zz")] and f.archive.count() == 1
    back = lifecycle.restore(f.nodes, f.archive, gone)
    assert rows(back) == rows(n) and rows(lifecycle.restore(back, f.archive, gone)) == rows(n)
    assert rows(lifecycle.check_writable(n).select("id", "writable")) == [("a", True), ("b", False), ("c", True)]
    anchors = lifecycle.capture_anchors(spark.createDataFrame([("a", "old")], "id string, anchor string"), n)
    assert rows(anchors) == [("a", "old"), ("b", "y" * 40)]
    fixed = {r.id: r for r in lifecycle.repair(n, anchors, 0.5).collect()}
    assert fixed["a"].body == "old" and fixed["a"].integrity == pytest.approx(0.6) and fixed["c"].integrity is None


def test_scorers(spark):
    ranking = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 5)], "q string, i string, rank int")
    gold = spark.createDataFrame([("q1", "b"), ("q2", "c"), ("q3", "z")], "q string, i string")
    r = evaluate.ranks(ranking, gold, "q", "i")
    assert dict(evaluate.recall_at(r, [1, 2, 5]).collect()) == pytest.approx({1: 0.0, 2: 1 / 3, 5: 2 / 3})
    assert evaluate.mean_reciprocal_rank(r).first()[0] == pytest.approx((0.5 + 0.2) / 3)
    order = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("u", 1, "b"), ("u", 2, "a")], "t string, o int, v string")
    assert rows(evaluate.order_agreement(order, "t", "o", "v")) == [("t", True), ("u", False)]
    pool = spark.createDataFrame([("x", 10.0), ("y", 10.0), ("z", None)], "k string, s double")
    assert rows(retrieval.distinctiveness(pool, "k", "s")) == [("x", 0.0), ("y", 0.0), ("z", 0.0)]
    spread = spark.createDataFrame([("x", 1.0), ("y", math.e)], "k string, s double")
    assert [r[1] for r in rows(retrieval.distinctiveness(spread, "k", "s"))] == pytest.approx([1 / (1 + math.exp(-1))] * 2)
    assert S.EMA == pytest.approx(0.474641, abs=1e-6)


def test_search_many_queries(spark):
    """More queries than a block by far, against all rows; two of them checked one by one."""
    r = np.random.default_rng(5)
    q, x = r.normal(size=(50_000, 8)), r.normal(size=(2_500, 8))
    frame = lambda m, first: spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(m)], "id bigint, embedding array<double>")
    found = retrieval.search(frame(q, 0), frame(x, 10**6), 3)
    assert found.count() == 3 * len(q)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in (7, 49_999):
        want = (10**6 + np.argsort(-(unit(x) @ unit(q)[i]))[:3]).tolist()
        assert [w.item for w in found.where(f"query = {i}").orderBy("rank").collect()] == want


def test_vector_index(spark):
    """Only changed texts are embedded again, vanished ones go, hidden ones are not found, and the folder tells it all."""
    from mnemora.operators.index import VectorIndex, hashed_embedding

    texts = lambda rows: spark.createDataFrame(rows, "id string, text string")
    index = VectorIndex.open(spark).build(texts([("a", "the red boat"), ("b", "a blue hill"), ("c", None)]))
    assert index.info() == {"rows": 3, "dim": 384, "version": 1}
    now = texts([("a", "the red boat"), ("b", "a green hill"), ("d", "four")])
    assert dict(index.status(now).collect()) == {"a": "keep", "b": "embed", "c": "drop", "d": "embed"}
    index.build(now)
    ask = texts([("q", "the red boat")]).select(hashed_embedding()("text").alias("v")).first().v
    assert index.top_k(ask, 1).first().id == "a"
    index.tombstone(texts([("a", "")]))
    again = VectorIndex.open(spark, index.path)
    assert again.info() == {"rows": 3, "dim": 384, "version": 2} and "a" not in {r.id for r in again.top_k(ask, 3).collect()}
    assert again.untombstone(texts([("a", "")])).top_k(ask, 1).first().id == "a"
    assert VectorIndex.open(spark).build(texts([])).info()["rows"] == 0
