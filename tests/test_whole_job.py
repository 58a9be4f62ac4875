"""Queries and operators on inputs where a cut of the candidates would show."""

import random
from itertools import combinations

import pytest
from conftest import rows

from mnemora.operators import coactivation, packing
from mnemora.plans import graph_queries, store_queries


def write(spark, folder, **tables):
    """A folder of tables: name to (rows, schema)."""
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def fold(sizes, budget):
    spent, taken = 0, []
    for i, s in enumerate(sizes):
        if spent + s <= budget:
            spent += s
            taken.append(i)
    return taken


def test_first_fit_walks_all(spark):
    r = random.Random(3)
    groups = {g: [r.choice([0, 1, 2, 3, 7, 30, 41, 99]) if r.random() < p else r.randrange(20, 60) for _ in range(1500)] for g, p in ((1, 0.3), (2, 0.01), (3, 0.002))}
    df = spark.createDataFrame([(g, i, s) for g, sizes in groups.items() for i, s in enumerate(sizes)], "g int, o int, s int")
    for budget in (0, 40, 240):
        got = rows(packing.first_fit_taken(df, ["g"], ["o"], "s", budget).select("g", "o"))
        assert got == sorted(((g, i) for g, sizes in groups.items() for i in fold(sizes, budget)), key=str)


def test_inject_fold_behind_rank_256(spark, tmp_path):
    body = {i: "x" * (4 * n) for i, n in enumerate([200] * 300 + [30, 15, 9, 0])}
    data = [(f"n-{i:04}", tier, 1 - i / 1000, b, None, None, None, None, None, None) for tier in ("hot", "warm") for i, b in body.items()]
    data = [(f"{d[1]}-{d[0]}", *d[1:]) for d in data]
    schema = "id string, tier string, relevance double, body string, access_count bigint, valid_from date, valid_to date, last_access date, name string, description string"
    got = {tuple(x) for x in store_queries.q_inject_fold(spark, write(spark, tmp_path, nodes=(data, schema))).collect()}
    sizes = [200] * 300 + [30, 15, 9, 0]
    assert got == {(f"{tier}-n-{i:04}", tier) for tier, budget in (("hot", 240), ("warm", 360)) for i in fold(sizes, budget)}


def test_bridge_keeps_common_entities(spark, tmp_path):
    docs = [(i, "See the NASA note." + (" Also ESA." if i < 2 else "")) for i in range(60)] + [(90, "Only JAXA here."), (91, None)]
    got = rows(store_queries.q_bridge(spark, write(spark, tmp_path, documents=(docs, "doc_id bigint, text string"))))
    assert got == sorted(((i, round(1 / 60 + (0.5 if i < 2 else 0), 8), 2 if i < 2 else 1) for i in range(60)), key=str)


def test_components_of_light_pairs(spark, tmp_path):
    r = random.Random(5)
    pairs = {tuple(r.sample(range(90), 2)) for _ in range(50)}
    data = [(f"n{a:02}" + ".md" * (a % 2), f"n{b:02}", kind, r.choice([1, 2, 25, None]), None, None, 0.5) for a, b in sorted(pairs) for kind in ("coactivation", "mention")]
    data += [("n95", "n96", "mention", 30, None, None, 0.5), ("n97", "n97.md", "coactivation", 30, None, None, 0.5)]
    schema = "src_node string, dst_node string, ref_kind string, occurrence_count bigint, first_seen_at timestamp, last_seen_at timestamp, weight double"
    got = rows(graph_queries.q_components(spark, write(spark, tmp_path, edges=(data, schema))))
    near = {}
    for a, b in pairs:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    for _ in near:
        near = {a: set().union(*(near[b] for b in bs)) for a, bs in near.items()}
    assert got == sorted((f"n{a:02}", f"n{min(bs):02}") for a, bs in near.items())


@pytest.mark.parametrize("most", [3, 16])
def test_neighbourhood_distance_of_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(coactivation, "SUBSETS_UP_TO", most)
    r = random.Random(7)
    records = [(i, sorted(r.sample("abcdefgh", r.choice([1, 1, 2, 3, 4, 6])))) for i in range(70)]
    records += [(100 + i, ["x", "pq"[i % 2]]) for i in range(20)] + [(200, ["lone"]), (201, [])]
    want = {}
    for node in {n for _, ns in records for n in ns}:
        near = [set(ns) - {node} for _, ns in records if node in ns]
        d = [1 - len(x & y) / len(x | y) if x | y else 0.0 for x, y in combinations(near, 2)]
        if d:
            want[node] = (len(d), pytest.approx(sum(d) / len(d)))
    got = coactivation.neighbourhood_distance(spark.createDataFrame(records, "id bigint, nodes array<string>"), "id", "nodes")
    assert {x.node: (x.n, x.distance) for x in got.collect()} == want
    assert want["x"][1] == 100 / 190
