"""The store object end to end."""

import datetime as dt

import pytest
from conftest import rows

from mnemora import api


@pytest.fixture(scope="module")
def store(spark):
    schema = "id string, name string, description string, type string, tier string, material_grade string, runtime string, target_state string, chains array<string>, valid_from date, valid_to date, last_access date, relevance double, salience double, stc_capture_score double, stc_capture_at double, body string"
    day = dt.date(2020, 1, 1)
    node = lambda i, chain, rel=0.6, **k: (i, f"Name {i}", "", k.get("type", "note"), "warm", "natural", k.get("runtime"), "live", chain, day, k.get("to"), day, rel, 0.0, None, None, "body of " + i * 20)
    nodes = spark.createDataFrame([node("a", ["c1"]), node("b", ["c1", "c2"], type="fact"), node("d", ["c2"], to=dt.date(2020, 2, 1)), node("e", [], 0.2, runtime="side")], schema)
    edges = spark.createDataFrame([("c1", "a", "b", day, None), ("c2", "b", "d", None, dt.date(2020, 1, 5))], "chain string, src string, dst string, valid_from date, valid_to date")
    web = spark.createDataFrame([("a", "e", 0.9), ("b", "d", 0.3)], "a string, b string, w double")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("d", [0.0, 1.0]), ("e", [-1.0, 0.0])], "id string, embedding array<double>")
    return api.MemoryStore(nodes, edges, web, vectors)


def test_reads(store):
    assert [r.id for r in store.search([1.0, 0.0], 2).collect()] == ["b", "a"]
    assert [r.id for r in store.search([1.0, 0.0], 2, term="name d").collect()] == ["d", "b"]
    assert [(r.id, r.source) for r in store.search([1.0, 0.0], 1, neighbours=True).collect()] == [("b", "vector"), ("d", "neighbour")]
    assert [r.id for r in store.search([1.0, 0.0], 8, runtime="side").collect()] == ["e"]
    assert [r.id for r in store.temporal_query(at="2020-03-01").collect()] == ["a", "b", "e"]
    assert [r.id for r in store.temporal_query(at="2020-03-01", vector=[0.0, 1.0], k=1).collect()] == ["b"]
    taken = {r.node for r in store.retrieve([1.0, 0.0], budget=18).where("taken").collect()}
    assert taken == {"a", "b"}
    assert rows(store.chain_at("c1", "2020-06-01").select("node")) == [("a",), ("b",)]
    assert rows(store.traverse("c1", "a", "2020-06-01")) == [("a", 0), ("b", 1)]
    assert rows(store.snapshot("2020-06-01")) == [("c1", 1, 1), ("c2", 0, 1)]


def test_changes(spark, store, tmp_path):
    ids = spark.createDataFrame([("b",)], "id string")
    less = store.forget(ids)
    assert {r.id for r in less.nodes.collect()} == {"a", "d", "e"} and less.edges.count() == 0 and less.web.count() == 1 and less.vectors.count() == 3
    assert rows(less.restore(ids).nodes) == rows(store.nodes)
    old = store.decay("2020-06-01", 1590969600.0)
    assert {r.id: r.tier for r in old.nodes.collect()}["e"] == "frozen" and old.archive.count() == 1
    closed = store.supersede(spark.createDataFrame([("a", "b")], "old_id string, new_id string"), "2020-03-03")
    assert closed.read_node("a").first().valid_to == dt.date(2020, 3, 3)
    path = str(tmp_path / "v1")
    less.save(path)
    again = api.MemoryStore.load(spark, path)
    assert rows(again.nodes) == rows(less.nodes) and again.archive.count() == 1
    more = again.ingest(store.nodes.where("id = 'b'"), store.vectors.where("id = 'b'"))
    assert more.nodes.count() == 4 and more.vectors.count() == 4


def test_registry(store):
    assert "search" in api.operations()
    assert rows(api.run("snapshot", store, "2020-06-01")) == rows(store.snapshot("2020-06-01"))
    with pytest.raises(KeyError):
        api.run("nothing")
