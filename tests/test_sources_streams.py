"""Node files, chain manifests, logs and streams."""

import json

from conftest import rows
from pyspark.sql import functions as F

from mnemora.functions.atoms import rule_atoms, score_hook, units, word_overlap
from mnemora.sources import nodes
from mnemora.streaming import flows

NODE = """---
name: Vector index
valid_from: 2020-01-02T10:00
valid_to: null
relevance: 0.75
access_count: 12
chains: [alpha, beta]
custom: 1.2.3
custom: again
---
# Body

text
"""


def test_node_files(spark, tmp_path):
    (tmp_path / "n1.md").write_text(NODE)
    (tmp_path / "n2.md").write_text("no header here")
    (tmp_path / "other.txt").write_text("x")
    parsed = nodes.parse_nodes(nodes.read_node_files(spark, str(tmp_path)))
    got = {r.id: r for r in parsed.collect()}
    assert set(got) == {"n1", "n2"}
    n = got["n1"]
    assert (n["name"], str(n.valid_from), n.valid_to, n.relevance, n.access_count, n.chains) == ("Vector index", "2020-01-02", None, 0.75, 12, ["alpha", "beta"])
    assert n.header["custom"] == "1.2.3" and n.body.startswith("# Body")
    assert got["n2"].header is None and got["n2"].body == "no header here"
    text = {r.id: r.text for r in nodes.render_nodes(parsed).collect()}
    assert text["n1"] == NODE.replace("custom: again\n", "") and text["n2"] == "no header here"


def test_header_lines(spark):
    df = spark.createDataFrame([(NODE,), ("plain",)], "text string").select(nodes.header_lines("text").alias("h"))
    assert rows(df.select(nodes.header_get("h", "custom"))) == [("1.2.3",), (None,)]
    out = df.select(nodes.header_set("h", "custom", F.lit(5)).alias("h")).where("h is not null").first().h
    assert out.count("custom: 5") == 2
    assert df.select(nodes.header_set("h", "fresh", F.lit("x")).alias("h")).where("h is not null").first().h[-1] == "fresh: x"


def test_chain_files(spark, tmp_path):
    chain = {"chain_id": "c1", "members": [{"addr": "a1", "file": "nodes/x.md"}, {"addr": "a2", "file": "nodes/y.md"}], "edges": [{"from": "a1", "to": "a2", "valid_from": "2020-01-01", "valid_to": None, "label": "follows", "confidence": 0.5}]}
    (tmp_path / "c1.json").write_text(json.dumps(chain, indent=1))
    m, e = nodes.read_chain_files(spark, str(tmp_path))
    assert rows(m) == [("c1", 0, "a1", "x"), ("c1", 1, "a2", "y")]
    assert e.first().src == "a1" and str(e.first().valid_from) == "2020-01-01"
    back = nodes.chain_manifests(m, e)
    assert json.loads(back.toJSON().first())["members"] == chain["members"]


def test_logs(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"ts": "t", "nodes": ["a", "b"]}\nnot json\n{"ts": "u"}\n')
    got = nodes.read_log(spark, str(tmp_path / "log"), "ts string, nodes array<string>")
    assert rows(got) == [("t", ["a", "b"]), ("u", None)]
    out = str(tmp_path / "out")
    nodes.stream_log(spark, str(tmp_path / "log"), "ts string, nodes array<string>").writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "_c").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(got)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "events")
    ev = [("w", "2020-01-01 00:00:00", ["a.md", "b"], "genuine"), ("w", "2020-01-01 00:30:00", ["a", "b", "c"], None), ("w", "2020-01-01 01:00:01", ["c"], "replay"), (None, "2020-01-02 00:00:00", ["a", "b"], "replay")]
    spark.createDataFrame(ev, "workspace string, at string, nodes array<string>, source string").withColumn("at", F.col("at").cast("timestamp")).repartition(2).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    flows.merge_pairs(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert rows(flows.pair_totals(spark, str(tmp_path / "t"))) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    again = flows.merge_pairs(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    again.awaitTermination()
    assert flows.pair_totals(spark, str(tmp_path / "t")).count() == 3
    q = flows.sessions(stream).writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("sess").orderBy("start_at").collect()] == [2, 1]
    q = flows.ring(stream, 2).writeStream.format("memory").queryName("ring").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.nodes for r in spark.table("ring").collect()][-1] == ["c", "a"]


def test_atoms(spark):
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(units("t").alias("u")).first().u
    assert cut("- one thing here\n- two things here") == ["one thing here", "two things here"]
    assert cut("Para one.\n\nPara two.") == ["Para one.", "Para two."]
    assert cut("A short one. Another. " + "x" * 190 + ". End.") == ["A short one. Another.", "x" * 190 + ". End."]
    df = spark.createDataFrame([(1, "Never write on 2020-05-01 or 2020-02-01 here. tiny"), (2, None), (3, "")], "id int, t string")
    got = rule_atoms(df, "id", "t").collect()
    assert len(got) == 1 and (got[0].kind, got[0].valid_from, got[0].valid_to) == ("feedback", "2020-02-01", "2020-05-01")
    judged = spark.createDataFrame([("a b", "b c"), ("", "x")], "a string, b string").select(score_hook(word_overlap)("a", "b").alias("s"))
    assert [r.s for r in judged.collect()] == [1 / 3, None]
