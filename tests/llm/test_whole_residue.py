"""Residue in mixed templates and the standard passage."""

from conftest import rows

from mnemora.llm import residue


def test_residue_in_a_mixed_template(spark):
    texts = ["404 not found", "404 not run", "La page est introuvable", "La page est utile"]
    got = residue.find_residue(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text")
    assert rows(got) == [(0, ["message"]), (2, ["message"])]


def test_standard_passage_is_filler(spark):
    texts = ["Lorem ipsum", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Duis aute irure dolor in reprehenderit in voluptate.", "We replaced lorem ipsum by real words in the draft.", "Do in et non est."]
    got = residue.find_residue(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text")
    assert rows(got) == [(0, ["filler"]), (1, ["filler"]), (2, ["filler"])]
