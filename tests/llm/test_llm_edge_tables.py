"""Queries p2, p5, p6, p7 and p8 over empty and dirty tables."""

import edge_tables
import pytest

from mnemora.llm import queries


@pytest.mark.skipif(not edge_tables.SMALL.exists(), reason="no test tables")
def test_empty_and_dirty(spark, tmp_path):
    empty, dirty = edge_tables.write(spark, tmp_path, ("sittings", "edges", "pool", "documents", "eval_items", "mix_targets"))
    for name, q in queries.QUERIES.items():
        assert q(spark, empty).count() == 0, name
        # a sitting of nulls is one more record, which moves all scores; a document that is there twice has twice the tokens
        rows = lambda df: sorted(map(str, df.drop("score").collect()))
        found = rows(q(spark, dirty))
        if not name.startswith("p7"):
            assert found == rows(q(spark, str(edge_tables.SMALL))), name
