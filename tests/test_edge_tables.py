"""Queries p1, p3 and p4 over empty and dirty tables."""

import edge_tables
import pytest

from mnemora.plans import problems


@pytest.mark.skipif(not edge_tables.SMALL.exists(), reason="no test tables")
def test_empty_and_dirty(spark, tmp_path):
    empty, dirty = edge_tables.write(spark, tmp_path, ("sittings", "chains", "dataset", "raw_a3_temporal"))
    for name, q in problems.QUERIES.items():
        assert q(spark, empty).count() == 0, name
        assert sorted(map(str, q(spark, dirty).collect())) == sorted(map(str, q(spark, str(edge_tables.SMALL)).collect())), name
