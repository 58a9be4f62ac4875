"""Sessions against a plain scan."""

import random

import numpy as np
import pytest
from conftest import rows

from mnemora.operators import sessions


def plain(events, gap):
    out, by = [], {}
    for e, t in events:
        if e is not None and t is not None:
            by.setdefault(e, []).append(t)
    for e, ts in by.items():
        ts.sort()
        start, n = ts[0], 0
        for i, t in enumerate(ts):
            if i and t - ts[i - 1] > gap:
                out.append((e, start, ts[i - 1], n))
                start, n = t, 0
            n += 1
        out.append((e, start, ts[-1], n))
    return sorted(out)


def events(seed, n=3000):
    r = random.Random(seed)
    hot = [("hot", int(r.paretovariate(0.7) * 10) + 13 * i) for i in range(n)]
    few = [(f"e{r.randrange(300)}", r.randrange(0, 20000, 7)) for _ in range(n // 2)]
    ties = [("tie", 5)] * 400 + [("rise", i * i) for i in range(300)] + [("fall", 100000 - i * i) for i in range(300)]
    all_ = hot + few + ties + [(None, 4), ("e1", None), ("one", 3)]
    r.shuffle(all_)
    return all_


@pytest.mark.parametrize("parts", [1, 8, 70])
def test_matches_scan_at_any_chunking(spark, parts):
    data = events(parts)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(data, "entity string, us bigint")
        tree = sessions.gap_tree(df, "entity", "us").cache()
        for gap in (0, 6, 50, 400, 10**9):
            want = plain(data, gap)
            cols = ("entity", "start_us", "end_us", "n_rows")
            assert rows(sessions.cut(tree, gap).select(*cols)) == sorted(want, key=str), gap
        several = sessions.sessions(df, "entity", "us", [6, 400])
        for gap in (6, 400):
            assert rows(several.where(f"gap_limit_us = {gap}").select("entity", "start_us", "end_us", "n_rows")) == sorted(plain(data, gap), key=str)
        tree.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_levels_of_merging(spark, monkeypatch):
    monkeypatch.setattr(sessions, "FAN_IN", 3)
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    try:
        data = events(99, 1500)
        df = spark.createDataFrame(data, "entity string, us bigint")
        assert rows(sessions.sessions(df, "entity", "us", 40).select("entity", "start_us", "end_us", "n_rows")) == sorted(plain(data, 40), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_empty_clashing_and_weights(spark):
    schema = "entity bigint, us bigint, w bigint, chunk string, gap_us double, start_us string"
    assert sessions.sessions(spark.createDataFrame([], schema), "entity", "us", 5).count() == 0
    df = spark.createDataFrame([(1, 0, 2, "x", 1.0, "y"), (1, 5, None, None, None, None), (1, 11, 7, "x", 2.0, "")], schema)
    got = sessions.sessions(df, "entity", "us", 5, "w")
    assert rows(got) == [(1, 0, 5, 2, 2), (1, 11, 11, 1, 7)]
    with pytest.raises(ValueError):
        sessions.sessions(df, "entity", "us", -1)


def test_micros(spark):
    df = spark.createDataFrame(
        [(1262708124.5, 14614), (1262708124500.0, 14614), (1262708124500.0, None), (None, 1), (float("nan"), 1), (86400.0 * 3 + 1, 3)], "t double, day bigint"
    )
    got = [r[0] for r in df.select(sessions.epoch_micros("t", "day")).collect()]
    assert got == [1262708124500000] * 3 + [None, None, 259201000000]


def test_nearest_larger_long_chains():
    g = np.array([*range(500, 0, -1), 1000, *range(499, 0, -1), 999], np.int64)
    want = [next((j for j in range(i - 1, -1, -1) if g[j] > g[i]), -1) for i in range(len(g))]
    assert sessions.nearest_larger(g).tolist() == want
    weak = [next((j for j in range(i - 1, -1, -1) if g[j] >= g[i]), -1) for i in range(len(g))]
    assert sessions.nearest_larger(g, strict=False).tolist() == weak
