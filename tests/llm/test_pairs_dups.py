"""Co-occurrence and near-duplicates against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

from conftest import rows

from mnemora.llm import cooccurrence, neardup


def count(baskets):
    pairs, items, total = Counter(), Counter(), 0
    for its, w in baskets.values():
        if its is None:
            continue
        s = sorted({i for i in its if i is not None})
        total += w
        for i in s:
            items[i] += w
        for p in combinations(s, 2):
            pairs[p] += w
    return pairs, items, total


def test_increments_match_recount(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BLOCK", 4)
    r = random.Random(3)
    schema = "key string, items array<string>, weight bigint, version bigint, node_a int"
    state = cooccurrence.PairTable(spark, buckets=4)
    truth: dict = {}
    for batch in range(3):
        changes = []
        for _ in range(150):
            k = f"k{r.randrange(200)}"
            items = r.choice([None, [], *[[r.choice("abcdefghijklmnop") for _ in range(r.randrange(1, 14))] + [None]] * 6])
            w, v = r.choice([1, 1, 3]), r.randrange(100)
            changes.append((k, items, w, v, 0))
        best: dict = {}
        for k, items, w, v, _ in changes:
            key = (v, w, items is not None, sorted({i for i in items or [] if i}))
            if k not in best or key > best[k][0]:
                best[k] = (key, items, w, v)
        for k, (_, items, w, v) in best.items():
            if k not in truth or v > truth[k][2]:
                truth[k] = (items, w, v)
            if truth[k][0] is None:
                del truth[k]
        state.apply(spark.createDataFrame([*changes, (None, ["a", "b"], 1, 1, 0)], schema))
        pairs, items, total = count({k: x[:2] for k, x in truth.items()})
        assert state.total == total, batch
        assert {(a, b): n for a, b, n in state.pairs().collect()} == {p: n for p, n in pairs.items() if n}
        assert dict(state.items().collect()) == {i: n for i, n in items.items() if n}
    again = cooccurrence.PairTable.load(spark, state.path)
    assert again.total == total and again.pairs().count() == len(pairs)
    want = {(a, b) for (a, b), n in pairs.items() if n >= 3 and n * total >= 2 * items[a] * items[b]}
    assert {(x.node_a, x.node_b) for x in again.scores(3, 1, 2).collect()} == want
    hit = spark.createDataFrame([("a",)], "node string")
    assert {(x.node_a, x.node_b) for x in again.scores(affected=hit).collect()} == {p for p in pairs if "a" in p}


def test_crash_and_resume(spark, monkeypatch):
    """What a change left before its manifest was written is written over; versions are merged and stored scores follow every change."""
    monkeypatch.setattr(cooccurrence, "COMPACT", 3)
    schema = "key string, items array<string>, weight bigint, version bigint"
    batch = lambda n: spark.createDataFrame([(f"k{i}", ["a", "b", f"x{(i + n) % 5}"], 1, n) for i in range(n, n + 6)], schema)
    state = cooccurrence.PairTable(spark, buckets=2).apply(batch(1)).refresh(2)

    def stop():
        raise RuntimeError("lost")

    monkeypatch.setattr(state, "_commit", stop)
    try:
        state.apply(batch(2))
    except RuntimeError:
        pass
    again = cooccurrence.PairTable.load(spark, state.path)
    truth = {}
    for n in (1, 2, 3, 4, 5):
        if n > 1:
            again.apply(batch(n)).refresh(2)
        truth |= {f"k{i}": (["a", "b", f"x{(i + n) % 5}"], 1) for i in range(n, n + 6)}
        pairs, items, total = count(truth)
        assert again.total == total
        want = {(*p, c, items[p[0]], items[p[1]]) for p, c in pairs.items() if c >= 2}
        assert {tuple(r)[:5] for r in again.scores(2).collect()} == want, n
    assert max(map(len, again.where["pairs"].values())) < 3


def test_no_baskets(spark):
    state = cooccurrence.PairTable(spark).apply(spark.createDataFrame([], "key string, items array<string>, weight bigint, version bigint"))
    assert state.total == 0 and state.scores(1, 1, 2).count() == 0


def shingles(t, k):
    w = re.findall("[a-z0-9]+", (t or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def texts(seed, n=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    out = []
    for i in range(n):
        if i % 3 and out:
            w = out[r.randrange(len(out))].split(" ")
            for _ in range(r.randrange(5)):
                p = r.randrange(len(w))
                w[p : p + r.randrange(2)] = [r.choice(words)] * r.randrange(3)
            out.append(" ".join(w) or "x")
        else:
            out.append(" ".join(r.choice(words) for _ in range(r.randrange(3, 60))))
    return out


def check_dups(spark, k, threshold, seed):
    data = [(f"a{i:04}", t) for i, t in enumerate(texts(seed))]
    data += [("b1", data[5][1].upper() + "!!"), ("b2", data[5][1]), ("b3", None), ("b4", ""), ("b5", "one"), (None, data[5][1]), data[7], ("long", " ".join(f"z{i}" for i in range(50000)))]
    found = neardup.near_duplicates(spark.createDataFrame([(*d, "x") for d in data], "id string, text string, key string"), "id", "text", k, threshold)
    sets = {i: shingles(t, k) for i, t in data if i}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    assert {(x.id_a, x.id_b) for x in found.pairs().collect()} == want
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x.id: x.class_id for x in found.classes().collect()}
    assert got == {i: root(i) for i in sets}


def test_pairs_and_classes(spark):
    check_dups(spark, 3, 0.5, 1)
    check_dups(spark, 5, 0.8, 2)


def test_hot_anchor(spark, monkeypatch):
    """Hundreds of texts at the same anchors, dealt into many cells: all their pairs are found."""
    monkeypatch.setattr(neardup, "CELL", 7)
    base = [f"c{i}" for i in range(60)]
    data = [(f"h{i:03}", " ".join([*base[: i % 50 + 5], f"x{i}", *base[i % 50 + 5 :]])) for i in range(120)]
    found = neardup.near_duplicates(spark.createDataFrame(data, "id string, text string"), "id", "text", 3, 0.5)
    sets = {i: shingles(t, 3) for i, t in data}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert len(want) == 120 * 119 // 2 and {(x.id_a, x.id_b) for x in found.pairs().collect()} == want


def test_no_texts(spark):
    found = neardup.near_duplicates(spark.createDataFrame([], "id string, text string"), "id", "text")
    assert rows(found.pairs()) == [] and rows(found.classes()) == []
