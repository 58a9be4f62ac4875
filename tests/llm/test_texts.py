"""Leakage, mixing and residue."""

import random
import re
from pathlib import Path

import pytest
from conftest import rows

from mnemora.llm import leakage, mixing, residue


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def edits(a, b):
    """Least edits of the whole of a within b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(60)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(f"i{i}", ". ".join(say(r.randrange(3, 30)))) for i in range(12)] + [(None, "x"), ("none", None), ("i0", None)]
    docs = []
    for d in range(60):
        body = say(r.randrange(40))
        if d % 2:
            w = words(r.choice(items[:12])[1])
            at = r.randrange(len(w))
            piece = " ".join(w[at : at + r.randrange(5, 20)])
            for _ in range(r.randrange(3)):
                p = r.randrange(max(1, len(piece)))
                piece = piece[:p] + r.choice(["", "q", "zz"]) + piece[p + r.randrange(2) :]
            body = body[:5] + [piece.upper()] + body[5:]
        docs.append((d, ", ".join(body)))
    return docs + [(900, None), (901, ""), (None, "x y z")], items


@pytest.mark.parametrize("budget", [0, 1, 2])
def test_leaks(spark, budget, monkeypatch):
    monkeypatch.setattr(leakage, "PIECE", 400)
    monkeypatch.setattr(leakage, "FILTER_BITS", 12)
    docs, items = corpus(budget)
    docs.append((950, " ".join(["filler"] * 3000) + " " + items[3][1] + " " + " ".join(["more"] * 800)))
    got = leakage.leaks(
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, body string, item_key int"), "doc_id", "body", spark.createDataFrame(items + items[:2], "item_id string, passage string"), "item_id", "passage", 6, budget
    )
    want = set()
    for d, t in docs:
        text = " ".join(words(t))
        for i, p in items:
            w = words(p)
            for s in range(len(w) - 5):
                run = " ".join(w[s : s + 6])
                if d is not None and i and (f" {run} " in f" {text} " if budget == 0 else d < 900 and edits(run, text) <= budget):
                    want.add((d, i))
    found = {(x.doc_id, x.item_id) for x in got.collect()}
    assert {x for x in found if budget == 0 or x[0] < 900} == want
    assert budget or all(x.n_words >= 6 for x in got.collect())
    assert leakage.leaks(spark.createDataFrame([], "doc_id string, body string"), "doc_id", "body", spark.createDataFrame(items, "item_id string, passage string"), "item_id", "passage").count() == 0


def test_leaks_with_text_ids(spark):
    p = "the quick brown fox jumps over the lazy dog and then sleeps"
    got = leakage.leaks(spark.createDataFrame([("d1", p), ("d2", "no")], "doc_id string, body string"), "doc_id", "body", spark.createDataFrame([(7, p)], "item_id int, passage string"), "item_id", "passage", 12)
    assert rows(got) == [("d1", 7, 12, 0)]


def mix_input(spark):
    r = random.Random(4)
    docs = [(i, " ".join(["word"] * r.randrange(1, 40)), r.choice([" A", "a", "b", "B ", "c", "x", None])) for i in range(1500)]
    docs += [(5000, None, "a"), (5001, "", "a"), (None, "word", "a"), (5002, "b" * 200_000, "b")]
    targets = [("a", 0.5, 1), ("b", 0.3, 1), ("C ", 0.1, 3), ("none", 0.1, 2)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


@pytest.mark.skipif(not Path(mixing.TOKENIZER).exists(), reason="no tokenizer files")
def test_mix(spark):
    docs, targets = mix_input(spark)
    full = mixing.mix(docs, "doc_id", "text", "source", targets)
    share = {x.source: x for x in full.shares.collect()}
    for s, w in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert abs(share[s].share - w) < 0.08, s
    assert share["none"].drawn_tokens == 0 and share["x"].drawn_tokens == 0
    picked = full.selection.collect()
    assert sum(x.n_tokens for x in picked) <= full.budget
    assert len({(x.id, x.repeat) for x in picked}) == len(picked)
    assert [x.finish for x in picked] == sorted(x.finish for x in picked)
    assert all(x.repeat <= {"a": 1, "b": 1, "c": 3}[x.source] for x in picked)
    # place of every row: the tokens of its source up to it, by weight
    for s in "abc":
        sofar = 0
        for x in sorted((x for x in picked if x.source == s), key=lambda x: x.finish):
            sofar += x.n_tokens
            assert abs(x.finish * share[s].weight - sofar) < 1e-6 * sofar
    large = mixing.mix(docs, "doc_id", "text", "source", targets, budget=10**9)
    got = {x.source: x for x in large.shares.collect()}
    assert got["a"].drawn_tokens == got["a"].available_tokens and got["c"].drawn_tokens == 3 * got["c"].available_tokens
    empty = mixing.mix(docs.limit(0), "doc_id", "text", "source", targets)
    assert empty.selection.count() == 0 and empty.budget == 0


BAD = [
    "Please enable JavaScript to view this page.", "This viewer needs scripts\nto run. Allow scripts for this site.", "Bitte aktivieren Sie JavaScript, um diese Notiz zu sehen.",
    "<html><body><h1>404 Not Found</h1></body></html>", "Error 503: upstream connection reset.", "Real words here.\n\nOops! Something went wrong on our side.", "ACCESS DENIED.",
    "Dear {{name}}, welcome.", "Hello ${user}", "Status of %(name)s", "Owner: __OWNER_NAME__", "Call [INSERT NAME HERE] now", "Due <due date goes here>", "Hi {first_name}!", "<MISSING POOL ENTRY POOL-12>",
    "Intro.\n```\ncode without an end\n\nPlease enable JavaScript to view this page.", "Dear {{ customer.first_name | default('a name that is far longer than any limit on the length of a slot would be') }}, hello", "Dear <FIRST_NAME>, thanks.", "Hello [% user.name %]",
    "Placeholder paragraph. Text will be added later.", "sample text sample text sample text", "asdf asdf qwer",
]
GOOD = [
    "The help text says `please enable scripts`; we want another line.", "Log format: `%(asctime)s %(message)s` was chosen.", "Run it:\n```\nexport A=${HOME}/x\n```\ndone", "The page no longer answers with 404 not found, because ids redirect.",
    "The panel works with JavaScript disabled since it is rendered on the server.", "We saw 502 bad gateway answers for 3 minutes while it restarted.", '{"name": "x", "n": {"rank": 3}}', "Access denied was the right answer here.",
    "The runbook says something went wrong in the index build, so we re-ran it on Tuesday.", "It read:\n```\n404 not found\n```\nand we fixed it.", "Recall\nreturned the page\nfor every query we had.",
    "", None, "He wrote that \"something went wrong\" on the form, and then left.",
]


def test_residue(spark):
    data = [(i, t) for i, t in enumerate(BAD)] + [(100 + i, t) for i, t in enumerate(GOOD)] + [(None, BAD[0]), (0, BAD[0]), (200, " ".join(f"x{i % 977}y" for i in range(100_000)))]
    got = residue.find_residue(spark.createDataFrame([(*d, "k") for d in data], "doc_id bigint, text string, kind string"), "doc_id", "text")
    assert {x.doc_id for x in got.collect()} == set(range(len(BAD)))
    assert residue.find_residue(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_filler_vocabulary(spark):
    r = random.Random(1)
    latin = ["lorem", "ipsum", "dolor", "viden", "orbis", "caecus", "ornat"]
    filler = [(i, " ".join(r.choice(latin) for _ in range(9)) + ".") for i in range(80)]
    prose = [(1000 + i, f"The {r.choice('abcdefgh')} map held {r.randrange(50)} rows near the orbis gate today.") for i in range(300)]
    prose += [(2000 + i, "Somebody asked why the mock generator writes lorem ipsum; we now feed it recorded sittings.") for i in range(20)]
    got = residue.find_residue(spark.createDataFrame(filler + prose, "doc_id bigint, text string"), "doc_id", "text")
    assert {x.doc_id for x in got.collect()} == set(range(80))
