"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets a place in the source's shuffled order and a virtual finish time: the
source's tokens up to and with it, divided by the source's weight. Taken in order of finish time, the sources
advance in proportion to their weights. Repeats follow a source's whole round by another. The queue is cut
where the total budget is reached.

Running sums never pass through one task: each source's order and the queue as a whole are cut into ranges
(of the shuffle hash, of the finish time), sums per range are accumulated, and only inside a range rows are
ordered one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.runtime import broadcast_if_small, materialize

#: Ranges per source and of the queue: a table of that many sums is accumulated at once.
RANGES = 4096
try:
    import public_tokenizers

    #: Default ranks of a public tokenizer.
    TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
except ImportError:  # then mix() needs a path
    TOKENIZER = "byte_bpe_50k.tiktoken"


def source_key(source: str | Column) -> Column:
    """Lower case without outer white space; null for null or blank."""
    c = F.col(source) if isinstance(source, str) else source
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def token_counts(tokenizer: str = TOKENIZER):
    """Pandas UDF: tokens of each text under a tiktoken rank file; 0 for null."""
    import base64

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for s in parts:
            yield s.map(lambda t: len(own.encode_ordinary(t)) if t else 0)

    return count


@dataclass
class Mix:
    """selection: id, source, repeat, n_tokens, finish (in queue order). shares: one row per source of either table."""

    selection: DataFrame
    shares: DataFrame
    budget: int


def _rounds(sources: list[tuple], budget: int) -> dict[str, int]:
    """Rounds of each source (name, weight, tokens, repeats allowed, largest document; one row per target source) that the queue can reach.

    At virtual time t a source has let through no less than weight * t, short of one document, or all it has. The queue ends at the latest when
    these sums reach the budget and a document of every source.
    """
    goal = budget + sum(largest for *_, largest in sources)
    end, gone, rest = float("inf"), 0.0, sum(w for _, w, *_ in sources)
    for _, w, tokens, repeats, _ in sorted(sources, key=lambda s: s[2] * s[3] / s[1]):
        if gone + rest * (tokens * repeats / w) >= goal:
            end = (goal - gone) / rest
            break
        gone, rest = gone + tokens * repeats, rest - w
    return {k: max(1, min(int(repeats), int(min(end * w / tokens, 1e9)) + 1)) for k, w, tokens, repeats, _ in sources}


def mix(
    documents: DataFrame, id_column: str, text: str, source: str, targets: DataFrame, budget: int | None = None, seed: int = 1,
    tokenizer: str = TOKENIZER,
) -> Mix:
    """Draw documents so that each source has its share of all tokens.

    `targets`: source, target_share, max_repeats; sources compare without case and outer blanks, and of several
    rows of one source shares add up and the largest max_repeats (null: 1) counts. Sources of which no token
    exists can't be drawn; the shares of the others are scaled to add up to 1. Documents of null or
    unlisted sources, null ids and texts without tokens are not drawn. Without a budget it is the largest at
    which every source can meet its share within its repeats; with a larger one, sources that run out fall
    short and the rest of the budget goes to the others. The cut falls before the first document that would
    exceed the budget. Equal shuffle hashes are ordered by id. Empty tables give an empty selection.
    """
    spark = documents.sparkSession
    want = (
        targets.select(source_key("source").alias("source"), "target_share", "max_repeats").where("source is not null")
        .groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    )
    sized = materialize(
        documents.select(F.col(id_column).alias("id"), source_key(source).alias("source"), token_counts(tokenizer)(text).alias("n_tokens"))
        .where("id is not null").withColumn("h", F.xxhash64(F.lit(seed), "id")),
        "sized",
    )
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    plan = materialize(
        want.join(have.where("source is not null"), "source", "left").where("target_share > 0 and max_repeats > 0 and tokens > 0")
        .withColumn("weight", F.col("target_share") / F.sum("target_share").over(Window.partitionBy())),
        "plan",
    )  # one row per target source
    if budget is None:
        budget = int(plan.select(F.floor(F.min(F.col("tokens") * F.col("max_repeats") / F.col("weight")))).first()[0] or 0)
    docs = sized.join(broadcast_if_small(plan.select("source", "weight", "tokens", "max_repeats")), "source").where("n_tokens > 0")
    # running sums of a source: over ranges of the hash, then inside each range
    docs = docs.withColumn("range", F.shiftrightunsigned("h", 64 - 12).cast("int"))
    sums = docs.groupBy("source", "range").agg(F.sum("n_tokens").alias("s"))
    ahead = sums.withColumn("ahead", F.sum("s").over(Window.partitionBy("source").orderBy("range")) - F.col("s")).drop("s")
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "range").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    once = docs.withColumn("inside", inside).join(ahead, ["source", "range"]).withColumn("upto", F.col("ahead") + F.col("inside"))
    # only rounds that can be drawn before the budget is spent
    rounds = _rounds([tuple(r) for r in docs.groupBy("source", "weight", "tokens", "max_repeats").agg(F.max("n_tokens")).collect()], budget)
    turns = F.coalesce(*(F.when(F.col("source") == k, F.lit(n)) for k, n in rounds.items()), F.lit(1)) if rounds else F.lit(1)
    queue = once.withColumn("repeat", F.explode(F.sequence(F.lit(1), turns))).select(
        "id", "source", "repeat", "n_tokens", "h", ((F.col("upto") + (F.col("repeat") - 1) * F.col("tokens")) / F.col("weight")).alias("finish")
    )
    queue = materialize(queue, "queue")
    last = queue.agg(F.max("finish")).first()[0] or 1.0
    queue = queue.withColumn("slot", F.least(F.floor(F.col("finish") / F.lit(last) * RANGES * 4), F.lit(RANGES * 4 - 1)).cast("int"))
    slots = queue.groupBy("slot").agg(F.sum("n_tokens").alias("s"))
    slots = slots.withColumn("upto", F.sum("s").over(Window.orderBy("slot"))).withColumn("before", F.col("upto") - F.col("s"))
    edge = slots.where(F.col("upto") > budget).orderBy("slot").first()
    if edge is None:
        taken = queue
    else:
        order = Window.partitionBy("slot").orderBy("finish", "source", "h", "id").rowsBetween(Window.unboundedPreceding, 0)
        rim = queue.where(F.col("slot") == edge["slot"]).withColumn("upto", F.sum("n_tokens").over(order) + edge["before"]).where(F.col("upto") <= budget).drop("upto")
        taken = queue.where(F.col("slot") < edge["slot"]).unionByName(rim)
    taken = materialize(taken.select("id", "source", "repeat", "n_tokens", "finish"), "taken")
    got = taken.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.count(F.lit(1)).alias("drawn_docs"), F.max("repeat").alias("most_repeats"))
    total = taken.agg(F.sum("n_tokens").alias("t"))
    known = have.where("source is not null").join(want, "source", "full").join(plan.select("source", "weight"), "source", "left").join(got, "source", "left")
    shares = known.crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("tokens", F.lit(0)).alias("available_tokens"),
        F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.coalesce("drawn_docs", F.lit(0)).alias("drawn_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.col("drawn_tokens") / F.col("t"), F.lit(0.0)).alias("share"),
    )
    return Mix(taken.orderBy("finish", "source", "id", "repeat"), shares, budget)
