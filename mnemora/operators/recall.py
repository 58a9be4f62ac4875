"""The read path as a whole: hits of several sources merged, chains focused on their best members, entity bridges, facts beside
evidence, and conflicts among what is served. Lists here are what one question is answered with, bounded by the parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.operators import packing, retrieval
from mnemora.runtime import broadcast_if_small

#: Share of the budget for facts, members of a chain, and tokens of all evidence.
FACTS, DEPTH, CAP = 0.25, 8, 2400
#: Facts and evidence compared for conflicts, and the cosine from which two are in conflict.
SERVED_FACTS, SERVED_EVIDENCE, CONFLICT = 20, 15, 0.92


def merged_hits(sources: list[tuple[str, DataFrame]], k: int, terms: DataFrame | None = None, neighbours: DataFrame | None = None) -> DataFrame:
    """The k best hits of several sources: id, score, source.

    Each source is (name, id and score); of a node that several have, the last named source counts. Hits of `terms` come first whatever
    their score, and no other source has their nodes. `neighbours` (id, score) come beyond the cut where they are not among the hits.
    """
    parts = [df.select("id", "score", F.lit(name).alias("source"), F.lit(i).alias("_i")) for i, (name, df) in enumerate(sources)]
    if terms is not None:
        parts.append(terms.select("id", "score", F.lit("term").alias("source"), F.lit(len(sources)).alias("_i")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    one = union.groupBy("id").agg(F.max(F.struct("_i", "score", "source")).alias("x")).select("id", "x.score", "x.source")
    best = one.orderBy((F.col("source") != "term").cast("int"), F.col("score").desc(), "id").limit(k)
    if neighbours is None:
        return best
    more = neighbours.join(broadcast_if_small(best.select("id")), "id", "left_anti").select("id", "score", F.lit("neighbour").alias("source"))
    return best.unionByName(more)


def focus(loaded: DataFrame, relevance: DataFrame, depth: int = DEPTH, cap: int = CAP) -> DataFrame:
    """What is served of the chains loaded: chain, node, tokens, `pos`.

    `loaded` has chain, rank (place of the chain), node, tokens; `relevance` has node and score (0 for others). Of each chain the `depth` most
    relevant members; the best one always, deeper ones in order of the chains while they fit under the cap, together.
    """
    scored = loaded.join(broadcast_if_small(relevance.select("node", "score")), "node", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    near = scored.withColumn("i", F.row_number().over(Window.partitionBy("chain").orderBy(F.col("score").desc(), "node"))).where(F.col("i") <= depth)
    entries = near.agg(F.sort_array(F.collect_list(F.struct("rank", "i", "chain", "node", F.col("tokens").cast("bigint").alias("tokens")))).alias("all"))  # chains x depth rows
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.expr("cast(array() as array<int>)").alias("kept"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        serves = (x["i"] == 1) | (s["spent"] + x["tokens"] <= cap)
        return F.struct(F.when(serves, s["spent"] + x["tokens"]).otherwise(s["spent"]).alias("spent"), F.when(serves, F.array_append(s["kept"], s["at"])).otherwise(s["kept"]).alias("kept"), (s["at"] + 1).alias("at"))

    kept = entries.select("all", F.aggregate("all", start, step)["kept"].alias("kept")).select("all", F.posexplode("kept").alias("pos", "k"))
    return kept.select(F.get("all", F.col("k")).alias("x"), "pos").select("x.chain", "x.node", "x.tokens", "pos")


def bridged(loaded: DataFrame, bridges: DataFrame, budget: int) -> DataFrame:
    """Bridge nodes (`id`, score, tokens) added to what is loaded (`id`, tokens), best first, where they still fit: id, tokens, source."""
    spent = loaded.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("spent"))
    new = bridges.join(broadcast_if_small(loaded.select("id")), "id", "left_anti")
    left = budget - spent.first()[0]
    took = packing.first_fit_taken(new.withColumn("_g", F.lit(1)), ["_g"], [F.col("score").desc(), "id"], "tokens", max(0, left))
    return loaded.select("id", "tokens", F.lit("chain").alias("source")).unionByName(took.select("id", "tokens", F.lit("bridge").alias("source")))


def compose(facts: DataFrame, evidence: DataFrame, budget: int, most: int = 12) -> DataFrame:
    """Facts beside evidence: section, pos, node, tokens.

    `facts` has node, score, tokens: the `most` best, cut where the running size passes the facts' share of the budget. `evidence` (node, tokens, pos)
    gets the rest of the budget, cut likewise.
    """
    share = int(budget * FACTS)
    best = facts.orderBy(F.col("score").desc(), "node").limit(most)
    best = best.withColumn("pos", F.row_number().over(Window.orderBy(F.col("score").desc(), "node")) - 1)
    cut = lambda df, size: packing.prefix_budget(df.select(F.lit(1).alias("g"), "pos", "node", "tokens"), ["g"], ["pos"], "tokens", size)
    part = lambda df, name: df.select(F.lit(name).alias("section"), "pos", "node", "tokens")
    return part(cut(best, share), "facts").unionByName(part(cut(evidence, budget - share), "evidence"))


def context_text(served: DataFrame, texts: DataFrame) -> DataFrame:
    """One row with the composed `context`: the facts under their heading, if there are any, then the evidence. `texts` has node and text."""
    rows = served.join(texts.select("node", "text"), "node")
    lines = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == name, F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    both = rows.agg(lines("facts").alias("f"), lines("evidence").alias("e"))
    return both.select(F.concat(F.when(F.col("f") != "", F.concat(F.lit("KNOWN FACTS:\n"), F.col("f"), F.lit("\n\n"))).otherwise(""), F.lit("CONVERSATION EVIDENCE:\n"), F.col("e")).alias("context"))


def read_conflicts(facts: DataFrame, evidence: DataFrame, bar: float = CONFLICT) -> DataFrame:
    """Near-equal nodes among those served, facts against facts and facts against evidence: old_id, new_id, cosine.

    Both have id, pos (place in the list), embedding, `facts` also valid_from. The first SERVED_FACTS and SERVED_EVIDENCE count. Of two dated
    ones the earlier is old (of one day, the one served first), else the one served first.
    """
    f = facts.where(F.col("pos") < SERVED_FACTS).select("id", "pos", F.lit(0).alias("side"), "valid_from", "embedding")
    e = evidence.where(F.col("pos") < SERVED_EVIDENCE).select("id", "pos", F.lit(1).alias("side"), F.lit(None).cast(dict(facts.dtypes)["valid_from"]).alias("valid_from"), "embedding")
    near = retrieval.search(f, f.unionByName(e), None, bar)
    place = f.unionByName(e).select("id", F.struct("side", "pos").alias("p"), "valid_from").groupBy("id").agg(F.min(F.struct("p", "valid_from")).alias("x")).select("id", "x.p", "x.valid_from")
    both = near.join(place.withColumnsRenamed({"id": "query", "p": "p1", "valid_from": "d1"}), "query").join(place.withColumnsRenamed({"id": "item", "p": "p2", "valid_from": "d2"}), "item").where("p1 < p2")
    later = F.col("d1").isNotNull() & F.col("d2").isNotNull() & (F.col("d1") > F.col("d2"))
    return both.select(F.when(later, F.col("item")).otherwise(F.col("query")).alias("old_id"), F.when(later, F.col("query")).otherwise(F.col("item")).alias("new_id"), F.col("score").alias("cosine"))


def pick_loser(pairs: DataFrame) -> DataFrame:
    """Of two nodes in conflict (`a`, `b`, confidence_a, confidence_b, from_a, from_b) the one to retire, `loser`, and the `winner`.

    The less confident loses; else the one true since earlier (null is earliest), else the smaller id.
    """
    ca, cb = F.coalesce("confidence_a", F.lit(0.0)), F.coalesce("confidence_b", F.lit(0.0))
    never = F.lit("0001-01-01").cast("date")
    da, db = F.coalesce(F.col("from_a").cast("date"), never), F.coalesce(F.col("from_b").cast("date"), never)
    first = F.when(ca != cb, ca < cb).when(da != db, da < db).otherwise(F.col("a") < F.col("b"))
    return pairs.withColumns({"loser": F.when(first, F.col("a")).otherwise(F.col("b")), "winner": F.when(first, F.col("b")).otherwise(F.col("a"))})


def cold_chains(members: DataFrame, hot: DataFrame) -> DataFrame:
    """Chains of `members` (chain, node) without a node of `hot` (node)."""
    warm = members.join(broadcast_if_small(hot.select("node").distinct()), "node", "left_semi").select("chain").distinct()
    return members.select("chain").distinct().join(warm, "chain", "left_anti")


def promote(ring: DataFrame, hits: int = 3, salience: float = 0.8, capture: float = 0.5) -> DataFrame:
    """Ring entries (hits, salience, capture) that become engrams: recalled often enough, or salient, or captured."""
    return ring.where((F.coalesce("hits", F.lit(0)) >= hits) | (F.coalesce("salience", F.lit(0.0)) >= salience) | (F.coalesce("capture", F.lit(0.0)) >= capture))


def link_step(links: DataFrame, genuine: DataFrame, occasions: int) -> DataFrame:
    """Hypothetical links (a, b, w, gap) after `occasions` and against the genuine pairs (a, b, promotable): a, b, w, status.

    A link fades by 0.7 for every occasion since it was last seen and is `decayed` below 0.05; it is `genuine` while its pair is
    promotable, `validated` once its pair exists at all, else a `candidate`.
    """
    w = F.col("w") * F.pow(F.lit(0.7), F.greatest(F.lit(0), F.lit(occasions) - F.col("seen")))
    both = links.join(genuine.select("a", "b", F.col("promotable").alias("_p")), ["a", "b"], "left")
    status = F.when(F.col("_p"), "genuine").when(F.col("_p").isNotNull(), "validated").when(w < 0.05, "decayed").otherwise("candidate")
    return both.select("a", "b", w.alias("w"), status.alias("status"))


def promote_pairs(states: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pairs (a, b, tier) to be promoted now: those of tier weak or strong the ledger (a, b, tier) does not have, and weak ones that became strong: a, b,
    tier, `step` (new, upgrade). A ledger with what this returns gives nothing more for the same states."""
    level = lambda c: F.when(F.col(c) == "strong", 2).when(F.col(c) == "weak", 1).otherwise(0)
    known = ledger.groupBy("a", "b").agg(F.max(level("tier")).alias("_had"))
    both = states.join(known, ["a", "b"], "left").withColumn("_had", F.coalesce("_had", F.lit(0)))
    return both.where(level("tier") > F.col("_had")).select("a", "b", "tier", F.when(F.col("_had") == 0, "new").otherwise("upgrade").alias("step"))


def sweep(rows: DataFrame, queries: DataFrame, facts: DataFrame, bar: float = CONFLICT) -> DataFrame:
    """One pass over all pairs of near-equal nodes: old_id, new_id, cosine, for the pairs in which a query row (id, embedding) meets a row.

    `facts` has id, confidence, valid_from; the loser of pick_loser() is the old one. A pair met from both sides counts once.
    """
    near = retrieval.search(queries, rows, None, bar)
    pairs = near.groupBy(F.least("query", "item").alias("a"), F.greatest("query", "item").alias("b")).agg(F.max("score").alias("cosine"))
    side = lambda c: facts.select(F.col("id").alias(c), F.col("confidence").alias(f"confidence_{c}"), F.col("valid_from").alias(f"from_{c}"))
    picked = pick_loser(pairs.join(side("a"), "a").join(side("b"), "b"))
    return picked.select(F.col("loser").alias("old_id"), F.col("winner").alias("new_id"), "cosine")
