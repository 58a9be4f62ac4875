"""Offline passes: neighbour sweeps, link proposals, capture windows, abstraction candidates, credits and the candidate list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.operators.graph import connected_components
from mnemora.operators.retrieval import search
from mnemora.operators.state import insert_missing


def neighbour_sweep(queries: DataFrame, rows: DataFrame, k: int = 6, bar: float = 0.55, key: str = "id", chain: str = "chain") -> DataFrame:
    """Best link between each pair of chains found from the query rows' nearest neighbours: chain_a, chain_b (a < b), query, item, score."""
    near = search(queries, rows, k, bar, key)
    of = rows.select(key, chain)
    both = near.join(of.withColumnsRenamed({key: "query", chain: "_q"}), "query").join(of.withColumnsRenamed({key: "item", chain: "_i"}), "item").where("_q <> _i")
    named = both.select(F.least("_q", "_i").alias("chain_a"), F.greatest("_q", "_i").alias("chain_b"), F.struct((-F.col("score")).alias("s"), "query", "item").alias("x"))
    return named.groupBy("chain_a", "chain_b").agg(F.min("x").alias("x")).select("chain_a", "chain_b", "x.query", "x.item", (-F.col("x.s")).alias("score"))


def propose_links(queries: DataFrame, rows: DataFrame, connected: DataFrame, k: int = 5, bar: float = 0.62, key: str = "id") -> DataFrame:
    """Near rows that are not yet connected (`a` < `b`): a, b, score."""
    near = search(queries, rows, k, bar, key)
    pairs = near.groupBy(F.least("query", "item").alias("a"), F.greatest("query", "item").alias("b")).agg(F.max("score").alias("score"))
    return pairs.join(connected.select("a", "b").distinct(), ["a", "b"], "left_anti")


def capture_window(members: DataFrame, anchors: DataFrame, before: int = 9, after: int = 3, seconds: float = 9 * 3600.0, calm: float = 0.7) -> DataFrame:
    """Members around each anchor of their chain, by position and time: chain, anchor, node, `offset`.

    `members` has chain, pos, node, at (epoch seconds), salience; `anchors` has chain, node. Only members of salience below `calm`
    (null counts 0) and within `seconds` of the anchor. Positions are joined by blocks, so a long chain is spread.
    """
    size = before + after + 1
    a = anchors.join(members, ["chain", "node"]).select("chain", F.col("node").alias("anchor"), F.col("pos").alias("_p"), F.col("at").alias("_t"))
    lowest, highest = F.floor((F.col("_p") - before) / size).cast("bigint"), F.floor((F.col("_p") + after) / size).cast("bigint")
    a = a.withColumn("_b", F.explode(F.sequence(lowest, highest)))
    m = members.withColumn("_b", F.floor(F.col("pos") / size).cast("bigint"))
    met = a.join(m, ["chain", "_b"]).withColumn("offset", F.col("pos") - F.col("_p"))
    near = F.col("offset").between(-before, after) & (F.col("offset") != 0) & (F.abs(F.col("at") - F.col("_t")) <= seconds)
    return met.where(near & (F.coalesce("salience", F.lit(0.0)) < calm)).select("chain", "anchor", "node", "offset")


def abstraction_candidates(pairs: DataFrame, least: int = 3) -> DataFrame:
    """Groups of similar members of one chain (`chain`, a, b, similarity): chain, `members`, n, `similarity` (mean of the pairs).

    Components per chain; a group of fewer than `least` members is none.
    """
    sep = "\u0001"
    end = lambda c: F.concat_ws(sep, "chain", c)
    comp = connected_components(pairs.select(end("a").alias("src"), end("b").alias("dst")))
    part = comp.select(F.substring_index("node", sep, 1).alias("chain"), F.substring_index("node", sep, -1).alias("node"), "component")
    groups = part.groupBy("chain", "component").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    mean = pairs.join(part.withColumnRenamed("node", "a"), ["chain", "a"]).groupBy("chain", "component").agg(F.avg("similarity").alias("similarity"))
    return groups.join(mean, ["chain", "component"]).select("chain", "members", "n", "similarity")


def pair_credit(touches: DataFrame, day: str, at: str) -> DataFrame:
    """Days and last moment of each pair over credited records (a, b): a, b, n_days, last_at."""
    return touches.groupBy("a", "b").agg(F.countDistinct(day).alias("n_days"), F.max(at).alias("last_at"))


def associations(loaded: DataFrame, pairs: DataFrame, today: str, rate: float = 0.005, most: int = 5) -> DataFrame:
    """Nodes tied to the loaded ones (`id`), by weight faded with the days since last sight: `id`, `score`; the best."""
    days = F.greatest(F.datediff(F.lit(today).cast("date"), F.col("last_seen").cast("date")), F.lit(0))
    faded = pairs.withColumn("s", F.col("w") * F.greatest(F.lit(0.0), 1 - rate * days))
    both = faded.select(F.col("a").alias("p"), F.col("b").alias("id"), "s").unionByName(faded.select(F.col("b").alias("p"), F.col("a").alias("id"), "s"))
    near = both.join(loaded.select(F.col("id").alias("p")), "p", "left_semi").join(loaded.select("id"), "id", "left_anti")
    return near.groupBy("id").agg(F.max("s").alias("score")).orderBy(F.col("score").desc(), "id").limit(most)


def record_candidates(candidates: DataFrame, new: DataFrame) -> DataFrame:
    """Supersession candidates (old_id, new_id, cosine, status) with new ones added; a pair that is still unresolved is not added again."""
    unresolved = candidates.where("status = 'open'")
    fresh = insert_missing(unresolved, new.withColumn("status", F.lit("open")).select(*candidates.columns), ["old_id", "new_id"])
    return candidates.where("status <> 'open'").unionByName(fresh)


def resolve_candidates(candidates: DataFrame, pairs: DataFrame, status: str) -> DataFrame:
    """Unresolved candidates of the given pairs set to a status."""
    hit = pairs.select("old_id", "new_id", F.lit(True).alias("_hit")).distinct()
    now = F.when(F.col("_hit") & (F.col("status") == "open"), F.lit(status)).otherwise(F.col("status"))
    return candidates.join(hit, ["old_id", "new_id"], "left").withColumn("status", now).select(*candidates.columns)


def rerank(hits: DataFrame, score: Column, k: int, key: str = "id") -> DataFrame:
    """Hits by another score (a model's, through functions.atoms.score_hook): all columns, `score`; abstentions last."""
    return hits.withColumn("score", score).orderBy(F.col("score").desc_nulls_last(), key).limit(k)


def recent_similar(writes: DataFrame, key: str, at: str, text: str, group: str, bar: float = 0.25, hours: int = 24) -> DataFrame:
    """Writes of a group that resemble an earlier one within the time window: key as `id`, `earlier`, `similarity`.

    Days and days shifted by a half window are the candidate groups, in which similar pairs are found by their rare words.
    """
    from mnemora.operators.dedup import similar_pairs

    span = hours * 3600
    t = F.unix_seconds(F.col(at).cast("timestamp"))
    w = writes.where(F.col(group).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("id"), t.alias("t"), F.col(text).alias("text"), F.col(group).alias("g"))
    slot = F.floor(F.col("t") / span)
    placed = w.select("id", "text", F.explode(F.array(F.concat_ws("|", "g", slot), F.concat_ws("|", "g", slot + 1))).alias("slot"))
    pairs = similar_pairs(placed, "slot", "id", "text", bar).select("a", "b", "similarity").distinct()
    times = w.select("id", "t")
    both = pairs.join(times.withColumnsRenamed({"id": "a", "t": "ta"}), "a").join(times.withColumnsRenamed({"id": "b", "t": "tb"}), "b").where(F.abs(F.col("ta") - F.col("tb")) <= span)
    first = (F.col("ta") < F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("a") < F.col("b")))
    return both.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("earlier"), "similarity")


def first_chain(members: DataFrame) -> DataFrame:
    """Each node's first chain and its place there: node, chain, pos."""
    return members.groupBy("node").agg(F.min(F.struct("chain", "pos")).alias("x")).select("node", "x.*")


