"""Lifecycle passes as functions from tables to tables: what to write, what to archive, what to drop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions import scores as S
from mnemora.functions import text as X
from mnemora.operators.state import insert_missing


def decay_pass(nodes: DataFrame, today: str, now: float) -> DataFrame:
    """Rows the decay pass writes: `new_relevance` (4 places), `new_tier`, `action`.

    Only live rows take part; a row is written when its tier changes or its relevance moves by more than 1e-4. A newly
    frozen row is to be archived unless its salience is 0.85 or more.
    """
    capture = S.attenuate("stc_capture_score", "stc_capture_at", now)
    step = S.step_relevance("relevance", S.days_since("last_access", today), "material_grade", "salience", capture)
    out = nodes.where(F.coalesce("target_state", F.lit("live")) == "live").withColumn("new_relevance", S.rounded(step)).withColumn("new_tier", S.tier_for("new_relevance"))
    frozen = (F.col("new_tier") == "frozen") & (F.coalesce("tier", F.lit("")) != "frozen") & (F.coalesce("salience", F.lit(0.0)) < S.FREEZE_EXEMPT)
    changed = ~F.col("tier").eqNullSafe(F.col("new_tier")) | (F.abs(F.col("new_relevance") - F.coalesce("relevance", F.lit(0.5))) > 1e-4)
    return out.where(changed).withColumn("action", F.when(frozen, "archive").otherwise("update"))


def review_sweep(nodes: DataFrame, today: str) -> DataFrame:
    """Spaced-repetition update of the rows that are due."""
    due = nodes.where(F.col("next_review") <= F.lit(today).cast("date"))
    q = S.review_quality("relevance", "tier")
    out = due.select("id", q.alias("quality"), S.review_step("easiness_factor", "review_interval_days", "review_count", q).alias("_s")).select("id", "quality", "_s.*")
    return out.withColumn("next_review", F.date_add(F.lit(today).cast("date"), F.col("review_interval_days").cast("int")))


def check_writable(nodes: DataFrame, override: bool = False) -> DataFrame:
    """Adds `writable` and `reason` by lifecycle state."""
    state = F.coalesce("target_state", F.lit("live"))
    frozen = (state == "frozen") & F.lit(not override)
    return nodes.withColumn("writable", ~((state == "archived") | frozen)).withColumn(
        "reason", F.when(state == "archived", "archived is never writable").when(frozen, "frozen needs an override").otherwise("ok")
    )


@dataclass
class Forgotten:
    """What is left of each table, and the archive rows."""

    nodes: DataFrame
    chain_edges: DataFrame
    web_edges: DataFrame
    vectors: DataFrame | None
    archive: DataFrame


def forget(nodes: DataFrame, chain_edges: DataFrame, web_edges: DataFrame, ids: DataFrame, vectors: DataFrame | None = None, reason: str = "forgotten") -> Forgotten:
    """Nodes (`id` in `ids`) taken out of every table; their full rows go to the archive with the reason.

    `chain_edges` and `web_edges` have `src` and `dst`; `vectors` has `id`. Unknown ids change nothing.
    """
    gone = ids.select("id").where("id is not null").distinct()

    def without(edges: DataFrame) -> DataFrame:
        src, dst = gone.withColumnRenamed("id", "src"), gone.withColumnRenamed("id", "dst")
        return edges.join(src, "src", "left_anti").join(dst, "dst", "left_anti").select(*edges.columns)

    return Forgotten(
        nodes.join(gone, "id", "left_anti"), without(chain_edges), without(web_edges), vectors.join(gone, "id", "left_anti") if vectors is not None else None,
        nodes.join(gone, "id", "left_semi").withColumn("reason", F.lit(reason)),
    )


def restore(nodes: DataFrame, archive: DataFrame, ids: DataFrame) -> DataFrame:
    """Archived rows of `ids` put back, each once; present nodes stay as they are."""
    back = archive.join(ids.select("id").distinct(), "id", "left_semi").select(*nodes.columns)
    return insert_missing(nodes, back, ["id"])


def supersede(nodes: DataFrame, pairs: DataFrame, on: str) -> DataFrame:
    """Nodes with `valid_to` set to the day `on` for every `old_id` of `pairs` that is still open; adds `superseded_by`.

    A node named in several pairs is superseded by the least `new_id`.
    """
    by = pairs.where("old_id is not null").groupBy(F.col("old_id").alias("id")).agg(F.min("new_id").alias("superseded_by"))
    joined = nodes.join(by, "id", "left")
    ended = F.col("superseded_by").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(on).cast("date")))
    return joined.withColumn("valid_to", F.when(ended, F.lit(on).cast("date")).otherwise(F.col("valid_to")))


def pick_winner(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each pair (`a`, `b`) the node that stays: more accesses, longer body, later access, greater id. Adds `winner`, `loser`.

    Pairs of which a node is missing are left out.
    """
    rank = F.struct(F.coalesce("access_count", F.lit(0)).alias("n"), F.length(F.coalesce("body", F.lit(""))).alias("l"), F.coalesce("last_access", F.lit("0001-01-01").cast("date")).alias("d"), F.col("id").alias("i"))
    r = nodes.select("id", rank.alias("_r"))
    both = pairs.join(r.withColumnsRenamed({"id": "a", "_r": "_a"}), "a").join(r.withColumnsRenamed({"id": "b", "_r": "_b"}), "b")
    first = F.col("_a") > F.col("_b")
    return both.withColumn("winner", F.when(first, F.col("a")).otherwise(F.col("b"))).withColumn("loser", F.when(first, F.col("b")).otherwise(F.col("a"))).drop("_a", "_b")


def merge_duplicates(nodes: DataFrame, pairs: DataFrame, on: str) -> DataFrame:
    """Losers of duplicate pairs retired on a day; winners get `merged_from`, the sum of accesses and the greatest relevance."""
    won = pick_winner(pairs, nodes)
    parts = won.join(nodes.select(F.col("id").alias("loser"), "access_count", "relevance"), "loser").groupBy(F.col("winner").alias("id")).agg(
        F.array_sort(F.collect_set("loser")).alias("merged_from"), F.sum("access_count").alias("_n"), F.max("relevance").alias("_r")
    )
    retired = won.select(F.col("loser").alias("old_id"), F.col("winner").alias("new_id"))
    out = supersede(nodes, retired, on).join(parts, "id", "left")
    return (
        out.withColumn("access_count", F.when(F.col("merged_from").isNull(), F.col("access_count")).otherwise(F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))))
        .withColumn("relevance", F.greatest("relevance", "_r")).drop("_n", "_r")
    )


def erosion_pass(nodes: DataFrame, anchors: DataFrame, today: str, floor: float = 0.15, seed: int = 0) -> DataFrame:
    """One pass of text erosion on live, unfrozen nodes that have an anchor (`id`, `anchor`): `body`, `integrity`, `frozen`.

    The number of characters is the visible ones times the rate, one at least; below the floor a node freezes.
    """
    live = nodes.where((F.coalesce("target_state", F.lit("live")) == "live") & (F.coalesce("tier", F.lit("warm")) != "frozen")).join(anchors.select("id"), "id", "left_semi")
    rate = S.erosion_rate(S.days_since("last_access", today), "tier", "salience")
    visible = F.length(F.regexp_replace(F.coalesce("body", F.lit("")), rf"[\s{X.ERODED}]", ""))
    n = F.when(visible > 0, F.greatest(F.lit(1), F.ceil(visible * rate))).otherwise(0)
    out = live.select("id", X.erode(F.coalesce("body", F.lit("")), "id", n, seed).alias("body"))
    return out.withColumn("integrity", F.round(X.intact_share("body"), 6)).withColumn("frozen", F.col("integrity") < floor)


def repair(nodes: DataFrame, anchors: DataFrame, strength: float = 1.0) -> DataFrame:
    """Bodies put back from their anchors; the integrity number moves by `strength` of what is missing, even though the text is whole."""
    a = anchors.select("id", "anchor")
    out = nodes.join(a, "id", "left")
    has = F.col("anchor").isNotNull()
    return out.withColumn("integrity", F.when(has, S.rounded(S.restore_integrity(F.coalesce("integrity", F.lit(1.0)), strength), 6)).otherwise(F.col("integrity"))).withColumn("body", F.coalesce("anchor", "body")).drop("anchor")


def capture_anchors(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Anchors for nodes that lack one; texts that carry erosion marks are not taken."""
    fresh = nodes.where(F.col("body").isNotNull() & ~F.contains("body", F.lit(X.ERODED))).select("id", F.col("body").alias("anchor"))
    return insert_missing(anchors, fresh, ["id"])
