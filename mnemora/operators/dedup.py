"""Exact segment pool, similar pairs inside chains, and entity bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions import text as X


def pool_of(segments: DataFrame, content: str, node: str) -> DataFrame:
    """Segments grouped by normalised hash: `content_hash`, `content` (the least spelling), `refs`, `n_nodes`.

    Who refers to a segment stays in the reference table (`references`): a popular segment has no list of its users.
    """
    h = segments.where(F.col(content).isNotNull()).withColumn("content_hash", X.segment_hash(content))
    return h.groupBy("content_hash").agg(F.min(content).alias("content"), F.count(F.lit(1)).alias("refs"), F.approx_count_distinct(node).alias("n_nodes"))


def references(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """Each body as pointers to the pool: key, `pos`, `content_hash`."""
    parts = bodies.select(key, F.posexplode(X.segments(body)).alias("pos", "content"))
    return parts.select(key, "pos", X.segment_hash("content").alias("content_hash"))


def rebuild(refs: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Bodies from their pointers in order, a marker where the pool lacks a segment: key, `body`."""
    joined = refs.join(pool.select("content_hash", "content"), "content_hash", "left")
    text = F.coalesce("content", F.concat(F.lit("<missing segment "), "content_hash", F.lit(">")))
    parts = joined.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))).alias("_p"))
    return parts.select(key, F.array_join(F.transform("_p", lambda p: p["t"]), "\n\n").alias("body"))


def density(pool: DataFrame) -> DataFrame:
    """Share of references saved: max(0, 1 - entries / references), 0 without references: `entries`, `refs`, `density`."""
    t = pool.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("refs"), F.lit(0)).alias("refs"))
    return t.withColumn("density", F.when(F.col("refs") > 0, F.greatest(F.lit(0.0), 1 - F.col("entries") / F.col("refs"))).otherwise(F.lit(0.0)))


def similar_pairs(texts: DataFrame, group: str, key: str, text: str, bar: float) -> DataFrame:
    """Pairs of a group whose word sets have Jaccard >= bar: group, a, b, similarity (3 places).

    Candidates come from an inverted index, not from all pairs of a group: a pair at the bar shares at least one of the
    rarest words of both, size - ceil(bar * size) + 1 of them when words are ordered by frequency in the corpus. A rare
    word has few holders by construction. The sets are then compared exactly.
    """
    sets = texts.select(F.col(group).alias("g"), F.col(key).alias("k"), X.word_set(text).alias("w")).where("g is not null and k is not null and size(w) > 0").distinct()
    freq = sets.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("f"))
    ranked = sets.select("g", "k", F.size("w").alias("n"), F.explode("w").alias("word")).join(freq, "word").groupBy("g", "k", "n").agg(F.sort_array(F.collect_list(F.struct("f", "word"))).alias("o"))
    keep = (F.col("n") - F.ceil(bar * F.col("n") - 1e-9) + 1).cast("int")
    prefix = ranked.select("g", "k", "n", F.explode(F.slice("o", F.lit(1), keep)).alias("p")).select("g", "k", "n", F.col("p.word").alias("word"))
    a, b = (prefix.select("g", "word", F.col("k").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    met = a.join(b, ["g", "word"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= bar * F.greatest("na", "nb"))).select("g", "a", "b").distinct()
    s = sets.select("g", "k", "w")
    both = met.join(s.withColumnsRenamed({"k": "a", "w": "wa"}), ["g", "a"]).join(s.withColumnsRenamed({"k": "b", "w": "wb"}), ["g", "b"])
    return both.withColumn("j", X.jaccard("wa", "wb")).where(F.col("j") >= bar).select(F.col("g").alias(group), "a", "b", F.round("j", 3).alias("similarity"))


def entity_index(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted index of entities: `entity`, key (each once)."""
    return texts.where(F.col(text).isNotNull()).select(F.explode(X.entities(text)).alias("entity"), key).distinct()


def index_changes(texts: DataFrame, indexed: DataFrame, key: str, text: str) -> DataFrame:
    """What an incremental index build has to do: key, `action` (embed for new or changed texts, drop for vanished ones, keep).

    `indexed` has the key and `sha`, the hash of the text that was indexed.
    """
    now = texts.select(key, X.short_hash(F.coalesce(text, F.lit(""))).alias("_now"))
    both = now.join(indexed.select(key, F.col("sha").alias("_sha")), key, "full")
    return both.select(key, F.when(F.col("_now").isNull(), "drop").when(F.col("_sha").isNull() | (F.col("_sha") != F.col("_now")), "embed").otherwise("keep").alias("action"))
