"""Chains: dated edges between ordered members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.temporal import holds_at


def valid_edges(edges: DataFrame, at: str | Column) -> DataFrame:
    """Edges valid on a day."""
    return edges.where(holds_at(at, F.col("valid_from"), F.col("valid_to")))


def members_at(members: DataFrame, edges: DataFrame, at: str) -> DataFrame:
    """Members (`chain`, `node`) touched by an edge valid on the day; all members of chains without edges."""
    touched = valid_edges(edges, at).select("chain", F.explode(F.array("src", "dst")).alias("node")).distinct()
    without = members.join(edges.select("chain").distinct(), "chain", "left_anti")
    return members.join(touched, ["chain", "node"], "left_semi").unionByName(without.select(*members.columns))


def snapshot(edges: DataFrame, at: str) -> DataFrame:
    """Valid and all edges of every chain on a day: `chain`, `n_valid`, `n_edges`."""
    ok = holds_at(at, F.col("valid_from"), F.col("valid_to"))
    return edges.groupBy("chain").agg(F.count_if(ok).alias("n_valid"), F.count(F.lit(1)).alias("n_edges"))


def linear_edges(members: DataFrame) -> DataFrame:
    """Edges between consecutive members (`chain`, `pos`, `node`, `valid_from`): valid from the later of both days."""
    w = Window.partitionBy("chain").orderBy("pos")
    out = members.select("chain", "pos", F.col("node").alias("src"), F.lead("node").over(w).alias("dst"), "valid_from", F.lead("valid_from").over(w).alias("_n"))
    return out.where("dst is not null").select("chain", "pos", "src", "dst", F.greatest("valid_from", "_n").alias("valid_from"))


def previous_member(members: DataFrame) -> DataFrame:
    """Each member with the one before it: `previous` (null for the first)."""
    return members.withColumn("previous", F.lag("node").over(Window.partitionBy("chain").orderBy("pos")))


def add_edges(edges: DataFrame, members: DataFrame, new: DataFrame) -> DataFrame:
    """`edges` and those new ones whose both ends are members of the chain."""
    m = members.select("chain", "node").distinct()
    ok = new.join(m.withColumnRenamed("node", "src"), ["chain", "src"], "left_semi").join(m.withColumnRenamed("node", "dst"), ["chain", "dst"], "left_semi")
    return edges.unionByName(ok.select(*new.columns), allowMissingColumns=True).select(*edges.columns)


def close_edges(edges: DataFrame, which: DataFrame, on: str) -> DataFrame:
    """Open edges that match (`chain`, `src`, `dst`) end on the day; others stay."""
    hit = which.select("chain", "src", "dst", F.lit(True).alias("_hit")).distinct()
    end = F.lit(on).cast("date")
    still = F.col("valid_to").isNull() | (F.col("valid_to") > end)
    return edges.join(hit, ["chain", "src", "dst"], "left").withColumn("valid_to", F.when(F.col("_hit") & still, end).otherwise(F.col("valid_to"))).select(*edges.columns)


def set_edge(edges: DataFrame, change: DataFrame, key: str = "edge_id") -> DataFrame:
    """Dates and confidence of the latest edge (greatest key) of each (`chain`, `src`, `dst`) in `change` replaced; an edge that
    does not exist is added without a key."""
    w = Window.partitionBy("chain", "src", "dst").orderBy(F.col(key).desc_nulls_last())
    new = change.select("chain", "src", "dst", F.struct("valid_from", "valid_to", "confidence").alias("_new"))
    ranked = edges.withColumn("_rn", F.row_number().over(w)).join(new, ["chain", "src", "dst"], "left")
    use = (F.col("_rn") == 1) & F.col("_new").isNotNull()
    for c in ("valid_from", "valid_to", "confidence"):
        ranked = ranked.withColumn(c, F.when(use, F.col(f"_new.{c}")).otherwise(F.col(c)))
    fresh = change.join(edges.select("chain", "src", "dst").distinct(), ["chain", "src", "dst"], "left_anti")
    return ranked.select(*edges.columns).unionByName(fresh, allowMissingColumns=True).select(*edges.columns)


def strip_member(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without those of the given nodes (`id`)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)


def with_titles(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members with the title of their node, the id where there is none."""
    return members.join(nodes.select(F.col("id").alias("node"), "name"), "node", "left").withColumn("title", F.coalesce("name", "node")).drop("name")


def siblings(members: DataFrame, most: int = 6) -> DataFrame:
    """Each member (`chain`, `pos`, `node`) with the first other members of its chain: `siblings`.

    One more than `most` first members of a chain are enough for all its members.
    """
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy("chain").orderBy("pos", "node"))).where(F.col("_r") <= most + 1)
    heads = first.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("_r", "node"))).alias("_h"))
    others = F.filter(F.transform("_h", lambda h: h["node"]), lambda n: n != F.col("node"))
    return members.join(heads, "chain").withColumn("siblings", F.slice(others, 1, most)).drop("_h")


def context_text(members: DataFrame) -> DataFrame:
    """Preamble of each member from its chain and siblings (the structural form, for texts without a model)."""
    named = F.array_join("siblings", ", ")
    return siblings(members).select("chain", "node", F.when(F.size("siblings") > 0, F.concat(F.lit("Part of "), "chain", F.lit(" with "), named, F.lit("."))).otherwise(F.concat(F.lit("Part of "), "chain", F.lit("."))).alias("preamble"))
