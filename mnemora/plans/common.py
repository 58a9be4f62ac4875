"""Shared views of the memory store's tables for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators.state import latest_per_key
from mnemora.sources.tables import table

#: The moment that stands for "now".
TODAY, NOW = "2010-03-01", 1267401600.0

_TIE = ("access_count", "valid_from", "valid_to", "last_access", "name", "description", "relevance")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every node once: of re-exported rows the one with most accesses."""
    return latest_per_key(table(spark, sf, "nodes").where("id is not null"), ["id"], list(_TIE))


def all_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes and the standing nodes that every workspace shares."""
    return nodes(spark, sf).unionByName(table(spark, sf, "core_nodes"))


def chain_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every chain edge once: its first delivery."""
    return latest_per_key(table(spark, sf, "chains").where("edge_id is not null"), ["edge_id"], ["recorded_at"], newest=False)


def web_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Tallies of the web: per (src, dst, ref_kind), ids without `.md`, the latest row; no self edges; a null count is 1."""
    raw = table(spark, sf, "edges").select(
        F.regexp_replace("src_node", r"\.md$", "").alias("src"), F.regexp_replace("dst_node", r"\.md$", "").alias("dst"), "ref_kind",
        F.coalesce("occurrence_count", F.lit(1)).alias("n"), "first_seen_at", "last_seen_at", "weight",
    ).where("src <> dst and ref_kind is not null")
    return latest_per_key(raw, ["src", "dst", "ref_kind"], ["last_seen_at", "n", "weight"])


def pair_web(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected co-activation pairs: a < b, count summed over both directions, greatest weight, first and last sight."""
    e = web_edges(spark, sf).where("ref_kind = 'coactivation'")
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sum("n").alias("n"), F.max(F.coalesce("weight", F.lit(0.0))).alias("w"), F.min("first_seen_at").alias("first_seen"), F.max("last_seen_at").alias("last_seen")
    )


_ORDER = ", ".join(f"{c} desc nulls last" for c in _TIE)
NODES_SQL = f"""nd as (select * exclude (rn) from (select *, row_number() over (partition by id order by {_ORDER}) rn from nodes where id is not null) where rn = 1)"""
ALL_NODES_SQL = f"{NODES_SQL},\nan as (select * from nd union all by name select * from core_nodes)"
CHAIN_SQL = """ce as (select * exclude (rn) from (select *, row_number() over (partition by edge_id order by recorded_at) rn from chains where edge_id is not null) where rn = 1)"""
WEB_SQL = r"""we as (select * exclude (rn) from (select *, row_number() over (partition by src, dst, ref_kind order by last_seen_at desc nulls last, n desc, weight desc nulls last) rn from (
  select regexp_replace(src_node, '\.md$', '') src, regexp_replace(dst_node, '\.md$', '') dst, ref_kind, coalesce(occurrence_count, 1) n, first_seen_at, last_seen_at, weight from edges)
  where src <> dst and ref_kind is not null) where rn = 1)"""
PAIR_SQL = f"""{WEB_SQL},
pw as (select least(src, dst) a, greatest(src, dst) b, sum(n)::bigint n, max(coalesce(weight, 0.0)) w, min(first_seen_at) first_seen, max(last_seen_at) last_seen
  from we where ref_kind = 'coactivation' group by 1, 2)"""
