"""Scorers of rankings and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranks(ranking: DataFrame, gold: DataFrame, query: str, item: str) -> DataFrame:
    """Rank of each query's gold item in `ranking` (query, item, rank); null when it is absent."""
    return gold.select(query, item).join(ranking.select(query, item, "rank"), [query, item], "left")


def recall_at(ranked: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Share of queries whose gold item is among the first k: `k`, `recall`."""
    return ranked.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "rank").groupBy("k").agg(F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("double"), F.lit(0.0))).alias("recall"))


def mean_reciprocal_rank(ranked: DataFrame) -> DataFrame:
    """Mean of 1 / rank, 0 for an absent item: `mrr`."""
    return ranked.agg(F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, 95th percentile (both interpolated), mean, least and greatest."""
    return df.groupBy(*keys).agg(
        F.expr(f"percentile({value}, 0.5)").alias("p50"), F.expr(f"percentile({value}, 0.95)").alias("p95"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def retention(before: DataFrame, after: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Share of rows that are still there, by group."""
    kept = after.select(key).distinct().withColumn("_kept", F.lit(1.0))
    return before.join(kept, key, "left").groupBy(*by).agg(F.avg(F.coalesce("_kept", F.lit(0.0))).alias("retained"))


def recall_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Difference of two recall tables by k."""
    return before.withColumnRenamed("recall", "before").join(after.withColumnRenamed("recall", "after"), "k").select("k", (F.col("after") - F.col("before")).alias("change"))


def recency_in_band(df: DataFrame, query: str, score: str, valid_from: str, item: str, band: float = 0.6) -> DataFrame:
    """Candidates within a share of the query's best score, newest first: adds `rank`."""
    best = F.max(score).over(Window.partitionBy(query))
    order = Window.partitionBy(query).orderBy(F.col(valid_from).desc_nulls_last(), F.col(score).desc(), F.col(item).desc())
    return df.withColumn("_best", best).where(F.col(score) >= band * F.col("_best")).withColumn("rank", F.row_number().over(order)).drop("_best")


def order_agreement(df: DataFrame, group: str, truth: str, given: str) -> DataFrame:
    """Whether each group's items come in the same order by both columns: `exact`."""
    lists = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(truth).alias("o"), F.col(given).alias("v")))).alias("x"))
    return lists.select(group, (F.transform("x", lambda e: e["v"]) == F.array_sort(F.transform("x", lambda e: e["v"]))).alias("exact"))
