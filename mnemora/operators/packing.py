"""Packing ranked rows under a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_budget(df: DataFrame, keys: Sequence[str], order: Sequence, size: str, budget: int) -> DataFrame:
    """Rows per key in order while the running size stays within the budget; adds `total`.

    Without keys the order is global: first the smallest rows in order that can matter are kept by a distributed
    top-k (each row counts 1 at least), so that the window sees at most `budget` rows and those of size 0 before them.
    """
    if not keys and dict(df.dtypes)[size] in ("int", "bigint"):
        some = df.where(F.col(size) > 0).orderBy(*order).limit(budget + 1)
        bound = some.agg(F.max(F.struct(*(F.col(c) for c in order))).alias("_m")) if all(isinstance(c, str) for c in order) else None
        if bound is not None:
            df = df.crossJoin(F.broadcast(bound)).where(F.col("_m").isNull() | (F.struct(*(F.col(c) for c in order)) <= F.col("_m"))).drop("_m")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.sum(size).over(w)).where(F.col("total") <= budget)


def first_fit_taken(df: DataFrame, keys: Sequence[str], order: Sequence, size: str, budget: int) -> DataFrame:
    """The rows that a walk per key takes, out of any number of candidates: in order, a row is taken if it still fits, else skipped.
    Sizes are whole and not negative; the order must be total.

    What is left of the budget only shrinks, so of the rows of one size those taken are the first in order, budget / size of
    them at most. Only these are walked; no other row can be taken. They number budget * (1 + 1/2 + 1/3 + ...) at most, and
    row_number() up to a constant drops most others before the shuffle. The walk remembers what it took, budget rows at most.
    Rows of size 0 always fit.
    """
    small = df.where(F.col(size) <= budget)
    alike = F.row_number().over(Window.partitionBy(*keys, size).orderBy(*order))
    near = small.where(F.col(size) > 0).withColumn("_k", alike).where((F.col("_k") <= budget) & (F.col("_k") * F.col(size) <= budget))
    ranked = near.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    entry = F.struct(F.col("_k").alias("k"), F.col(size).cast("bigint").alias("s"), F.struct(*df.columns).alias("r"))
    per_key = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.expr("cast(array() as array<int>)").alias("took"))

    def step(s, x):
        fits = s["spent"] + x["s"] <= budget
        return F.when(fits, F.struct((s["spent"] + x["s"]).alias("spent"), F.array_append(s["took"], x["k"]).alias("took"))).otherwise(s)

    walked = per_key.select("_all", F.aggregate("_all", start, step).alias("_w")).select(F.explode(F.transform("_w.took", lambda k: F.get("_all", k - 1))).alias("_x"))
    return walked.select("_x.r.*").unionByName(small.where(F.col(size) == 0))


def first_fit(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """All rows with `taken`, see first_fit_taken; the columns of keys and order together are one row's."""
    named = [*dict.fromkeys([*keys, *order])]
    took = first_fit_taken(df.select(*dict.fromkeys([*named, size])), keys, order, size, budget).select(*named, F.lit(True).alias("taken"))
    took = took.select(*(F.col(c).alias(f"_t_{c}") for c in named), "taken")
    same = F.lit(True)
    for c in named:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    return df.join(took, same, "left").select(*df.columns, F.coalesce("taken", F.lit(False)).alias("taken"))
