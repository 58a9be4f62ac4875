"""Keyed state over tables: latest record, bounded recency sets, upserts and streaks. All are pure functions of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], newest: bool = True) -> DataFrame:
    """One row per key: the greatest (or least) by `order`, nulls last in either direction.

    Aggregates before the shuffle, so that a hot key sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not _sortable(df, rest):
        w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() if newest else F.col(c).asc_nulls_last() for c in order))
        return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    # in an ordered struct null is least: right for the greatest row; for the least one a flag puts it last
    rank = [F.col(c) for c in order] if newest else [x for c in order for x in (F.col(c).isNull(), F.col(c))]
    row = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(rank)), *(F.col(c).alias(f"_v{j}") for j, c in enumerate(rest)))
    best = F.max(row) if newest else F.min(row)
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *(F.col(f"_b._v{j}").alias(c) for j, c in enumerate(rest))).select(*df.columns)


def _sortable(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether all columns can be part of an ordered struct (maps and variants can't)."""
    kinds = dict(df.dtypes)
    return not any(k in kinds[c] for c in columns for k in ("map<", "variant"))


def drop_tombstones(df: DataFrame, keys: Sequence[str], order: Sequence[str], deleted: str) -> DataFrame:
    """Latest record per key of a log, without keys whose latest record is a deletion."""
    return latest_per_key(df, keys, order).where(~F.coalesce(F.col(deleted), F.lit(False)))


def keep_newest(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The `limit` greatest rows by `order` (nulls last): a distributed top-k."""
    return df.orderBy(*(F.col(c).desc_nulls_last() for c in order)).limit(limit)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], updates: dict[str, Column], inserts: dict[str, Column] | None = None) -> DataFrame:
    """`current` with `changes` merged by key (each side has a key once).

    `updates` gives new values for matched rows, in terms of `cur.<column>` and `new.<column>`; `inserts` those of
    rows that are new (default: the same-named column of `changes`, else null). Other rows stay.
    """
    both = current.select(*keys, F.struct(*current.columns).alias("cur")).join(changes.select(*keys, F.struct(*changes.columns).alias("new")), list(keys), "full")
    out = []
    for c in current.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        fresh = (inserts or {}).get(c, F.col(f"new.{c}") if c in changes.columns else F.lit(None))
        kept = updates.get(c, F.col(f"cur.{c}"))
        out.append(F.when(F.col("cur").isNull(), fresh).when(F.col("new").isNull(), F.col(f"cur.{c}")).otherwise(kept).cast(current.schema[c].dataType).alias(c))
    return both.select(*out)


def insert_missing(current: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`current` and those rows (each key once) whose key it lacks."""
    return current.unionByName(rows.dropDuplicates(list(keys)).join(current.select(*keys), list(keys), "left_anti").select(*current.columns))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """Length of the run of equal values that each row is in so far: adds `run` (1 for the first). Rows whose value is null
    take no part: their run is null and they break nothing."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = df.withColumn("_v", value)
    prior = F.last(F.col("_v"), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    change = F.when(F.col("_v").isNotNull(), F.coalesce((F.col("_v") != prior).cast("int"), F.lit(1))).otherwise(0)
    marked = seen.withColumn("_g", F.sum(change).over(w))
    part = Window.partitionBy(*keys, "_g").orderBy(*order)
    count = F.sum(F.col("_v").isNotNull().cast("int")).over(part)
    return marked.withColumn("run", F.when(F.col("_v").isNotNull(), count)).drop("_v", "_g")


def rate_limited(df: DataFrame, keys: Sequence[str], at: str, seconds: int) -> DataFrame:
    """Rows at least `seconds` behind the key's previous row (epoch seconds in `at`); the first always."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    return df.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= seconds)).drop("_gap")
