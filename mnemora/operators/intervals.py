"""Continuous periods and gaps of day intervals, on Spark's session_window with a row-specific duration.

A day is placed on the time axis as one second, so that durations are plain seconds and no calendar or
daylight-saving rule touches them. Intervals are merged twice: within (entity, block of start days),
which shrinks a hot entity in many tasks, then per entity. What reaches the second merge is bounded by
the calendar: an entity has at most one period for every second day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stand-ins for open ends, far outside the range of dates (days since 1970-01-01).
OPEN_START, OPEN_END = -10_000_000, 10_000_000
#: Days of starts merged together before the shuffle by entity.
BLOCK_DAYS = 366

_CLEAR = ("_entity", "_from", "_until", "_block", "_w")


def _merge(df: DataFrame, *keys: str) -> DataFrame:
    """Merge [_from, _until) per keys; neighbours that touch are one."""
    span = F.session_window(F.timestamp_seconds(F.col("_from")), F.make_interval(secs=(F.col("_until") - F.col("_from")).cast("decimal(18,6)")))
    return df.groupBy(*keys, span.alias("_w")).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, F.unix_seconds("_w.start").alias("_from"), F.unix_seconds("_w.end").alias("_until")
    )


def intervals(df: DataFrame, entity: str, valid_from: str | Column, valid_to: str | Column) -> DataFrame:
    """Clean half-open intervals (`_entity`, `_from`, `_until`) in days.

    Both ends are inclusive days. A null start or end is open, and so is an end of 9999-12-31. Rows with a null
    entity and intervals that end before they begin are left out; a repeated row changes nothing.
    """
    start, end = (F.col(c) if isinstance(c, str) else c for c in (valid_from, valid_to))
    return df.select(
        F.col(entity).alias("_entity"),
        F.coalesce(F.unix_date(start.cast("date")), F.lit(OPEN_START)).cast("bigint").alias("_from"),
        F.when(end.isNull() | (end.cast("date") >= F.lit("9999-12-31").cast("date")), OPEN_END).otherwise(F.unix_date(end.cast("date")) + 1).cast("bigint").alias("_until"),
    ).where("_entity is not null and _from < _until")


def periods(df: DataFrame, entity: str, valid_from: str | Column, valid_to: str | Column) -> DataFrame:
    """Maximal continuous periods: the entity, `start_date`, `end_date` (inclusive; null is open).

    Intervals that overlap, nest or follow each other without a free day are one period. Null, empty and
    repetition rules are those of `intervals`; an empty table gives no rows.
    """
    return _dates(_periods(df, entity, valid_from, valid_to), entity)


def _periods(df: DataFrame, entity: str, valid_from: str | Column, valid_to: str | Column) -> DataFrame:
    rows = intervals(df, entity, valid_from, valid_to)
    blocks = _merge(rows.withColumn("_block", F.expr(f"_from div {BLOCK_DAYS}")), "_entity", "_block")
    merged = _merge(blocks, "_entity")
    # touching periods: joined here whatever the window's own rule for equal ends is
    order = Window.partitionBy("_entity").orderBy("_from")
    apart = F.coalesce((F.col("_from") > F.lag("_until").over(order)).cast("int"), F.lit(1))
    return (
        merged.withColumn("_w", F.sum(apart).over(order))
        .groupBy("_entity", "_w").agg(F.min("_from").alias("_from"), F.max("_until").alias("_until")).drop("_w")
    )


def _dates(df: DataFrame, entity: str) -> DataFrame:
    return df.select(
        F.col("_entity").alias(entity),
        F.when(F.col("_from") > OPEN_START, F.date_from_unix_date(F.col("_from").cast("int"))).alias("start_date"),
        F.when(F.col("_until") < OPEN_END, F.date_from_unix_date((F.col("_until") - 1).cast("int"))).alias("end_date"),
    )


def periods_and_gaps(df: DataFrame, entity: str, valid_from: str | Column, valid_to: str | Column) -> DataFrame:
    """Periods and the gaps between neighbouring ones: `kind` (period, gap), the entity, `start_date`, `end_date`.

    A gap has both dates. Rules as in `periods`.
    """
    found = _periods(df, entity, valid_from, valid_to)
    following = F.lead("_from").over(Window.partitionBy("_entity").orderBy("_from"))
    both = found.withColumn("_next", following).select(
        "_entity",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("period").alias("kind"), "_from", "_until"),
                    F.when(F.col("_next").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("_until").alias("_from"), F.col("_next").alias("_until"))),
                )
            )
        ).alias("_x"),
    )
    flat = both.select("_entity", "_x.kind", "_x._from", "_x._until")
    return flat.select("kind", "_entity", "_from", "_until").transform(
        lambda d: d.select(
            "kind",
            F.col("_entity").alias(entity),
            F.when(F.col("_from") > OPEN_START, F.date_from_unix_date(F.col("_from").cast("int"))).alias("start_date"),
            F.when(F.col("_until") < OPEN_END, F.date_from_unix_date((F.col("_until") - 1).cast("int"))).alias("end_date"),
        )
    )
