"""Attributes as they were known at a day: periodic as-known snapshots plus change logs.

An item is usable on day D when it is valid by then and was known by then, so it becomes usable on
the later of the two days. The answer on D is the best item (latest `valid_from`, then latest first
record) among those usable by D; it only ever changes on such a day.

The store is written: for each key and month, from its first change on, the snapshot at the month's start and the month's
change log, one entry per day at most. An event meets its month's row (behind the last change, the last) by equi-joins and
replays the entries up to its own day. Only day-wise winners leave the map side, so a key with any number of items has at
most one row per month and one log of a month's days.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.runtime import broadcast_if_small, materialize

#: Spellings of a day that parse_day accepts, tried in order after the leading yyyy-MM-dd form.
DAY_FORMATS = ("yyyy/M/d", "yyyyMMdd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d.M.yyyy")
_NEVER = -10_000_000


def parse_day(text: str | Column) -> Column:
    """The day that a text spells, a time of day left aside; null for anything else."""
    raw = F.trim(F.col(text) if isinstance(text, str) else text)
    head = F.regexp_replace(raw, r"[T ]\d{1,2}:\d{2}.*$", "")
    tries = [F.try_to_timestamp(F.regexp_extract(head, r"^\d{4}-\d{1,2}-\d{1,2}", 0), F.lit("yyyy-M-d"))]
    tries += [F.try_to_timestamp(head, F.lit(f)) for f in DAY_FORMATS]
    return F.coalesce(*tries).cast("date")


def spelling_key(text: str | Column) -> Column:
    """Lower case, any run of white space, `_` or `-` one blank, outer blanks gone."""
    raw = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(raw), r"[\s\u0085   _\-]+", " "))


def _month(day: Column) -> Column:
    date = F.date_from_unix_date(day.cast("int"))
    return (F.year(date) * 12 + F.month(date)).cast("int")


def change_log(
    items: DataFrame, keys: Sequence[str], item_id: str, valid_from: str | Column, recorded_at: str | Column
) -> DataFrame:
    """Day-wise winners: `_k`, `_day` (it becomes usable), `_best` (struct that orders items).

    Of an id delivered again, the earliest `recorded_at` counts and the rest comes from that delivery. Items
    without id, key part or record time are left out; a null `valid_from` was true since ever.
    """
    start, known = (F.col(c) if isinstance(c, str) else c for c in (valid_from, recorded_at))
    once = (
        items.select(F.struct(*(F.col(k) for k in keys)).alias("_k"), F.col(item_id).alias("_id"), F.unix_date(start.cast("date")).alias("_from"), F.unix_micros(known.cast("timestamp")).alias("_known"))
        .where("_id is not null and _known is not null and " + " and ".join(f"_k.`{k}` is not null" for k in keys))
        .groupBy("_id").agg(F.min(F.struct("_known", "_from", "_k")).alias("_x"))
        .select("_id", "_x._known", "_x._from", "_x._k")
    )
    day = F.expr("cast(floor(_known / 86400000000) as int)")
    best = F.struct(F.coalesce("_from", F.lit(_NEVER)).alias("f"), F.col("_known").alias("r"), F.col("_id").alias("id"))
    return once.select("_k", F.greatest(F.coalesce("_from", F.lit(_NEVER)), day).alias("_day"), best.alias("_best")).groupBy("_k", "_day").agg(F.max("_best").alias("_best"))


@dataclass
class KnownStore:
    """Written tables. months: `_k`, `_month`, `_snapshot` (best before the month), `_log` (the month's changes by day), from a key's first
    month with a change to the month behind its last. spans: `_k`, `_last` (that month). Any number of event tables can be joined to it."""

    months: DataFrame
    spans: DataFrame


def snapshots(log: DataFrame) -> KnownStore:
    """The store of a change log. Per key there is a row a month, whatever its number of items, and a log of at most a month's days."""
    changes = log.groupBy("_k", _month(F.col("_day")).alias("_month")).agg(F.collect_list(F.struct(F.col("_day").alias("day"), F.col("_best").alias("best"))).alias("_log"), F.max("_best").alias("_top"))
    by_month = Window.partitionBy("_k").orderBy("_month")
    upto = F.max("_top").over(by_month.rowsBetween(Window.unboundedPreceding, 0))
    before = F.max("_top").over(by_month.rowsBetween(Window.unboundedPreceding, -1))
    following = F.lead("_month").over(by_month)
    placed = changes.select("_k", "_month", "_log", before.alias("_snapshot"), upto.alias("_upto"), following.alias("_next"))
    # a month of change as it is, then one row for each month without up to the next change (the first of them, behind the last change)
    quiet = F.sequence(F.col("_month") + 1, F.coalesce(F.col("_next") - 1, F.col("_month") + 1))
    own = placed.select("_k", "_month", "_snapshot", "_log")
    rest = placed.where("_next is null or _next > _month + 1").select("_k", F.explode(quiet).alias("_month"), F.col("_upto").alias("_snapshot"))
    months = materialize(own.unionByName(rest, allowMissingColumns=True), "as-known")
    return KnownStore(months, materialize(months.groupBy("_k").agg(F.max("_month").alias("_last")), "as-known-spans"))


def as_known(
    events: DataFrame,
    items: DataFrame,
    keys: Sequence[str],
    event_id: str,
    day: str | Column,
    item_id: str,
    valid_from: str | Column,
    recorded_at: str | Column,
    out_event: str = "event_id",
    out_item: str = "item_id",
) -> DataFrame:
    """Each event with the item that was true and already known on its day: `out_event`, `out_item`, `valid_from`, `known_at`.

    Events without day, key part or answer give no row. An event that occurs several times gives its row as many
    times. Ties beyond the latest `valid_from` and first record go to the greatest id. Empty tables give no rows.
    """
    at = F.col(day) if isinstance(day, str) else day
    asked = (
        events.select(F.struct(*(F.col(k) for k in keys)).alias("_k"), F.col(event_id).alias("_event"), F.unix_date(at.cast("date")).alias("_day"))
        .where("_day is not null and " + " and ".join(f"_k.`{k}` is not null" for k in keys))
    )
    store = snapshots(change_log(items, keys, item_id, valid_from, recorded_at))
    # either join meets one row per event; where a key is hot, its events may be split at will (AQE does so) as the other side is not
    met = asked.join(broadcast_if_small(store.spans), "_k").withColumn("_month", F.least(_month(F.col("_day")), "_last")).drop("_last")
    met = met.join(broadcast_if_small(store.months), ["_k", "_month"])
    usable = F.filter("_log", lambda c: c["day"] <= F.col("_day"))
    best = F.greatest(F.col("_snapshot"), F.array_max(F.transform(usable, lambda c: c["best"])))
    return (
        met.select("_event", best.alias("_b")).where("_b is not null")
        .select(
            F.col("_event").alias(out_event), F.col("_b.id").alias(out_item),
            F.when(F.col("_b.f") > _NEVER, F.date_from_unix_date(F.col("_b.f"))).alias("valid_from"),
            F.timestamp_micros(F.col("_b.r")).alias("known_at"),
        )
    )
