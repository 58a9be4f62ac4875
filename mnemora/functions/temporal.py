"""Interval predicates and time stamps. Both ends of a validity interval are inclusive; null is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: str | Column) -> Column:
    return F.lit(x).cast("date") if isinstance(x, str) else x


def holds_at(at: str | Column, valid_from: Column, valid_to: Column) -> Column:
    """Whether the interval contains the day."""
    at = _d(at)
    return F.coalesce(valid_from <= at, F.lit(True)) & F.coalesce(at <= valid_to, F.lit(True))


def holds_since(day: str | Column, valid_to: Column) -> Column:
    """Whether the interval has not ended before the day."""
    return F.coalesce(valid_to >= _d(day), F.lit(True))


def overlaps(low: str | Column, high: str | Column, valid_from: Column, valid_to: Column) -> Column:
    """Whether the interval meets [low, high]."""
    return F.coalesce(valid_to >= _d(low), F.lit(True)) & F.coalesce(valid_from <= _d(high), F.lit(True))


def infer_valid_from(last_access: Column, body: Column, fallback: Column) -> Column:
    """Last access, else the earliest day of this century that the body names, else the fallback."""
    named = F.array_min(F.transform(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"\b(20\d\d-[01]\d-[0-3]\d)\b"), 1), lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).cast("date")))
    return F.coalesce(last_access, named, fallback)


def to_utc_text(ts: str | Column, zone: str = "UTC") -> Column:
    """ISO text in UTC; a text without an offset is taken as local time of `zone`. Null for what is no time."""
    c = F.col(ts) if isinstance(ts, str) else ts
    aware = c.rlike(r"([+-]\d\d:?\d\d|Z)$")
    local = F.to_utc_timestamp(c.try_cast("timestamp_ntz").cast("timestamp"), zone)
    at = F.when(aware, c.try_cast("timestamp")).otherwise(local)
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def is_utc_text(ts: str | Column) -> Column:
    """Whether an ISO text says that it is UTC."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.coalesce(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(\+00:00|Z)$"), F.lit(False))
