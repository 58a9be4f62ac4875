"""The general data-pipeline queries p1, p3 and p4 over the memory store's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators import asof, intervals, sessions
from mnemora.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Idle time in seconds beyond which a new session begins.
SESSION_GAP_S = 1800
#: Further thresholds that are read from the same tree.
SESSION_GAPS_S = (300, 1800, 7200, 86400)


def clean_sittings(spark: SparkSession, sf: str) -> DataFrame:
    """Each sitting once (its first delivery), without replay, null workspace or null t: workspace, us, n_events."""
    us = sessions.epoch_micros("t", "day").alias("us")
    # a sitting without an id is known by its content, so that a second delivery is the same sitting
    content = F.md5(F.to_json(F.struct("workspace", us, "events", "provenance")))
    rows = table(spark, sf, "sittings").select(
        F.coalesce(F.col("sitting_id").cast("string"), content).alias("id"), "arrived_at", "workspace",
        us, F.coalesce(F.size("events"), F.lit(0)).alias("n_events"), "provenance",
    )
    once = rows.groupBy("id").agg(F.min(F.struct("arrived_at", "workspace", "us", "n_events", "provenance")).alias("x")).select("x.*")
    return once.where("workspace is not null and us is not null and coalesce(provenance, 'genuine') <> 'replay'").select("workspace", "us", "n_events")


def _seconds(c: str):
    return F.floor(F.col(c) / 1_000_000).cast("bigint")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = sessions.sessions(clean_sittings(spark, sf), "workspace", "us", SESSION_GAP_S * 1_000_000)
    return found.select("workspace", _seconds("start_us").alias("start_s"), _seconds("end_us").alias("end_s"))


def p1_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Start, end, duration and counts at several thresholds, all cut from one stored tree."""
    tree = sessions.gap_tree(clean_sittings(spark, sf), "workspace", "us", "n_events")
    found = sessions.cut(tree, [g * 1_000_000 for g in SESSION_GAPS_S])
    return found.select(
        (F.col("gap_limit_us") / 1_000_000).cast("bigint").alias("gap_s"), "workspace", "start_us", "end_us",
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"), F.col("n_rows").alias("n_sittings"), F.col("weight").alias("n_events"),
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "raw_a3_temporal").where("kind = 'as_of' and id is not null").select("id", "subject", asof.spelling_key("attribute").alias("attribute"), asof.parse_day("as_of").alias("day"))
    queries = asked.groupBy("id").agg(F.min(F.when(F.col("day").isNotNull(), F.struct("day", "subject", "attribute"))).alias("x")).select("id", "x.*")
    items = table(spark, sf, "dataset").select("id", "subject", asof.spelling_key("attribute").alias("attribute"), "valid_from", "recorded_at")
    return asof.as_known(queries, items, ["subject", "attribute"], "id", "day", "id", "valid_from", "recorded_at", "query_id", "item_id").select("query_id", "item_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    found = intervals.periods_and_gaps(table(spark, sf, "chains"), "chain", "valid_from", "valid_to")
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("open")).alias(c)
    return found.select("kind", "chain", day("start_date"), day("end_date"))


_CLEAN = """once as (
  select workspace, us, n_events, provenance from (
    select workspace, provenance, coalesce(len(events), 0) n_events,
      case when floor(t / 86400) = day then cast(round(t * 1e6) as bigint)
           when floor(t / 86400000) = day or abs(t) >= 1e11 then cast(round(t * 1e3) as bigint)
           else cast(round(t * 1e6) as bigint) end us,
      row_number() over (partition by sitting_id order by arrived_at, workspace, t) rn
    from sittings) where rn = 1),
clean as (
  select workspace, us, n_events from once
  where workspace is not null and us is not null and coalesce(provenance, 'genuine') <> 'replay')"""

SQL: dict[str, str] = {
    "p1_found": f"""with {_CLEAN},
marked as (select *, case when us - lag(us) over (partition by workspace order by us) <= {SESSION_GAP_S} * 1000000 then 0 else 1 end brk from clean),
numbered as (select *, sum(brk) over (partition by workspace order by us rows unbounded preceding) s from marked)
select workspace, cast(floor(min(us) / 1e6) as bigint) start_s, cast(floor(max(us) / 1e6) as bigint) end_s from numbered group by workspace, s""",
    "p1_sessions": f"""with {_CLEAN},
gaps as (select unnest([{", ".join(map(str, SESSION_GAPS_S))}]::bigint[]) gap_s),
marked as (select *, case when us - lag(us) over (partition by gap_s, workspace order by us) <= gap_s * 1000000 then 0 else 1 end brk from clean, gaps),
numbered as (select *, sum(brk) over (partition by gap_s, workspace order by us rows unbounded preceding) s from marked)
select cast(gap_s as bigint) gap_s, workspace, min(us) start_us, max(us) end_us, (max(us) - min(us)) / 1e6 duration_s, count(*) n_sittings, cast(sum(n_events) as bigint) n_events
from numbered group by gap_s, workspace, s""",
    "p3_found": r"""with q as (
  select id, min(d) d, min(subject) subject, min(a) a from (
    select id, subject, trim(regexp_replace(lower(attribute), '[\s_\-]+', ' ', 'g')) a,
      coalesce(try_strptime(regexp_replace(trim(as_of), '[T ]\d{1,2}:\d{2}.*$', ''), ['%Y-%m-%d', '%Y/%m/%d', '%Y%m%d', '%d %b %Y', '%d %B %Y'])::date, null) d
    from raw_a3_temporal where kind = 'as_of') where d is not null group by id),
i as (
  select id, min(subject) subject, min(trim(regexp_replace(lower(attribute), '[\s_\-]+', ' ', 'g'))) a, min(valid_from) valid_from, min(recorded_at) r
  from dataset group by id),
r as (
  select q.id query_id, i.id item_id, row_number() over (partition by q.id order by coalesce(i.valid_from, date '0001-01-01') desc, i.r desc, i.id desc) n
  from q join i on q.subject = i.subject and q.a = i.a
  where (i.valid_from is null or i.valid_from <= q.d) and cast(i.r as date) <= q.d)
select query_id, item_id from r where n = 1""",
    "p4_found": """with c as (
  select chain, coalesce(valid_from, date '0001-01-01') f, case when valid_to is null or valid_to >= date '9999-12-31' then date '9999-12-31' else valid_to end u
  from chains where chain is not null and (valid_from is null or valid_to is null or valid_to >= valid_from)),
m as (select *, max(u) over (partition by chain order by f, u rows between unbounded preceding and 1 preceding) pu from c),
g as (select *, sum(case when pu is null or (pu < date '9999-12-31' and f > pu + 1) then 1 else 0 end) over (partition by chain order by f, u rows unbounded preceding) k from m),
p as (select chain, k, min(f) f, max(u) u from g group by chain, k),
n as (select *, lead(f) over (partition by chain order by f) nf from p)
select 'period' kind, chain, case when f = date '0001-01-01' then 'open' else strftime(f, '%Y-%m-%d') end start_date,
  case when u = date '9999-12-31' then 'open' else strftime(u, '%Y-%m-%d') end end_date from n
union all
select 'gap', chain, strftime(cast(u + 1 as date), '%Y-%m-%d'), strftime(cast(nf - 1 as date), '%Y-%m-%d') from n where nf is not null""",
}

QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_sessions": p1_sessions, "p3_found": p3_found, "p4_found": p4_found}
