"""Queries over sittings, the web of edges and chains; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import scores as S
from mnemora.operators import chains as C
from mnemora.operators import coactivation as A
from mnemora.operators import graph as G
from mnemora.plans.common import ALL_NODES_SQL, CHAIN_SQL, NODES_SQL, PAIR_SQL, TODAY, WEB_SQL, all_nodes, chain_edges, nodes, pair_web, web_edges
from mnemora.plans.problems import _CLEAN
from mnemora.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
AT = "2015-06-01"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sittings(spark: SparkSession, sf: str) -> DataFrame:
    """Every sitting once, without replay: id, workspace, us, day, nodes (distinct, sorted), events, event_sources, provenance."""
    from mnemora.operators.sessions import epoch_micros
    from mnemora.operators.state import latest_per_key

    once = latest_per_key(table(spark, sf, "sittings").where("sitting_id is not null"), ["sitting_id"], ["arrived_at"], newest=False)
    us = epoch_micros("t", "day")
    return once.where("coalesce(provenance, 'genuine') <> 'replay'").select(
        F.col("sitting_id").alias("id"), "workspace", us.alias("us"), F.floor(us / 86400e6).cast("bigint").alias("day"), A.without_stop_nodes(A.clean_nodes(F.col("events"))).alias("nodes"),
        "events", "event_sources", F.coalesce("provenance", F.lit("genuine")).alias("provenance"),
    )


_US = """case when floor(t / 86400) = day then cast(round(t * 1e6) as bigint) when floor(t / 86400000) = day or abs(t) >= 1e11 then cast(round(t * 1e3) as bigint) else cast(round(t * 1e6) as bigint) end"""
_SIT = rf"""sit as (select sitting_id id, workspace, us, cast(floor(us / 86400e6) as bigint) d, list_sort(list_distinct(list_transform(flatten(events), lambda x: regexp_replace(x, '\.md$', '')))) nodes, events, event_sources, coalesce(provenance, 'genuine') provenance
  from (select *, {_US} us, row_number() over (partition by sitting_id order by arrived_at) rn from sittings where sitting_id is not null) where rn = 1 and coalesce(provenance, 'genuine') <> 'replay')"""

_ORDER_SIT = _SIT.replace(" nodes, events,", " nodes, query_hash, events,")


@query(f"""with {_CLEAN}, o as (select us, n_events from clean),
marked as (select *, case when us - lag(us) over (order by us) <= 1800000000 then 0 else 1 end brk from o),
numbered as (select *, sum(brk) over (order by us rows unbounded preceding) s from marked)
select min(us) start_us, max(us) end_us, count(*) n_sittings, cast(sum(n_events) as bigint) n_events from numbered group by s""")
def q_occasions(spark: SparkSession, sf: str) -> DataFrame:
    """Occasions of the whole store: one timeline cut at half an hour without a sitting."""
    from mnemora.operators.sessions import sessions
    from mnemora.plans.problems import clean_sittings

    one = clean_sittings(spark, sf).withColumn("store", F.lit("all"))
    return sessions(one, "store", "us", 1_800_000_000, "n_events").select("start_us", "end_us", F.col("n_rows").alias("n_sittings"), F.col("weight").alias("n_events"))


@query("""with s as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minute then 0 else 1 end b from events),
n as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) g from s)
select user_id, min(ts) start_at, max(ts) end_at, count(*) n from n group by user_id, g""")
def q_user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of every user in the event stream."""
    from mnemora.operators.sessions import sessions

    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = sessions(e, "user_id", "us", 1_800_000_000)
    back = lambda c: F.timestamp_micros(c).cast("timestamp_ntz") if dict(table(spark, sf, "events").dtypes)["ts"] == "timestamp_ntz" else F.timestamp_micros(c)
    return out.select("user_id", back(F.col("start_us")).alias("start_at"), back(F.col("end_us")).alias("end_at"), F.col("n_rows").alias("n"))


@query(f"""with {_SIT}, m as (select id, unnest(nodes) node from sit), na as (select node, count(*) n from m group by node), tot as (select count(*) n from sit),
nab as (select x.node a, y.node b, count(*) n from m x join m y on x.id = y.id and x.node < y.node group by 1, 2)
select a, b, nab.n n_ab, round(nab.n::double * tot.n / (p.n::double * q.n), 6) lift from nab join na p on p.node = a join na q on q.node = b, tot""")
def q_lift(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs with their lift."""
    return A.pair_lift(sittings(spark, sf), "nodes").select("a", "b", "n_ab", F.round("lift", 6).alias("lift"))


@query(f"""with {_SIT}, m as (select id, d, unnest(nodes) node from sit) select node, count(*) n, count(distinct d) n_days, min(d) first_day, max(d) last_day from m group by node""")
def q_occ_marginals(spark: SparkSession, sf: str) -> DataFrame:
    """Sittings and days of every node."""
    m = sittings(spark, sf).select("day", F.explode("nodes").alias("node"))
    return m.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(rf"""with {_SIT}, e as (select id, unnest(events) ev, unnest(range(1, len(events) + 1)) i, event_sources from sit),
g as (select id, list_sort(list_distinct(list_transform(ev, lambda x: regexp_replace(x, '\.md$', '')))) u from e where coalesce(event_sources[i], 'genuine') in ('genuine', 'operator', 'cohort_validated')),
x as (select id, u, unnest(u) a, unnest(range(1, len(u) + 1)) i from g), p as (select distinct id, a, unnest(u[i + 1:]) b from x)
select a, b, count(*) n from p group by a, b""")
def q_genuine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that meet in one genuine event, counted by sitting."""
    return A.genuine_pairs(sittings(spark, sf).select("id", "events", "event_sources"), "events", "event_sources").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_SIT}, o as (select id, nodes, unnest(nodes) node from sit), x as (select a.node, len(a.nodes) m, len(b.nodes) n, len(list_intersect(a.nodes, b.nodes)) - 1 i from o a join o b on a.node = b.node and a.id < b.id)
select node, count(*) n, round(avg(case when m + n = 2 then 0.0 else 1 - i / (m + n - 2 - i)::double end), 6) distance from x group by node""")
def q_njd(spark: SparkSession, sf: str) -> DataFrame:
    """How much the company of each node differs between its sittings, over all pairs of them."""
    return A.neighbourhood_distance(sittings(spark, sf), "id", "nodes").select("node", "n", F.round("distance", 6).alias("distance"))


@query(f"with {PAIR_SQL} select a, b, n, round(1 - pow({1 - S.EMA!r}, n), 6) w, 1 - pow({1 - S.EMA!r}, n) >= 0.85 and n >= 3 promotable from pw")
def q_pair_ema(spark: SparkSession, sf: str) -> DataFrame:
    """Weights in closed form, as if every tally were genuine."""
    p = pair_web(spark, sf).withColumn("e", S.ema_weight("n"))
    return p.select("a", "b", "n", F.round("e", 6).alias("w"), S.promotable("e", "n").alias("promotable"))


@query(rf"""with recursive once as (select sitting_id id, {_US} us, list_sort(list_distinct(list_transform(flatten(events), lambda x: regexp_replace(x, '\.md$', '')))) nodes, coalesce(provenance, 'genuine') = 'replay' r
  from (select *, row_number() over (partition by sitting_id order by arrived_at) rn from sittings where sitting_id is not null and t is not null) where rn = 1),
x as (select id, us, r, nodes, unnest(nodes) a, unnest(range(1, len(nodes) + 1)) i from once), p as (select us, r, a, unnest(nodes[i + 1:]) b from x),
q as (select *, row_number() over (partition by a, b order by us, r) k from p),
f(a, b, k, w, g, c) as (
  select a, b, k, case when r then least(0.83, {0.5 * S.EMA!r}) else {S.EMA!r}::double end, (not r)::int, 1 from q where k = 1
  union all select q.a, q.b, q.k, case when q.r then case when f.g < 3 then least(0.83, f.w + {0.5 * S.EMA!r} * (1.0 - f.w)) else f.w + {0.5 * S.EMA!r} * (1.0 - f.w) end else f.w + {S.EMA!r} * (1.0 - f.w) end, f.g + (not q.r)::int, f.c + 1
  from f join q on q.a = f.a and q.b = f.b and q.k = f.k + 1)
select a, b, round(arg_max(w, k), 6) w, max(c)::bigint n, max(g)::bigint n_genuine from f group by a, b""")
def q_pair_ema_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Weights folded in order of time, replay included."""
    from mnemora.operators.sessions import epoch_micros
    from mnemora.operators.state import latest_per_key

    once = latest_per_key(table(spark, sf, "sittings").where("sitting_id is not null and t is not null"), ["sitting_id"], ["arrived_at"], newest=False)
    rec = once.select(F.timestamp_micros(epoch_micros("t", "day")).alias("at"), "provenance", A.clean_nodes(F.col("events")).alias("nodes"))
    return A.weight_fold(A.pairs(rec, "nodes"), "at", "provenance").select("a", "b", F.round("w", 6).alias("w"), F.col("count").alias("n"), F.col("count_genuine").alias("n_genuine"))


_ACCRUE = rf"""with recursive {_SIT}, {ALL_NODES_SQL}, sal as (select id node, max(coalesce(salience, 0.5)) s from an group by id),
ev as (select id, cast(floor(us / 1e6) as bigint) tt, provenance, unnest(events) e from sit where us is not null),
u as (select id, tt, provenance, list_sort(list_distinct(list_transform(e, lambda x: regexp_replace(x, '\.md$', '')))) u from ev), x as (select *, unnest(u) a, unnest(range(1, len(u) + 1)) i from u),
t as (select id, tt, provenance, a, b, count(*) m from (select id, tt, provenance, a, unnest(u[i + 1:]) b from x) group by all),
births as (select node, f, count(*) n from (select unnest([a, b]) node, f from (select a, b, min(tt) f from t group by 1, 2)) group by 1, 2),
asked as (select distinct unnest([a, b]) node, tt from t), deg as (select asked.node, asked.tt, coalesce(sum(n) filter (f < tt), 0) d from asked left join births using (node) group by 1, 2),
z as (select t.a, t.b, t.tt::double t, m::double m, sqrt(greatest(0.0, coalesce(sa.s, 0.0)) * greatest(0.0, coalesce(sb.s, 0.0))) * least(1.0, m / 2.99) * greatest(0.27, 1 / (1 + 0.59 * ln(1 + da.d::double * db.d)))
  * case provenance when 'operator' then 1.3 when 'cohort_validated' then 1.19 else 1.0 end score
  from t left join sal sa on sa.node = t.a left join sal sb on sb.node = t.b join deg da on da.node = t.a and da.tt = t.tt join deg db on db.node = t.b and db.tt = t.tt),
q as (select *, row_number() over (partition by a, b order by t, m, score) k from z),
f(a, b, k, kept, day, w, n, last, s, tau, reps, ease, iv) as (
  select distinct a, b, 0::bigint, false, 0.0::double, 0.0::double, 0::bigint, null::double, 0.0::double, 172800.0::double, 0::bigint, 2.5::double, 0.0::double from q union all
  select a, b, k, kept1, case when kept1 then day1 else day end, case when counts then w1 + {S.EMA!r} * (1 - w1) when kept1 then w1 else w end, n + counts::int, case when counts then t else last end, case when counts then s1 else s end,
    case when counts then case when spaced then least(8640000.0, 172800.0 * greatest(1.0, iv2)) else tau1 end else tau end, case when counts then reps2 else reps end, case when counts then ease2 else ease end, case when counts then iv2 else iv end
  from (select *, case when spaced then case reps2 when 1 then 1.0 when 2 then 6.0 else iv1 * ease2 end else iv1 end iv2, least(remains + gain, case when spaced or reps1 >= 2 then 6.0 else 3.0 - 1e-6 end) s1, kept1 and score >= 0.073 counts
  from (select *, reps1 + spaced::int reps2, case when spaced and reps1 + 1 >= 3 then greatest(1.3, ease1 + 0.1) else ease1 end ease2,
    case when spaced then case when anew then 1.0 else 1.6 end else 1 - exp(-greatest(0.0, gap) / 28800.0) end * (1 - exp(-m / 1.2)) gain
  from (select *, gap >= 86400 spaced from (select *, case when anew then 0.0 else kept_s end remains, case when anew then 86400.0 else t - last end gap, case when anew then 172800.0 else tau end tau1, case when anew then 0 else reps end reps1,
    case when anew then 2.5 else ease end ease1, case when anew then 0.0 else iv end iv1
  from (select *, last is null or kept_s <= 0.05 anew from (
    select f.a, f.b, q.k, q.t, q.m, q.score, f.kept, f.day, f.w, f.n, f.last, f.s, f.tau, f.reps, f.ease, f.iv, f.kept or q.score >= 0.099 kept1, floor(q.t / 86400) day1,
      f.w * pow(0.995, case when f.kept then greatest(0.0, floor(q.t / 86400) - f.day) else 0.0 end) w1, f.s * exp(-greatest(0.0, coalesce(q.t - f.last, 0.0)) / f.tau) kept_s
    from f join q on q.a = f.a and q.b = f.b and q.k = f.k + 1))))))),
l as (select a, b, arg_max(n, k) qualified, arg_max(w, k) * pow(0.995, greatest(0.0, 14669 - arg_max(day, k))) w, case when max(last) is null then 0.0 else arg_max(s, k) * exp(-greatest(0.0, 14669 * 86400.0 - max(last)) / arg_max(tau, k)) end s, arg_max(reps, k) reps, bool_or(kept) kept from f group by a, b)
select a, b, qualified, round(s, 6) strength, round(w, 6) w, reps, case when w < 0.85 then 'none' when s >= 3 then 'strong' when s >= 1.5 then 'weak' else 'none' end tier from l where kept"""


@query(_ACCRUE)
def q_accrue(spark: SparkSession, sf: str) -> DataFrame:
    """Spaced-repetition strength of every pair."""
    s = sittings(spark, sf).where("us is not null").select("id", F.floor(F.col("us") / 1e6).cast("bigint").alias("at"), "events", "provenance")
    sal = all_nodes(spark, sf).select(F.col("id").alias("node"), F.coalesce("salience", F.lit(0.5)).alias("salience"))
    found = A.accrue(A.occasion_pairs(s, "id", "at", "events", "provenance"), sal, "id", "at", "provenance", 1267401600.0)
    return found.withColumns({"strength": F.round("strength", 6), "w": F.round("w", 6)})


@query(f"""with {PAIR_SQL}, e as (select a node, a, b, w from pw union all select b, a, b, w from pw), r as (select *, row_number() over (partition by node order by w desc nulls last, a desc, b desc) rn from e)
select a, b, w from r where rn <= 32 group by a, b, w having count(*) = 2""")
def q_degree_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs among the 32 heaviest of both ends."""
    return G.degree_cap(pair_web(spark, sf).select("a", "b", "w"))


@query(f"""with {PAIR_SQL}, s as (select node, sum(w) s from (select a node, w from pw union all select b, w from pw) group by node), f as (select node, case when s > 4 then 4.0 / s else 1.0 end f from s)
select a, b, round(w * least(x.f, y.f), 6) scaled from pw join f x on x.node = a join f y on y.node = b""")
def q_scaling(spark: SparkSession, sf: str) -> DataFrame:
    """Weights scaled so that no node carries more than 4."""
    return G.scale_down(pair_web(spark, sf).select("a", "b", "w")).select("a", "b", F.round("scaled", 6).alias("scaled"))


@query(f"""with {PAIR_SQL}, d as (select a, b, w * greatest(0.0, 1 - 0.005 * greatest(date_diff('day', cast(last_seen as date), date '{TODAY}'), 0)) w from pw) select a, b, round(w, 8) w from d where w >= 0.05""")
def q_edge_decay(spark: SparkSession, sf: str) -> DataFrame:
    """Weights faded since last sight; those below 0.05 are pruned."""
    days = F.greatest(F.datediff(F.lit(TODAY).cast("date"), F.col("last_seen").cast("date")), F.lit(0))
    return pair_web(spark, sf).select("a", "b", S.edge_decay("w", days).alias("w")).where("w >= 0.05").select("a", "b", F.round("w", 8).alias("w"))


@query(f"""with {WEB_SQL}, {NODES_SQL} select src, dst, ref_kind, case when x.id is null and y.id is null then 'both' when x.id is null then 'src' else 'dst' end missing
from we left join nd x on x.id = src left join nd y on y.id = dst where x.id is null or y.id is null""")
def q_ghost_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Web edges with an end that is no node of the workspace's own table."""
    return G.ghost_edges(web_edges(spark, sf).select("src", "dst", "ref_kind"), nodes(spark, sf))


_BOTH = "bw as (select a src, b dst, w from pw union all select b, a, w from pw)"


@query(f"with {PAIR_SQL}, {_BOTH}, s as (select src, sum(w) s from bw group by src having sum(w) > 0) select src, dst, round(w / s, 8) p from bw join s using (src)")
def q_kernel(spark: SparkSession, sf: str) -> DataFrame:
    """Transition shares of the co-activation web."""
    return G.row_normalized(G.both_ways(pair_web(spark, sf))).select("src", "dst", F.round("p", 8).alias("p"))


@query(f"""with {PAIR_SQL}, {_BOTH}, s as (select src, sum(w) s from bw group by src having sum(w) > 0), k as (select src, dst, w / s p from bw join s using (src)),
p0 as (select 'core-0000' node, 0.75 p union all select 'core-0001', 0.25), p1 as (select dst node, sum(p0.p * k.p) p from p0 join k on src = node group by dst),
p2 as (select dst node, sum(p1.p * k.p) p from p1 join k on src = node group by dst), p3 as (select dst node, sum(p2.p * k.p) p from p2 join k on src = node group by dst)
select node, round(sum(v), 8) need from (select node, p v from p0 union all select node, 0.5 * p from p1 union all select node, 0.25 * p from p2 union all select node, 0.125 * p from p3) group by node""")
def q_need_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Discounted three-step walk from two active nodes."""
    start = G.seeds(spark.createDataFrame([("core-0000", 0.6), ("core-0001", 0.2)], "node string, score double"))
    return G.discounted_walk(G.row_normalized(G.both_ways(pair_web(spark, sf))), start).select("node", F.round("need", 8).alias("need"))


@query(f"""with {WEB_SQL}, dc as (select src, dst, n from we where ref_kind = 'chain'), ds as (select src, sum(n) s from dc group by src having sum(n) > 0),
pw as (select least(src, dst) a, greatest(src, dst) b, max(coalesce(weight, 0.0)) w from we where ref_kind = 'coactivation' group by 1, 2), {_BOTH}, ss as (select src, sum(w) s from bw group by src having sum(w) > 0)
select src, dst, round(n / s, 8) p from dc join ds using (src) union all select src, dst, round(w / s, 8) from bw join ss using (src) where src not in (select src from ds)""")
def q_forward_kernel(spark: SparkSession, sf: str) -> DataFrame:
    """Directed chain tallies where a node has them, else its co-activation shares."""
    directed = web_edges(spark, sf).where("ref_kind = 'chain'").select("src", "dst", "n")
    return G.forward_kernel(directed, G.both_ways(pair_web(spark, sf))).select("src", "dst", F.round("p", 8).alias("p"))


@query()
def q_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of the whole co-activation web (the SQL takes pairs tallied twenty times and more only)."""
    return G.connected_components(pair_web(spark, sf), "a", "b")


@query(f"""with {PAIR_SQL}, {NODES_SQL},
m as (select id node, unnest(chains) chain from nd where chains is not null), wi as (select distinct a, b from pw join m x on x.node = a join m y on y.node = b and x.chain = y.chain),
k as (select w, case when wi.a is not null then 'within' when exists (select 1 from m where node = pw.a) and exists (select 1 from m where node = pw.b) then 'across' else 'orphan' end class from pw left join wi on wi.a = pw.a and wi.b = pw.b)
select class, count(*) n, round(max(w), 6) most, count_if(w >= 0.85) strong from k group by class""")
def q_web_health(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs within a chain, across chains, and with an end in none."""
    m = nodes(spark, sf).select(F.col("id").alias("node"), F.explode("chains").alias("chain"))
    p = pair_web(spark, sf).select("a", "b", "w")
    within = p.join(m.withColumnsRenamed({"node": "a"}), "a").join(m.withColumnsRenamed({"node": "b"}), ["b", "chain"]).select("a", "b").distinct().withColumn("_w", F.lit(True))
    known = m.select("node").distinct().withColumn("_k", F.lit(True))
    k = p.join(within, ["a", "b"], "left").join(known.withColumnsRenamed({"node": "a", "_k": "_ka"}), "a", "left").join(known.withColumnsRenamed({"node": "b", "_k": "_kb"}), "b", "left")
    cls = F.when(F.col("_w"), "within").when(F.col("_ka") & F.col("_kb"), "across").otherwise("orphan")
    return k.groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("w"), 6).alias("most"), F.count_if(F.col("w") >= 0.85).alias("strong"))


@query(f"""with {PAIR_SQL}, ids as (select unnest(['core-0000', 'core-0003', 'core-0007']) id) select a, b, n from pw where a in (select id from ids) or b in (select id from ids)""")
def q_incident(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that touch the focus nodes."""
    focus = spark.createDataFrame([("core-0000",), ("core-0003",), ("core-0007",)], "id string")
    return G.incident(pair_web(spark, sf).select("a", "b", "n"), focus, "a", "b")


@query(f"""with {CHAIN_SQL} select chain, count_if((valid_from is null or valid_from <= date '{AT}') and (valid_to is null or valid_to >= date '{AT}')) n_valid, count(*) n_edges from ce where chain is not null group by chain""")
def q_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Valid and all edges of each chain on a day."""
    return C.snapshot(chain_edges(spark, sf).where("chain is not null"), AT)


_MEMBERS = "m as (select distinct chain, node from (select chain, src node from ce union all select chain, dst from ce) where chain is not null and node is not null)"


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return chain_edges(spark, sf).select("chain", F.explode(F.array("src", "dst")).alias("node")).where("chain is not null and node is not null").distinct()


@query(f"""with {CHAIN_SQL}, {_MEMBERS}, v as (select * from ce where (valid_from is null or valid_from <= date '{AT}') and (valid_to is null or valid_to >= date '{AT}'))
select chain, node from m where exists (select 1 from v where v.chain = m.chain and (v.src = m.node or v.dst = m.node))""")
def q_chain_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Members of chains touched by an edge valid on the day."""
    return C.members_at(_members(spark, sf), chain_edges(spark, sf), AT)


@query(f"""with recursive {CHAIN_SQL}, v as (select distinct chain, src, dst from ce where (valid_from is null or valid_from <= date '{AT}') and (valid_to is null or valid_to >= date '{AT}')),
st as (select chain, min(src) node from v where chain is not null group by chain),
r(chain, node, depth) as (select chain, node, 0 from st union select r.chain, v.dst, depth + 1 from r join v on v.chain = r.chain and v.src = r.node where depth < 3)
select chain, node, min(depth) depth from r where node is not null group by chain, node""")
def q_traverse(spark: SparkSession, sf: str) -> DataFrame:
    """Three steps forward from the least source of each chain, over edges valid on the day."""
    v = C.valid_edges(chain_edges(spark, sf), AT).where("chain is not null and src is not null and dst is not null")
    return G.reachable(v, v.groupBy("chain").agg(F.min("src").alias("node")), 3, ("chain",))


@query(f"""with {CHAIN_SQL}, {_MEMBERS}, o as (select m.*, row_number() over (partition by chain order by node) pos from m), {ALL_NODES_SQL},
d as (select o.*, an.valid_from from o left join an on an.id = o.node), l as (select chain, pos, node src, lead(node) over w dst, valid_from, lead(valid_from) over w nv from d window w as (partition by chain order by pos))
select chain, pos, src, dst, greatest(valid_from, nv) valid_from from l where dst is not null""")
def q_linear_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between consecutive members (in order of id), valid from the later of both nodes."""
    return C.linear_edges(_ordered(spark, sf).join(all_nodes(spark, sf).select(F.col("id").alias("node"), "valid_from"), "node", "left"))


def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    return _members(spark, sf).withColumn("pos", F.row_number().over(Window.partitionBy("chain").orderBy("node")))


@query(f"""with {CHAIN_SQL}, {_MEMBERS} select chain, node, row_number() over (partition by chain order by node) pos, lag(node) over (partition by chain order by node) previous from m""")
def q_step_up(spark: SparkSession, sf: str) -> DataFrame:
    """Each member with the one before it."""
    return C.previous_member(_ordered(spark, sf)).select("chain", "node", "pos", "previous")


@query(f"""with {CHAIN_SQL}, {_MEMBERS}, o as (select m.*, row_number() over (partition by chain order by node) pos from m)
select a.chain, a.node, list(b.node order by b.pos) filter (where b.node is not null) siblings from o a left join o b on a.chain = b.chain and a.node <> b.node and b.pos <= case when a.pos <= 6 then 7 else 6 end group by a.chain, a.node having count(b.node) > 0""")
def q_siblings(spark: SparkSession, sf: str) -> DataFrame:
    """Each member with the first six others of its chain."""
    return C.siblings(_ordered(spark, sf)).select("chain", "node", "siblings").where("size(siblings) > 0")


@query(f"""with {CHAIN_SQL}, {_MEMBERS}, {ALL_NODES_SQL} select chain, count(*) members, count(an.id) known, min(node) first_member, min(coalesce(an.name, node)) first_title from m left join an on an.id = m.node group by chain""")
def q_chain_list(spark: SparkSession, sf: str) -> DataFrame:
    """Chains with member counts and titles."""
    t = C.with_titles(_members(spark, sf), all_nodes(spark, sf).select("id", "name"))
    known = all_nodes(spark, sf).select(F.col("id").alias("node"), F.lit(1).alias("_k"))
    return t.join(known, "node", "left").groupBy("chain").agg(F.count(F.lit(1)).alias("members"), F.count("_k").alias("known"), F.min("node").alias("first_member"), F.min("title").alias("first_title"))
