"""Queries of single functions and operators that no larger query runs; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import scores as S
from mnemora.functions import text as X
from mnemora.functions import vectors as V
from mnemora.operators import chains as C
from mnemora.operators import evaluate, graph, lifecycle, state
from mnemora.plans.common import ALL_NODES_SQL, CHAIN_SQL, NODES_SQL, PAIR_SQL, WEB_SQL, all_nodes, chain_edges, nodes, pair_web, web_edges
from mnemora.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {ALL_NODES_SQL}, x as (select id, lower(coalesce(name, '')) n, coalesce(body, '') b from an), s as (select *, regexp_replace(regexp_replace(n, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') u from x)
select id, case when substr(u, 1, 40) = '' then 'atom' else substr(u, 1, 40) end slug, floor(length(b) / 3.6)::bigint tokens, ceil(length(b) / 4.0)::bigint tokens_up, substr(sha256(b), 1, 16) hash from s""")
def q_text_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Slug of the name, token estimates and hash of the body of every node."""
    b = F.coalesce("body", F.lit(""))
    return all_nodes(spark, sf).select("id", X.slug(F.coalesce("name", F.lit(""))).alias("slug"), X.token_estimate(b).alias("tokens"), X.token_estimate_up(b).alias("tokens_up"), X.short_hash(b).alias("hash"))


@query(r"""with d as (select distinct as_of raw from raw_a3_temporal where as_of is not null union select distinct attribute from dataset where attribute is not null union select distinct cast(access_count as varchar) from nodes where access_count is not null
  union select distinct cast(cast(relevance as decimal(8, 4)) as varchar) from nodes where relevance is not null), t as (select raw, trim(raw) s from d)
select raw, case when lower(s) in ('true', 'false') then 'bool' when starts_with(s, '[') and ends_with(s, ']') then 'list' when contains(s, '.') and regexp_matches(s, '^[+-]?(\d+\.\d*|\.\d+)(e[+-]?\d+)?$') then 'float' when not contains(s, '.') and regexp_matches(s, '^[+-]?\d+$') then 'int' else 'string' end kind from t""")
def q_scalar_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of raw header values: days, attributes, counts and shares as text."""
    of = lambda name, c: table(spark, sf, name).where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("raw"))
    raw = of("raw_a3_temporal", "as_of").union(of("dataset", "attribute")).union(of("nodes", "access_count")).union(table(spark, sf, "nodes").where("relevance is not null").select(F.col("relevance").cast("decimal(8,4)").cast("string"))).distinct()
    return raw.select("raw", X.typed_scalar("raw")["kind"].alias("kind"))


@query(f"""with {PAIR_SQL} select a || '::' || b pair_key, substr(sha1(a || '|' || b), 1, 12) pair_id from pw""")
def q_pair_names(spark: SparkSession, sf: str) -> DataFrame:
    """Key and short id of every co-activated pair, from either order."""
    return pair_web(spark, sf).select(X.pair_key("b", "a").alias("pair_key"), X.pair_id("b", "a").alias("pair_id"))


@query(f"""with {PAIR_SQL}, m as (select node, sum(n) n from (select a node, n from pw union all select b, n from pw) group by node), t as (select sum(n) n from pw),
l as (select a, b, pw.n, x.n na, y.n nb, pw.n * t.n / (x.n::double * y.n) lift from pw join m x on x.node = a join m y on y.node = b, t)
select a, b, na >= 3 and nb >= 3 and n >= 2 and lift >= 2 floor_ok, round(least(0.6, 0.5 * greatest(0.0, case when n < 3 or w <= 0 then 0.0 else least(1.0, w) * least(1.0, greatest(0.0, 1 - exp(-(n - 2) / 3.0))) end)
  + 0.5 * greatest(0.0, least(1.0, greatest(0.0, (lift - 2) / 4.0)) * case when n <= 3 then 1.0 else 0.0 end * least(1.0, w))), 6) credit from l join (select a, b, w from pw) using (a, b)""")
def q_day_credit(spark: SparkSession, sf: str) -> DataFrame:
    """Credit of a varied and a lifted pair and whether its support carries it (the pair's weight as distance and re-engagement)."""
    p = pair_web(spark, sf)
    m = p.select(F.explode(F.array("a", "b")).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("m"))
    both = p.join(m.withColumnsRenamed({"node": "a", "m": "na"}), "a").join(m.withColumnsRenamed({"node": "b", "m": "nb"}), "b").crossJoin(F.broadcast(p.agg(F.sum("n").alias("t"))))
    lift = S.lift("n", "na", "nb", "t")
    credit = S.day_credit(S.breadth("w", "n"), S.depth(lift, F.col("n") <= 3, "w"))
    return both.select("a", "b", S.floor_ok("na", "nb", "n", "t").alias("floor_ok"), F.round(credit, 6).alias("credit"))


@query(f"""with {ALL_NODES_SQL} select id, body anchor from an where body is not null and not contains(body, '·')""")
def q_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors of every node's text, the standing nodes' first."""
    none = spark.createDataFrame([], "id string, anchor string")
    return lifecycle.capture_anchors(lifecycle.capture_anchors(none, table(spark, sf, "core_nodes")), nodes(spark, sf))


@query(f"""with {WEB_SQL}, {ALL_NODES_SQL} select src, dst, ref_kind from we where src in (select id from an) and dst in (select id from an)""")
def q_live_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Tallies both of whose ends exist."""
    return graph.live_edges(web_edges(spark, sf).select("src", "dst", "ref_kind"), all_nodes(spark, sf))


@query(f"""with {CHAIN_SQL}, a as (select distinct chain, src, dst from ce where valid_from <= date '2012-01-01' and (valid_to is null or valid_to > date '2012-01-01')), b as (select distinct chain, src, dst from ce where valid_from <= date '2014-01-01' and (valid_to is null or valid_to > date '2014-01-01'))
select *, 'added' change from (select * from b except select * from a) union all select *, 'dropped' from (select * from a except select * from b)""")
def q_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that came and went between two days."""
    at = lambda d: chain_edges(spark, sf).where(f"valid_from <= date '{d}' and (valid_to is null or valid_to > date '{d}')").select("chain", "src", "dst").distinct()
    return graph.transition_changes(at("2012-01-01"), at("2014-01-01"))


@query(f"""with {CHAIN_SQL}, {NODES_SQL}, f as (select id from nd where tier = 'frozen') select edge_id from ce where (src is null or src not in (select id from f)) and (dst is null or dst not in (select id from f))""")
def q_strip(spark: SparkSession, sf: str) -> DataFrame:
    """Chain edges without those of frozen nodes."""
    return C.strip_member(chain_edges(spark, sf), nodes(spark, sf).where("tier = 'frozen'").select("id")).select("edge_id")


@query(f"""with {CHAIN_SQL}, n as (select chain, src, dst from ce where confidence < 0.5 and chain is not null and src is not null and dst is not null)
select edge_id, case when (chain, src, dst) in (select chain, src, dst from n) and (valid_to is null or valid_to > date '2013-06-01') then date '2013-06-01' else valid_to end valid_to from ce where chain is not null and src is not null and dst is not null""")
def q_close_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of doubtful pairs ended on a day."""
    e = chain_edges(spark, sf).where("chain is not null and src is not null and dst is not null")
    return C.close_edges(e, e.where("confidence < 0.5"), "2013-06-01").select("edge_id", "valid_to")


@query(f"""with {NODES_SQL} select 'all' grp, tier, round(avg(case when relevance >= 0.25 then 1.0 else 0.0 end), 6) retained from nd group by tier""")
def q_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Share of nodes of each tier that stay above the frozen floor."""
    n = nodes(spark, sf)
    kept = evaluate.retention(n, n.where("relevance >= 0.25"), "id", ["tier"])
    return kept.select(F.lit("all").alias("grp"), "tier", F.round("retained", 6).alias("retained"))


@query(f"""with {NODES_SQL}, m as (select id, unnest(chains) chain, relevance, valid_from from nd where relevance is not null), b as (select *, max(relevance) over (partition by chain) best from m)
select chain, id, row_number() over (partition by chain order by valid_from desc nulls last, relevance desc, id desc) rank from b where relevance >= 0.6 * best""")
def q_recent_in_band(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of a chain within three fifths of its best relevance, newest first."""
    m = nodes(spark, sf).where("relevance is not null").select("id", F.explode("chains").alias("chain"), "relevance", "valid_from")
    return evaluate.recency_in_band(m, "chain", "relevance", "valid_from", "id").select("chain", "id", F.col("rank").cast("bigint").alias("rank"))


@query("""with o as (select subject, item_order o, valid_from v from dataset where subject is not null and item_order is not null and valid_from is not null), s as (select subject, list(v order by o, v) l from o group by subject) select subject, l = list_sort(l) exact from s""")
def q_order(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each subject's items come in the same order by place and by day."""
    d = table(spark, sf, "dataset").where("subject is not null and item_order is not null and valid_from is not null")
    return evaluate.order_agreement(d, "subject", "item_order", "valid_from")


@query("""with l as (select *, row_number() over (partition by pool_addr order by created_at desc nulls last, refs desc nulls last) rn from pool where pool_addr is not null) select pool_addr, refs from l where rn = 1 and coalesce(refs, 1) > 1""")
def q_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    """Latest record of every pool address, without those whose latest record is down to one reference."""
    gone = table(spark, sf, "pool").where("pool_addr is not null").withColumn("gone", F.coalesce("refs", F.lit(1)) <= 1)
    return state.drop_tombstones(gone.select("pool_addr", "created_at", "refs", "gone"), ["pool_addr"], ["created_at", "refs"], "gone").select("pool_addr", "refs")


@query("""with v as (select vec_id id, cast(embedding as double[]) v, sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) n from embeddings), u as (select id, case when n > 0 then list_transform(v, lambda x: x / n) else v end u from v),
w as (select u.id, u.u, q.u p from u join u q on q.id = u.id - 1) select id, round(list_sum(list_transform(list_zip(u, p), lambda z: 0.75 * z[1] + 0.25 * z[2])), 6) blended from w""")
def q_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Unit vectors blended with the vector before them, summed."""
    u = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.normalize("embedding").alias("u"))
    prior = u.join(u.select((F.col("id") + 1).alias("id"), F.col("u").alias("p")), "id")
    return prior.select("id", F.round(F.aggregate(V.blend("u", "p", 0.75, 0.25), F.lit(0.0), lambda s, x: s + x), 6).alias("blended"))


@query(f"""with {NODES_SQL}, m as (select distinct chain, id from (select id, unnest(chains) chain from nd)), r as (select chain, id, row_number() over (partition by chain order by id) k, count(*) over (partition by chain) n from m),
s as (select x.chain, x.id, list(y.id order by y.k) sib from r x left join r y on y.chain = x.chain and y.id <> x.id and y.k <= 7 group by 1, 2), c as (select chain, id, list_filter(sib, lambda v: v is not null)[1:6] s from s)
select chain, id node, case when len(s) > 0 then 'Part of ' || chain || ' with ' || array_to_string(s, ', ') || '.' else 'Part of ' || chain || '.' end preamble from c""")
def q_preambles(spark: SparkSession, sf: str) -> DataFrame:
    """Preamble of every member of a chain, for its contextual index text."""
    from pyspark.sql import Window

    m = nodes(spark, sf).select(F.explode("chains").alias("chain"), F.col("id").alias("node")).distinct()
    return C.context_text(m.withColumn("pos", F.row_number().over(Window.partitionBy("chain").orderBy("node")) - 1))


@query(f"""with {CHAIN_SQL}, {NODES_SQL}, m as (select distinct chain, id from (select id, unnest(chains) chain from nd)) select chain, m.id node, coalesce(name, m.id) title from m left join nd on nd.id = m.id""")
def q_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Members of chains with their titles."""
    n = nodes(spark, sf)
    m = n.select(F.explode("chains").alias("chain"), F.col("id").alias("node")).distinct()
    return C.with_titles(m, n).select("chain", "node", "title")
