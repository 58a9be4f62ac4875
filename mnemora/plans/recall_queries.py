"""Queries of the whole read path over nodes, chains, pairs and vectors; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.functions import scores as S
from mnemora.functions import text as X
from mnemora.operators import recall
from mnemora.plans.common import ALL_NODES_SQL, NODES_SQL, PAIR_SQL, WEB_SQL, all_nodes, nodes, pair_web, web_edges
from mnemora.plans.store_queries import _ENT
from mnemora.plans.vector_queries import _DOT, _first, _rows
from mnemora.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
BUDGET = 8000


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LOADED = f"""{NODES_SQL}, mem as (select distinct chain, id node, coalesce(relevance, 0.0) score, floor(length(coalesce(body, '')) / 3.6)::bigint tokens from (select *, unnest(chains) chain from nd)),
ch as (select chain, row_number() over (order by round(sum(score), 6) desc, chain) rank from mem group by chain), loaded as (select chain, rank, node, score, tokens from mem join ch using (chain) where rank <= 8)"""
_FOCUS = f"""{_LOADED}, near as (select *, row_number() over (partition by chain order by score desc, node) i from loaded), l as (select *, row_number() over (order by rank, i) k from near where i <= 8),
w(k, chain, node, tokens, spent, serves) as (select 0::bigint, null::varchar, null::varchar, 0::bigint, 0::bigint, false union all
  select l.k, l.chain, l.node, l.tokens, w.spent + case when l.i = 1 or w.spent + l.tokens <= 300 then l.tokens else 0 end, l.i = 1 or w.spent + l.tokens <= 300 from w join l on l.k = w.k + 1),
foc as (select chain, node, tokens, (row_number() over (order by k) - 1)::int pos from w where serves)"""


def _loaded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Members of the eight chains of most relevance, and the relevance of nodes."""
    n = nodes(spark, sf).select(F.col("id").alias("node"), "chains", F.coalesce("relevance", F.lit(0.0)).alias("score"), X.token_estimate("body").alias("tokens"))
    members = n.select(F.explode("chains").alias("chain"), "node", "score", "tokens").distinct()
    best = members.groupBy("chain").agg(F.round(F.sum("score"), 6).alias("s")).orderBy(F.col("s").desc(), "chain").limit(8)
    ranked = best.select("chain", F.row_number().over(Window.orderBy(F.col("s").desc(), "chain")).alias("rank"))
    return members.join(F.broadcast(ranked), "chain").select("chain", "rank", "node", "tokens"), n.select("node", "score")


@query(f"with recursive {_FOCUS} select * from foc")
def q_focus(spark: SparkSession, sf: str) -> DataFrame:
    """The most relevant members of the best chains, the first of each in any case, under 300 tokens."""
    return recall.focus(*_loaded(spark, sf), 8, 300)


@query(f"""with recursive {_FOCUS}, fa as (select id node, floor(length(coalesce(body, '')) / 3.6)::bigint tokens, (row_number() over (order by coalesce(relevance, 0.0) desc, id) - 1)::int pos from core_nodes),
p as (select 'facts' section, pos, node, tokens, sum(tokens) over (order by pos) total from fa where pos < 12 union all select 'evidence', pos, node, tokens, sum(tokens) over (order by pos) from foc)
select section, pos, node, tokens from p where total <= case section when 'facts' then 100 else 300 end""")
def q_compose(spark: SparkSession, sf: str) -> DataFrame:
    """Facts (the standing nodes) beside focused evidence, a quarter and three quarters of 400 tokens."""
    facts = table(spark, sf, "core_nodes").select(F.col("id").alias("node"), F.coalesce("relevance", F.lit(0.0)).alias("score"), X.token_estimate("body").alias("tokens"))
    return recall.compose(facts, recall.focus(*_loaded(spark, sf), 8, 300), 400)


@query(f"""with {ALL_NODES_SQL}, {PAIR_SQL}, v as (select id, coalesce(relevance, 0.0) score from an), e as (select id, 0.5 * salience + 0.4 score from an where salience >= 0.8), r as (select id, 0.9 * integrity score from an where tier = 'hot'),
t as (select id, case when contains(lower(id), 'core') then 1.0 else 0.85 end score from an where contains(lower(coalesce(name, '')), 'map')), u as (select id, score, 'vector' source, 0 i from v union all select id, score, 'engram', 1 from e where score is not null union all select id, score, 'ring', 2 from r where score is not null union all select id, score, 'term', 3 from t),
o as (select * from (select *, row_number() over (partition by id order by i desc) k from u) where k = 1), b as (select id, score, source from o order by source <> 'term', score desc, id limit 20),
nb as (select id, max(least(0.95 * score, 0.5 * w)) score from (select pw.b id, x.score, w from pw join (select * from b order by score desc, id limit 5) x on x.id = pw.a union all select pw.a, x.score, w from pw join (select * from b order by score desc, id limit 5) x on x.id = pw.b) where id not in (select id from b) group by id)
select id, round(score, 6) score, source from (select * from b union all select * from (select id, score, 'neighbour' from nb order by score desc, id limit 3))""")
def q_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Term hits first, then vector, engram and ring hits (later ones replace a node's earlier one), cut at 20, and web neighbours beyond the cut. Stored scores stand in for cosines."""
    from mnemora.operators import retrieval

    n = all_nodes(spark, sf)
    vector = n.select("id", F.coalesce("relevance", F.lit(0.0)).alias("score"))
    engram = n.where("salience >= 0.8").select("id", (0.5 * F.col("salience") + 0.4).alias("score"))
    ring = n.where("tier = 'hot' and integrity is not null").select("id", (0.9 * F.col("integrity")).alias("score"))
    terms = n.where(F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit("map"))).select("id", F.when(F.contains(F.lower("id"), F.lit("core")), 1.0).otherwise(0.85).alias("score"))
    sources = [("vector", vector), ("engram", engram), ("ring", ring)]
    near = retrieval.neighbours_of(recall.merged_hits(sources, 20, terms), pair_web(spark, sf).select("a", "b", "w"))
    return recall.merged_hits(sources, 20, terms, near).select("id", F.round("score", 6).alias("score"), "source")


@query(f"""with q as (select embedding qe from embeddings where vec_id = 0), s as (select vec_id id, label, embedding, {_DOT.format("embedding", "qe")} score from embeddings, q),
f as (select id, embedding, date '2010-01-01' + (id % 28)::int d, row_number() over (order by score desc, id) - 1 pos from s where label % 2 = 0), e as (select id, embedding, null::date d, row_number() over (order by score desc, id) - 1 pos from s where label % 2 = 1),
a as (select id, embedding, d, 0 side, pos from f where pos < 20 union all select id, embedding, d, 1, pos from e where pos < 15),
p as (select x.id i, y.id j, x.d dx, y.d dy, {_DOT.format("x.embedding", "y.embedding")} / (sqrt({_DOT.format("x.embedding", "x.embedding")}) * sqrt({_DOT.format("y.embedding", "y.embedding")})) c from a x join a y on x.side = 0 and (x.side, x.pos) < (y.side, y.pos))
select case when dx > dy then j else i end old_id, case when dx > dy then i else j end new_id, round(c, 6) cosine from p where c >= 0.25""")
def q_read_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Near-equal rows among the served: facts (even labels, dated) and evidence (odd labels)."""
    from mnemora.functions import vectors as V

    rows = _rows(spark, sf).withColumn("score", V.dot("embedding", V.literal(_first(spark, sf))))

    def served(odd: int, most: int) -> DataFrame:
        best = rows.where(F.col("chain").cast("int") % 2 == odd).orderBy(F.col("score").desc(), "id").limit(most)
        return best.withColumn("pos", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")) - 1)

    facts = served(0, recall.SERVED_FACTS).withColumn("valid_from", F.date_add(F.lit("2010-01-01").cast("date"), (F.col("id") % 28).cast("int")))
    found = recall.read_conflicts(facts, served(1, recall.SERVED_EVIDENCE), 0.25)
    return found.select("old_id", "new_id", F.round("cosine", 6).alias("cosine"))


@query(f"""with recursive {_ENT}, q as (select distinct entity from ent where doc_id % 20 = 0), wa as (select ent.* from ent join q using (entity)), df as (select entity, count(*) df from wa group by entity),
br as (select doc_id id, sum(1.0 / df) score from wa join df using (entity) group by doc_id order by round(sum(1.0 / df), 9) desc, doc_id limit 8), l as (select doc_id id, floor(length(text) / 3.6)::bigint tokens from documents order by written_at desc nulls last, doc_id limit 3),
n as (select br.id, floor(length(text) / 3.6)::bigint tokens, row_number() over (order by round(score, 8) desc, br.id) k from br join documents d on d.doc_id = br.id where br.id not in (select id from l)),
w(k, id, tokens, spent, taken) as (select 0::bigint, null::bigint, 0::bigint, (select sum(tokens) from l)::bigint, false union all select n.k, n.id, n.tokens, w.spent + case when w.spent + n.tokens <= 1200 then n.tokens else 0 end, w.spent + n.tokens <= 1200 from w join n on n.k = w.k + 1)
select id, tokens, 'chain' source from l union all select id, tokens, 'bridge' from w where taken""")
def q_bridged(spark: SparkSession, sf: str) -> DataFrame:
    """The three latest documents and what entity bridges still fit beside them under 1,200 tokens."""
    from mnemora.plans.store_queries import q_bridge_query

    sized = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "written_at", X.token_estimate("text").alias("tokens"))
    bridges = q_bridge_query(spark, sf).select("id", "score").join(sized.drop("written_at"), "id")
    return recall.bridged(sized.orderBy(F.col("written_at").desc_nulls_last(), "id").limit(3), bridges, 1200)


@query(f"""with {NODES_SQL}, m as (select distinct id node, unnest(chains) chain from nd), h as (select id from nd where tier = 'hot') select distinct chain from m where chain not in (select chain from m where node in (select id from h))""")
def q_cold_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Chains without a hot node."""
    n = nodes(spark, sf)
    return recall.cold_chains(n.select(F.col("id").alias("node"), F.explode("chains").alias("chain")), n.where("tier = 'hot'").select(F.col("id").alias("node")))


@query(f"""with {NODES_SQL}, {PAIR_SQL}, p as (select a, b, x.integrity ca, y.integrity cb, x.valid_from fa, y.valid_from fb from pw join nd x on x.id = a join nd y on y.id = b),
c as (select *, case when coalesce(ca, 0) <> coalesce(cb, 0) then coalesce(ca, 0) < coalesce(cb, 0) when coalesce(fa, date '0001-01-01') <> coalesce(fb, date '0001-01-01') then coalesce(fa, date '0001-01-01') < coalesce(fb, date '0001-01-01') else a < b end f from p)
select case when f then a else b end loser, case when f then b else a end winner from c""")
def q_losers(spark: SparkSession, sf: str) -> DataFrame:
    """Of every co-activated pair, which node would be retired if both were in conflict (integrity as confidence)."""
    n = nodes(spark, sf).select("id", "integrity", "valid_from")
    end = lambda c: n.select(F.col("id").alias(c), F.col("integrity").alias(f"confidence_{c}"), F.col("valid_from").alias(f"from_{c}"))
    return recall.pick_loser(pair_web(spark, sf).select("a", "b").join(end("a"), "a").join(end("b"), "b")).select("loser", "winner")


@query(f"""with {NODES_SQL} select id from nd where tier in ('hot', 'warm') and (coalesce(access_count, 0) >= 3 or coalesce(salience, 0) >= 0.8 or coalesce(stc_capture_score, 0) >= 0.5)""")
def q_ring_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """Recent nodes that become engrams: often recalled, salient or captured."""
    ring = nodes(spark, sf).where("tier in ('hot', 'warm')").select("id", F.col("access_count").alias("hits"), "salience", F.col("stc_capture_score").alias("capture"))
    return recall.promote(ring).select("id")


@query(f"""with {PAIR_SQL}, l as (select least(src, dst) a, greatest(src, dst) b, sum(n) n from we where ref_kind = 'mention' group by 1, 2), g as (select a, b, 1 - pow({1 - S.EMA!r}, n) >= 0.85 and n >= 3 p from pw),
x as (select l.a, l.b, g.p, least(1.0, 0.2 * l.n) * pow(0.7, greatest(0, 12 - l.n)) w from l left join g using (a, b))
select a, b, round(w, 6) w, case when p then 'genuine' when p is not null then 'validated' when w < 0.05 then 'decayed' else 'candidate' end status from x""")
def q_links(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions as hypothetical links after twelve occasions, against the co-activated pairs."""
    m = web_edges(spark, sf).where("ref_kind = 'mention'").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("n").alias("n"))
    links = m.select("a", "b", F.least(F.lit(1.0), 0.2 * F.col("n")).alias("w"), F.col("n").alias("seen"))
    genuine = pair_web(spark, sf).select("a", "b", S.promotable(S.ema_weight("n"), "n").alias("promotable"))
    return recall.link_step(links, genuine, 12).select("a", "b", F.round("w", 6).alias("w"), "status")


@query(f"""with {PAIR_SQL}, s as (select a, b, case when n >= 12 then 'strong' when n >= 4 then 'weak' else 'none' end tier from pw), l as (select least(src, dst) a, greatest(src, dst) b, max(case when n >= 2 then 2 else 1 end) had from we where ref_kind = 'chain' group by 1, 2)
select s.a, s.b, tier, case when l.had is null then 'new' else 'upgrade' end step from s left join l using (a, b) where case tier when 'strong' then 2 when 'weak' then 1 else 0 end > coalesce(l.had, 0)""")
def q_promotion_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs to promote beyond those that chains hold already (the ledger: weak, or strong from two tallies on)."""
    tier = F.when(F.col("n") >= 12, "strong").when(F.col("n") >= 4, "weak").otherwise("none")
    chain = web_edges(spark, sf).where("ref_kind = 'chain'").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(F.col("n") >= 2, "strong").otherwise("weak").alias("tier"))
    return recall.promote_pairs(pair_web(spark, sf).select("a", "b", tier.alias("tier")), chain)


@query(f"""with p as (select least(a.vec_id, b.vec_id) a, greatest(a.vec_id, b.vec_id) b, max({_DOT.format("a.embedding", "b.embedding")} / (sqrt({_DOT.format("a.embedding", "a.embedding")}) * sqrt({_DOT.format("b.embedding", "b.embedding")}))) c
  from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id group by 1, 2), q as (select p.*, x.label la, y.label lb from p join embeddings x on x.vec_id = a join embeddings y on y.vec_id = b where c >= 0.3)
select case when la < lb or la = lb then a else b end old_id, case when la < lb or la = lb then b else a end new_id, round(c, 6) cosine from q""")
def q_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth row against all rows: near pairs with the one to retire (the label as confidence, no dates)."""
    rows = _rows(spark, sf)
    facts = rows.select("id", F.col("chain").cast("double").alias("confidence"), F.lit(None).cast("date").alias("valid_from"))
    return recall.sweep(rows, rows.where("id % 20 = 0"), facts, 0.3).select("old_id", "new_id", F.round("cosine", 6).alias("cosine"))
