"""Queries over embeddings; a row's label is its chain. Bars were fitted to the test vectors, whose cosines are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import scores as S
from mnemora.functions import vectors as V
from mnemora.operators import evaluate, packing, retrieval
from mnemora.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
TOP, BAR = 24, 0.3


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("chain"))


def _first(spark: SparkSession, sf: str) -> list[float]:
    """The query vector: the row of id 0."""
    return list(table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"])


def _hits(spark: SparkSession, sf: str, k: int = TOP) -> DataFrame:
    return retrieval.top_k(_rows(spark, sf), _first(spark, sf), k)


_DOT = "list_dot_product(cast({0} as double[]), cast({1} as double[]))"
_HITS = f"""q as (select embedding qe from embeddings where vec_id = 0),
s as (select vec_id id, cast(label as varchar) chain, {_DOT.format("embedding", "qe")} score from embeddings, q),
h as (select * from s order by score desc, id limit {TOP})"""


@query(f"with {_HITS} select id, round(score, 6) score from h")
def q_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The rows nearest to a query vector."""
    return _hits(spark, sf).select("id", F.round("score", 6).alias("score"))


@query(f"""with {_HITS}, g as (select chain, sum(score) score, max(score) best_score, arg_min(id, [-score, id::double]) best, count(*) n_hits from h group by chain),
e as (select cast(label as varchar) chain, count(*) n from embeddings where vec_id % 10 = 3 group by 1)
select chain, round(g.score + 0.05 * coalesce(e.n, 0), 6) score, round(best_score, 6) best_score, best, n_hits from g left join e using (chain) order by g.score + 0.05 * coalesce(e.n, 0) desc, chain limit 8""")
def q_chain_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """The best chains by the sum of their hits and a bonus per marked member."""
    rows = _rows(spark, sf)
    marked = rows.where("id % 10 = 3").groupBy("chain").agg(F.count(F.lit(1)).alias("n_edges"))
    out = retrieval.by_chain(_hits(spark, sf), edge_counts=marked)
    return out.select("chain", F.round("score", 6).alias("score"), F.round("best_score", 6).alias("best_score"), "best", "n_hits")


@query(f"""with recursive {_HITS}, c as (select id, chain, score, 40 + id % 60 tokens, row_number() over (order by score desc, id) rn from h),
w(rn, id, tokens, spent, taken) as (
  select 0::bigint, null::bigint, 0::bigint, 0::bigint, false
  union all select c.rn, c.id, c.tokens, case when w.spent + c.tokens <= 600 then w.spent + c.tokens else w.spent end, w.spent + c.tokens <= 600 from w join c on c.rn = w.rn + 1)
select id, tokens, taken from w where rn > 0""")
def q_first_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked hits packed under a budget: one that does not fit is skipped, a later smaller one may fit."""
    c = _hits(spark, sf).select(F.lit(1).alias("g"), "id", F.negative("score").alias("o"), (40 + F.col("id") % 60).alias("tokens"))
    return packing.first_fit(c, ["g"], ["o", "id"], "tokens", 600).select("id", "tokens", "taken")


@query(f"""with {_HITS}, t10 as (select id from h order by score desc, id limit 10), cs as (select chain, sum(score) cscore from h group by chain order by cscore desc, chain limit 12),
c as (select h.id, h.score, coalesce(cs.cscore, 0) cscore, t10.id is not null t from h left join cs using (chain) left join t10 on t10.id = h.id)
select id, round(0.55 * score + 0.20 * (cscore / (select max(cscore) from c)) + 0.15 * t::int, 6) hybrid from c""")
def q_hybrid_score(spark: SparkSession, sf: str) -> DataFrame:
    """Hits by a blend of vector, chain and first-ten signals."""
    h = _hits(spark, sf)
    chains = retrieval.by_chain(h, max_chains=12).select("chain", F.col("score").alias("cscore"))
    ten = h.orderBy(F.col("score").desc(), "id").limit(10).select("id", F.lit(True).alias("t"))
    c = h.join(F.broadcast(chains), "chain", "left").join(F.broadcast(ten), "id", "left").withColumn("t", F.coalesce("t", F.lit(False)))
    return retrieval.blend_scores(c, "score", "cscore", "t").select("id", F.round("hybrid", 6).alias("hybrid"))


@query(f"""with {_HITS}, v as (select id, score, row_number() over (order by score desc, id) rn from s where cast(chain as int) % 2 = 0),
r as (select id, 1.0 / (1 + id % 7) score from s where id % 11 = 5 and id not in (select id from v where rn <= 9) order by score desc, id limit 3),
u as (select id, score, 0 p, 'vector' source from v where rn <= 9 union all select id, score, 1, 'reserve' from r union all select id, score, 2, 'backfill' from v where rn between 10 and 12),
o as (select id, min(p) p from u group by id), f as (select u.* from u join o on u.id = o.id and u.p = o.p order by u.p, u.score desc, u.id limit 12)
select id, round(score, 6) score, source from f""")
def q_atom_reserve(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve facts: nine by vector, three reserved for another source, the rest filled up."""
    rows = _rows(spark, sf)
    main = retrieval.top_k(rows, _first(spark, sf), 12, where=F.col("chain").cast("int") % 2 == 0).select("id", "score")
    other = rows.where("id % 11 = 5").select("id", (1.0 / (1 + F.col("id") % 7)).alias("score"))
    return retrieval.with_reserve(main, other, 12, 3).select("id", F.round("score", 6).alias("score"), "source")


@query(f"""with {_HITS}, g as (select chain, sum(score) score, count(*) n, min(id) + 1 age from h group by chain),
d as (select a.chain, 1 / sum(exp(-least(abs(ln(a.age) - ln(b.age)), ln(1000.0)))) dist from g a, g b group by a.chain)
select g.chain, round(g.score * (1 + 0.5 * case when max(n) over () > min(n) over () then (n - min(n) over ()) / (max(n) over () - min(n) over ())::double else 0.0 end
  + 0.2 * case when max(dist) over () > min(dist) over () then (dist - min(dist) over ()) / (max(dist) over () - min(dist) over ()) else 0.0 end), 6) enveloped, round(dist, 6) dist from g join d using (chain)""")
def q_temporal_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """Chain scores lifted by need and distinctiveness, each scaled over the pool."""
    g = _hits(spark, sf).groupBy("chain").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"), (F.min("id") + 1).alias("age"))
    pool = g.join(retrieval.distinctiveness(g, "chain", "age"), "chain")
    return retrieval.envelope(pool, "score", {"n": 0.5, "distinct": 0.2, "age": 0.0}).select("chain", F.round("enveloped", 6).alias("enveloped"), F.round("distinct", 6).alias("dist"))


@query(f"""with p as (select a.vec_id query, b.vec_id item, {_DOT.format("a.embedding", "b.embedding")} / (sqrt({_DOT.format("a.embedding", "a.embedding")}) * sqrt({_DOT.format("b.embedding", "b.embedding")})) score
  from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select query, item, round(score, 6) score from p where score >= {BAR}""")
def q_similarity_join(spark: SparkSession, sf: str) -> DataFrame:
    """One row in twenty against all rows, by a cosine bar."""
    rows = _rows(spark, sf)
    return retrieval.search(rows.where("id % 20 = 0"), rows, None, BAR).select("query", "item", F.round("score", 6).alias("score"))


_NEAREST = f"""p as (select a.vec_id query, b.vec_id item, {_DOT.format("a.embedding", "b.embedding")} / (sqrt({_DOT.format("a.embedding", "a.embedding")}) * sqrt({_DOT.format("b.embedding", "b.embedding")})) score
  from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query order by score desc, item) rank from p)"""


@query(f"with {_NEAREST} select query, item, rank, round(score, 6) score from r where rank <= 5")
def q_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Five nearest rows of one row in twenty."""
    rows = _rows(spark, sf)
    return retrieval.search(rows.where("id % 20 = 0"), rows, 5).select("query", "item", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query(f"with {_NEAREST} select query, item, case when score >= {BAR} then 'merge_into' else 'store_new' end decision from r where rank = 1")
def q_novelty(spark: SparkSession, sf: str) -> DataFrame:
    """Merge into the nearest row, or store as new."""
    rows = _rows(spark, sf)
    return retrieval.novelty(retrieval.search(rows.where("id % 20 = 0"), rows, 1), BAR).select("query", "item", "decision")


@query(f"""with {_HITS}, t as (select id, chain, score from h order by score desc, id limit 10) select id, round(score, 6) score from t where cast(chain as int) <> 3 and score >= 0.1 and id % 2 = 0""")
def q_scoped_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best are cut first; type, scope and bar filter what is left."""
    return _hits(spark, sf, 10).where("cast(chain as int) <> 3 and score >= 0.1 and id % 2 = 0").select("id", F.round("score", 6).alias("score"))


@query(f"""with {_HITS}, b as (select id, score + 0.05 * pow(0.5, (id % 60) / 14.0) score from s order by score + 0.05 * pow(0.5, (id % 60) / 14.0) desc, id limit 8) select id, round(score, 6) score from b""")
def q_engram_recency(spark: SparkSession, sf: str) -> DataFrame:
    """Top rows with a half-life bonus for recent ones (the age in days stands in from the id)."""
    return retrieval.top_k(_rows(spark, sf), _first(spark, sf), 8, boost=0.05 * S.half_life(F.col("id") % 60, 14.0)).select("id", F.round("score", 6).alias("score"))


@query(f"""with {_NEAREST}, k as (select unnest([1, 5, 10]) k), f as (select query, min(rank) rank from r join embeddings e on e.vec_id = r.query join embeddings g on g.vec_id = r.item where e.label = g.label and rank <= 10 group by query),
a as (select vec_id query from embeddings where vec_id % 20 = 0)
select k, round(avg(case when f.rank <= k then 1.0 else 0.0 end), 6) recall from a left join f using (query), k group by k""")
def q_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Share of queries with a row of their own label among the first k."""
    return evaluate.recall_at(_label_ranks(spark, sf), [1, 5, 10]).select("k", F.round("recall", 6).alias("recall"))


@query(f"""with {_NEAREST}, f as (select query, min(rank) rank from r join embeddings e on e.vec_id = r.query join embeddings g on g.vec_id = r.item where e.label = g.label and rank <= 10 group by query),
a as (select vec_id query from embeddings where vec_id % 20 = 0) select round(avg(coalesce(1.0 / rank, 0.0)), 6) mrr from a left join f using (query)""")
def q_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """Mean reciprocal rank of the first row of the query's own label."""
    return evaluate.mean_reciprocal_rank(_label_ranks(spark, sf)).select(F.round("mrr", 6).alias("mrr"))


def _label_ranks(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    asked = rows.where("id % 20 = 0")
    near = retrieval.search(asked, rows, 10)
    label = rows.select("id", "chain")
    named = near.join(label.withColumnsRenamed({"id": "query", "chain": "q"}), "query").join(label.withColumnsRenamed({"id": "item", "chain": "i"}), "item")
    first = named.where("q = i").groupBy("query").agg(F.min("rank").alias("rank"))
    return asked.select(F.col("id").alias("query")).join(first, "query", "left")


@query(f"""with {_HITS}, w as (select vec_id a, vec_id + 1 b, 0.2 + 0.01 * (vec_id % 60) w from embeddings), t as (select id, score from h order by score desc, id limit 5),
n as (select id, max(least(0.95 * score, 0.5 * w)) score from (select b id, t.score, w from w join t on t.id = a union all select a id, t.score, w from w join t on t.id = b) where id not in (select id from h) group by id)
select id, round(score, 6) score from n order by n.score desc, id limit 3""")
def q_neighbour_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Web neighbours of the best hits, added beyond the cut (consecutive ids stand in for web pairs)."""
    pairs = _rows(spark, sf).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (0.2 + 0.01 * (F.col("id") % 60)).alias("w"))
    return retrieval.neighbours_of(_hits(spark, sf), pairs).select("id", F.round("score", 6).alias("score"))


@query()
def q_sparse_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse codes of all vectors (a random projection; tested on a fixture)."""
    rows = _rows(spark, sf)
    return rows.select("id", V.sparse_code(64)("embedding").alias("code"))


@query(f"""with recursive e as (select cast(label as varchar) chain, vec_id::double t, cast(embedding as double[]) q, sqrt({_DOT.format("embedding", "embedding")}) n from embeddings),
u as (select chain, t, case when n > 0 then list_transform(q, lambda x: x / n) else q end q, row_number() over (partition by chain order by t) k, t - lag(t) over (partition by chain order by t) dt from e),
taus as (select unnest({list(retrieval.CONTEXT_TAUS)}) tau), r as (select u.*, tau, case when dt is null then 0.0 else exp(-dt / tau) end rho from u, taus),
f(chain, tau, k, v) as (select chain, tau, k, q from r where k = 1 union all
  select chain, tau, k, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) from (select r.chain, r.tau, r.k, list_transform(list_zip(f.v, r.q), lambda z: r.rho * z[1] + sqrt(greatest(0.0, 1 - r.rho * r.rho)) * z[2]) v from f join r on r.chain = f.chain and r.tau = f.tau and r.k = f.k + 1)),
l as (select chain, tau, arg_max(v, k) v from f group by 1, 2) select chain, list(list_transform(v, lambda x: round(x, 6)) order by tau) bank from l group by chain""")
def q_context_bank(spark: SparkSession, sf: str) -> DataFrame:
    """Drifting context of every chain."""
    bank = retrieval.context_bank(_rows(spark, sf), "chain", "id", "embedding", 64)
    return bank.select("chain", F.transform("bank", lambda v: F.transform(v, lambda x: F.round(x, 6))).alias("bank"))
