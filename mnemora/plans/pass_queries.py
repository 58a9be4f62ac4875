"""Queries over the offline passes; each with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.functions import text as X
from mnemora.functions.atoms import score_hook, word_overlap
from mnemora.operators import coactivation as A
from mnemora.operators import dedup, replay, retrieval
from mnemora.plans.common import ALL_NODES_SQL, CHAIN_SQL, NODES_SQL, PAIR_SQL, TODAY, all_nodes, nodes, pair_web
from mnemora.plans.graph_queries import _MEMBERS, _ORDER_SIT, _members, _ordered, sittings
from mnemora.plans.node_queries import WORDS_SQL
from mnemora.plans.vector_queries import _NEAREST, _rows
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


@query(f"""with {_NEAREST}, n as (select query, item, score from r where rank <= 6 and score >= 0.2), c as (select vec_id, cast(label as varchar) chain from embeddings),
b as (select least(x.chain, y.chain) chain_a, greatest(x.chain, y.chain) chain_b, query, item, score from n join c x on x.vec_id = query join c y on y.vec_id = item where x.chain <> y.chain),
k as (select *, row_number() over (partition by chain_a, chain_b order by score desc, query, item) rn from b)
select chain_a, chain_b, query, item, round(score, 6) score from k where rn = 1""")
def q_replay_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Best link between every two chains from the neighbours of one row in twenty."""
    rows = _rows(spark, sf)
    return replay.neighbour_sweep(rows.where("id % 20 = 0"), rows, 6, 0.2).withColumn("score", F.round("score", 6))


@query(f"""with {_NEAREST}, n as (select least(query, item) a, greatest(query, item) b, max(score) score from r where rank <= 5 and score >= 0.2 group by 1, 2) select a, b, round(score, 6) score from n where (a + b) % 3 <> 0""")
def q_link_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Near rows that are not connected yet (a rule on ids stands in for the known links)."""
    rows = _rows(spark, sf)
    near = retrieval.search(rows.where("id % 20 = 0"), rows, 5, 0.2)
    known = near.select(F.least("query", "item").alias("a"), F.greatest("query", "item").alias("b")).where("(a + b) % 3 = 0")
    return replay.propose_links(rows.where("id % 20 = 0"), rows, known, 5, 0.2).withColumn("score", F.round("score", 6))


@query(f"""with {NODES_SQL}, m as (select chain, id node, written_at tm, salience, row_number() over (partition by chain order by written_at, id) - 1 pos from (select id, written_at, salience, unnest(chains) chain from nd where written_at is not null)),
a as (select * from m where salience >= 0.6) select a.chain, a.node anchor, m.node, m.pos - a.pos "offset" from a join m on a.chain = m.chain and m.pos - a.pos between -9 and 3 and m.pos <> a.pos and abs(m.tm - a.tm) <= 864000 and coalesce(m.salience, 0) < 0.7""")
def q_capture_window(spark: SparkSession, sf: str) -> DataFrame:
    """Plain members written around salient ones of their chain (ten days in place of nine hours: the test nodes are sparse)."""
    n = nodes(spark, sf).where("written_at is not null").select(F.col("id").alias("node"), F.col("written_at").alias("at"), "salience", F.explode("chains").alias("chain"))
    m = n.withColumn("pos", F.row_number().over(Window.partitionBy("chain").orderBy("at", "node")) - 1)
    return replay.capture_window(m, m.where("salience >= 0.6").select("chain", "node"), seconds=864000.0)


@query(f"""with recursive {NODES_SQL}, s as (select distinct chain, id, {WORDS_SQL.format("body")} w from (select id, body, unnest(chains) chain from nd where chains is not null)), f as (select * from s where len(w) > 0),
p as (select a.chain, a.id a, b.id b, len(list_intersect(a.w, b.w)) i, len(a.w) na, len(b.w) nb from f a join f b on a.chain = b.chain and a.id < b.id), e as (select chain, a, b, round(i / (na + nb - i)::double, 3) sim from p where i / (na + nb - i)::double >= 0.1),
u as (select chain, a x, b y from e union select chain, b, a from e), r(chain, node, root) as (select distinct chain, x, x from u union select r.chain, u.y, r.root from r join u on u.chain = r.chain and u.x = r.node),
c as (select chain, node, min(root) comp from r group by 1, 2), g as (select chain, comp, list_sort(list(node)) members, count(*) n from c group by 1, 2 having count(*) >= 3)
select g.chain, members, n, round(avg(sim), 6) similarity from g join c on c.chain = g.chain and c.comp = g.comp join e on e.chain = c.chain and e.a = c.node group by g.chain, g.comp, members, n""")
def q_abstraction_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of similar members of a chain."""
    m = nodes(spark, sf).select("id", "body", F.explode("chains").alias("chain"))
    return replay.abstraction_candidates(dedup.similar_pairs(m, "chain", "id", "body", 0.1)).withColumn("similarity", F.round("similarity", 6))


@query(f"""with {_ORDER_SIT}, ok as (select * from sit where query_hash is not null and substr(query_hash, 1, 1) in ('0', '1', '2', '3') and us is not null and provenance = 'genuine'),
x as (select id, us, nodes, unnest(nodes) a, unnest(range(1, len(nodes) + 1)) i from ok), p as (select us, a, unnest(nodes[i + 1:]) b from x)
select a, b, count(distinct cast(floor(us / 86400e6) as bigint)) n_days, max(us) last_at from p group by a, b""")
def q_outcome_credit(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of genuine sittings with a successful issue (the first digit of the query hash stands in for success)."""
    from mnemora.operators.state import latest_per_key

    issue = latest_per_key(table(spark, sf, "sittings").where("sitting_id is not null"), ["sitting_id"], ["arrived_at"], newest=False).select(F.col("sitting_id").alias("id"), "query_hash")
    good = issue.where(F.substring("query_hash", 1, 1).isin("0", "1", "2", "3")).select("id")
    s = sittings(spark, sf).where("us is not null and provenance = 'genuine'").join(good, "id", "left_semi")
    return replay.pair_credit(A.pairs(s.select("day", "us", "nodes"), "nodes"), "day", "us")


@query(f"""with {PAIR_SQL}, l as (select unnest(['core-0000', 'core-0003']) id), f as (select a, b, w * greatest(0.0, 1 - 0.005 * greatest(date_diff('day', cast(last_seen as date), date '{TODAY}'), 0)) s from pw),
n as (select b id, s from f where a in (select id from l) union all select a, s from f where b in (select id from l)), g as (select id, max(s) score from n where id not in (select id from l) group by id)
select id, round(score, 8) score from g order by g.score desc, id limit 5""")
def q_associations(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes most tied to two loaded ones, faded by time."""
    loaded = spark.createDataFrame([("core-0000",), ("core-0003",)], "id string")
    return replay.associations(loaded, pair_web(spark, sf), TODAY).withColumn("score", F.round("score", 8))


@query(f"""with w as (select doc_id, epoch(written_at) t, workspace, {WORDS_SQL.format("text")} w from documents where workspace is not null and written_at is not null),
p as (select a.doc_id a, b.doc_id b, a.t ta, b.t tb, len(list_intersect(a.w, b.w)) i, len(a.w) na, len(b.w) nb from w a join w b on a.workspace = b.workspace and a.doc_id < b.doc_id and abs(floor(a.t) - floor(b.t)) <= 86400 where len(a.w) > 0 and len(b.w) > 0)
select case when floor(ta) <= floor(tb) then b else a end id, case when floor(ta) <= floor(tb) then a else b end earlier, round(i / (na + nb - i)::double, 3) similarity from p where i / (na + nb - i)::double >= 0.25""")
def q_recent_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that resemble an earlier one of their workspace within a day."""
    return replay.recent_similar(table(spark, sf, "documents"), "doc_id", "written_at", "text", "workspace")


@query(f"""with {CHAIN_SQL}, {_MEMBERS}, o as (select m.*, row_number() over (partition by chain order by node) pos from m) select node, min(chain) chain, arg_min(pos, chain) pos from o group by node""")
def q_first_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Each node's first chain and its place there."""
    return replay.first_chain(_ordered(spark, sf))


@query(f"""with {CHAIN_SQL}, {_MEMBERS}, {ALL_NODES_SQL} select chain, node from m where node not in (select id from an)""")
def q_missing_members(spark: SparkSession, sf: str) -> DataFrame:
    """Chain members without a node."""
    return _members(spark, sf).join(all_nodes(spark, sf).select(F.col("id").alias("node")), "node", "left_anti").select("chain", "node")


@query(f"""with {NODES_SQL}, q as (select list_distinct(regexp_extract_all('which node holds the recall index', '[a-z]+')) q), w as (select id, q, list_distinct(regexp_extract_all(lower(coalesce(body, '')), '[\\p{{L}}\\p{{N}}_]+')) w from nd, q)
select id, round(case when len(w) > 0 then len(list_intersect(w, q)) / (len(w) + len(q) - len(list_intersect(w, q)))::double end, 9) score from w order by score desc nulls last, id limit 10""")
def q_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes rescored by a model hook (here word overlap with a question), the best ten."""
    score = score_hook(word_overlap)(F.lit("which node holds the recall index"), F.coalesce("body", F.lit("")))
    return replay.rerank(nodes(spark, sf), F.round(score, 9), 10).select("id", "score")


@query(f"""with {NODES_SQL}, m as (select id, unnest(regexp_extract_all(coalesce(body, ''), '\\b20\\d\\d-[01]\\d-[0-3]\\d\\b')) d from nd) select id, min(d) first_day, max(d) last_day from m group by id""")
def q_named_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days named in node texts."""
    d = nodes(spark, sf).select("id", X.named_days("body").alias("d")).where("size(d) > 0")
    return d.select("id", F.get("d", F.lit(0)).alias("first_day"), F.element_at("d", -1).alias("last_day"))
