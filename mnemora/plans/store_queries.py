"""Queries over the segment pool, documents and lifecycle changes; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import text as X
from mnemora.operators import dedup, lifecycle, packing, state
from mnemora.plans.common import ALL_NODES_SQL, NODES_SQL, TODAY, WEB_SQL, all_nodes, nodes, web_edges
from mnemora.plans.node_queries import WORDS_SQL
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


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """Every pool entry once: of its deliveries the latest."""
    return state.latest_per_key(table(spark, sf, "pool").where("pool_addr is not null"), ["pool_addr"], ["created_at", "refs"])


_POOL = "po as (select * exclude (rn) from (select *, row_number() over (partition by pool_addr order by created_at desc nulls last, refs desc nulls last) rn from pool where pool_addr is not null) where rn = 1)"
_HASH = r"substr(sha256(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), 1, 16)"
_SEG = r"""sg as (select doc_id, unnest(s) content, unnest(range(len(s))) pos from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') s from documents where text is not null))"""


@query(f"""with {_POOL} select {_HASH.format("content")} content_hash, min(pool_addr) first_addr, count(*) n_addrs, cast(sum(coalesce(refs, 1)) as bigint) refs, count_if(content_hash is distinct from {_HASH.format("content")}) stale from po where content is not null group by 1""")
def q_dedup_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Pool entries by the hash of their content, with those whose stored hash is missing or stale."""
    p = pool(spark, sf).where("content is not null").withColumn("h", X.segment_hash("content"))
    return p.groupBy(F.col("h").alias("content_hash")).agg(
        F.min("pool_addr").alias("first_addr"), F.count(F.lit(1)).alias("n_addrs"), F.sum(F.coalesce("refs", F.lit(1))).alias("refs"), F.count_if(~F.col("content_hash").eqNullSafe(F.col("h"))).alias("stale")
    )


@query(f"with {_POOL} select count(*) entries, cast(coalesce(sum(refs), 0) as bigint) refs, round(case when coalesce(sum(refs), 0) > 0 then greatest(0.0, 1 - count(*) / sum(refs)::double) else 0.0 end, 6) density from po")
def q_pool_density(spark: SparkSession, sf: str) -> DataFrame:
    """References saved by the pool."""
    return dedup.density(pool(spark, sf)).select("entries", "refs", F.round("density", 6).alias("density"))


@query(f"with {_POOL} select pool_addr, refs from po order by refs desc nulls last, pool_addr limit 5")
def q_pool_top(spark: SparkSession, sf: str) -> DataFrame:
    """The five entries with most references."""
    return pool(spark, sf).orderBy(F.col("refs").desc_nulls_last(), "pool_addr").limit(5).select("pool_addr", "refs")


@query(f"""with {_SEG} select {_HASH.format("content")} content_hash, count(*) refs from sg group by 1 having count(*) > 1""")
def q_shared_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments that several documents (or places) share."""
    seg = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(X.segments("text")).alias("content"))
    return dedup.pool_of(seg, "content", "doc_id").where("refs > 1").select("content_hash", "refs")


@query(rf"""with {_SEG}, p as (select {_HASH.format("content")} h, min(content) c from sg group by 1), r as (select doc_id, pos, {_HASH.format("content")} h from sg),
b as (select doc_id, string_agg(p.c, chr(10) || chr(10) order by pos) body from r join p using (h) group by doc_id)
select doc_id, md5(lower(regexp_replace(body, '\s+', ' ', 'g'))) fingerprint from b""")
def q_compress_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents compressed to pool pointers and rebuilt."""
    d = table(spark, sf, "documents").where("text is not null")
    seg = d.select("doc_id", F.explode(X.segments("text")).alias("content"))
    body = dedup.rebuild(dedup.references(d, "doc_id", "text"), dedup.pool_of(seg, "content", "doc_id"), "doc_id")
    return body.select("doc_id", F.md5(F.lower(F.regexp_replace("body", r"\s+", " "))).alias("fingerprint"))


@query(f"""with {NODES_SQL}, s as (select distinct chain, id, {WORDS_SQL.format("body")} w from (select id, body, unnest(chains) chain from nd where chains is not null)),
f as (select * from s where len(w) > 0), p as (select a.chain, a.id a, b.id b, len(list_intersect(a.w, b.w)) i, len(a.w) na, len(b.w) nb from f a join f b on a.chain = b.chain and a.id < b.id)
select chain, a, b, round(i / (na + nb - i)::double, 3) similarity from p where i / (na + nb - i)::double >= 0.15""")
def q_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of one chain that share fifteen percent of their words and more."""
    m = nodes(spark, sf).select("id", "body", F.explode("chains").alias("chain"))
    return dedup.similar_pairs(m, "chain", "id", "body", 0.15)


def _entity_sql() -> str:
    stop, caps = (", ".join(f"'{w}'" for w in words) for words in (X.IDENTIFIER_STOP, X.ALLCAPS_STOP))
    family = lambda pattern, keep="true", group=0: f"select doc_id, lower(trim(x)) entity from (select doc_id, unnest(regexp_extract_all(text, '{pattern}', {group})) x from documents where text is not null) where {keep}"
    return "ent as (select distinct entity, doc_id from (" + " union all ".join((
        family(r"`([^`\n]{2,40})`", r"trim(x) <> '' and not regexp_matches(trim(x), '^\d+$')", 1),
        family(r"\b[a-zA-Z][a-zA-Z0-9]+(?:[_\-][a-zA-Z0-9]+){1,}\b", f"length(x) >= 5 and lower(x) not in ({stop})"),
        family(rf"[A-Za-z0-9_\-./]+\.(?:{X.FILE_ENDINGS})\b"), family(r"\b[A-Z]{3,}[0-9]*\b", f"length(x) <= 12 and x not in ({caps})"), family(r"#\d{3,}"), family(r"\bv\d+(?:\.\d+){1,3}\b"),
        family(r"\b(?:[A-Z][a-z]{2,})(?:\s+[A-Z][a-z]{2,}){1,2}\b", f"lower(x) not in ({stop})"),
    )) + "))"


_ENT = _entity_sql()


@query(f"""with {_ENT}, df as (select entity, count(*) df from ent group by entity having count(*) >= 2)
select doc_id, round(sum(1.0 / df), 8) score, count(*) n_shared from ent join df using (entity) group by doc_id""")
def q_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """Every document by the entities it shares with others, rare ones counting more."""
    i = dedup.entity_index(table(spark, sf, "documents"), "doc_id", "text")
    df = i.groupBy("entity").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")
    return i.join(df, "entity").groupBy("doc_id").agg(F.round(F.sum(1 / F.col("df")), 8).alias("score"), F.count(F.lit(1)).alias("n_shared"))


@query(f"""with {_ENT}, q as (select distinct entity from ent where doc_id % 20 = 0), w as (select ent.* from ent join q using (entity)), df as (select entity, count(*) df from w group by entity)
select doc_id id, round(sum(1.0 / df), 8) score, count(*) n_shared from w join df using (entity) group by doc_id order by round(sum(1.0 / df), 9) desc, doc_id limit 8""")
def q_bridge_query(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that share most with a question, here one that names all entities of every twentieth document."""
    from mnemora.operators import retrieval

    i = dedup.entity_index(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "id")
    return retrieval.bridge(i, i.where("id % 20 = 0")).withColumn("score", F.round("score", 8))


@query(f"with {_ENT} select * from ent")
def q_entities(spark: SparkSession, sf: str) -> DataFrame:
    """All entity families of every document."""
    return dedup.entity_index(table(spark, sf, "documents"), "doc_id", "text")


@query(r"""with d as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') t from documents where length(text) > 0),
c as (select doc_id, t, list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') p, regexp_matches(t, '(?m)^\s*(?:[-*+]|\d+[.)])\s+') b from d),
s as (select *, list_filter(list_transform(regexp_extract_all(t, '(?s)[^.!?]+[.!?]+|\S[^.!?]*$'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') ss from c),
g as (select *, list_reduce(list_transform(ss, lambda x: {'done': []::varchar[], 'open': x, 'single': true}), lambda a, x: case when a.single and length(a.open) + length(x.open) < 200
  then {'done': a.done, 'open': a.open || ' ' || x.open, 'single': false} else {'done': list_append(a.done, a.open), 'open': x.open, 'single': true} end) r from s where len(ss) > 0 and not b and not (len(p) > 1 or contains(lower(t), '**why:**'))),
u as (select doc_id, list_append(r.done, r.open) us from g union all
  select doc_id, list_filter(list_transform(string_split_regex(t, '(?m)^\s*(?:[-*+]|\d+[.)])\s+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') from c where b union all
  select doc_id, p from c where not b and (len(p) > 1 or contains(lower(t), '**why:**'))),
e as (select doc_id, unnest(range(0, len(us)))::int pos, unnest(us) body from u),
k as (select doc_id, pos, body, trim(regexp_extract(body, '(.{10,}?[.!?])(\s|$)', 1)) h, lower(body) l, list_sort(list_distinct(regexp_extract_all(body, '\b20\d\d-[01]\d-[0-3]\d\b'))) dd from e where length(body) >= 12),
y as (select *, case when h <> '' then h else body end f from k)
select doc_id, pos, case when length(f) > 60 then rtrim(substr(f, 1, 59)) || '…' else f end title, body,
  case when regexp_matches(l, 'don''t|do not|stop |always |never |prefer |avoid ') then 'feedback' when regexp_matches(l, 'i |my |we |i''m|i am ') and regexp_matches(l, 'role|background|year|experience|engineer|scientist') then 'user'
    when regexp_matches(l, 'see |tracked in |lives at |url|https://|linear|grafana') then 'reference' else 'project' end kind, dd[1] valid_from, case when len(dd) > 1 then dd[-1] end valid_to from y""")
def q_rule_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """Facts split from documents by rule."""
    from mnemora.functions.atoms import rule_atoms

    return rule_atoms(table(spark, sf, "documents"), "doc_id", "text")


@query(f"""with {ALL_NODES_SQL}, t as (select id, case when contains(lower(id), '0001') then 1.0 else 0.85 end score from an where contains(lower(id), '0001') or contains(lower(coalesce(name, '') || ' ' || coalesce(body, '')), '0001'))
select id, score from t order by score desc, id limit 5""")
def q_term_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A term looked up in ids first, in texts second."""
    n, term = all_nodes(spark, sf), F.lit("0001")
    in_id, in_text = F.contains(F.lower("id"), term), F.contains(F.lower(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))), term)
    return n.where(in_id | in_text).select("id", F.when(in_id, F.lit(1.0)).otherwise(F.lit(0.85)).alias("score")).orderBy(F.col("score").desc(), "id").limit(5)


@query(f"""with {ALL_NODES_SQL} select id, round(coalesce(relevance, 0.5) * case when lower(type) in ('fact', 'decision') then 1.2 when lower(type) = 'episode' then 0.8 else 1.0 end + case when contains(lower(coalesce(name, '')), 'recall') then 0.3 else 0.0 end, 6) score from an""")
def q_type_weighting(spark: SparkSession, sf: str) -> DataFrame:
    """Scores weighted by type, with a bonus for a term in the name."""
    w = F.when(F.lower("type").isin("fact", "decision"), 1.2).when(F.lower("type") == "episode", 0.8).otherwise(1.0)
    bonus = F.when(F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit("recall")), 0.3).otherwise(0.0)
    return all_nodes(spark, sf).select("id", F.round(F.coalesce("relevance", F.lit(0.5)) * w + bonus, 6).alias("score"))


_GONE = "go as (select id from nd where tier = 'cold' and coalesce(salience, 0) < 0.2 and relevance < 0.2)"


@query(f"""with {NODES_SQL}, {WEB_SQL}, {_GONE} select 'nodes' part, count(*) n from nd where id not in (select id from go) union all select 'archive', count(*) from go
union all select 'web', count(*) from we where src not in (select id from go) and dst not in (select id from go)
union all select 'chains', count(*) from chains where coalesce(src, '') not in (select id from go) and coalesce(dst, '') not in (select id from go)""")
def q_forget_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Cold, plain, irrelevant nodes taken out of every table: rows left in each."""
    n = nodes(spark, sf)
    gone = n.where("tier = 'cold' and coalesce(salience, 0) < 0.2 and relevance < 0.2").select("id")
    f = lifecycle.forget(n, table(spark, sf, "chains"), web_edges(spark, sf), gone)
    part = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return part("nodes", f.nodes).unionByName(part("archive", f.archive)).unionByName(part("web", f.web_edges)).unionByName(part("chains", f.chain_edges))


@query(f"with {NODES_SQL} select id, tier, relevance from nd")
def q_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Forgotten nodes restored from the archive: the same rows as before."""
    n = nodes(spark, sf)
    gone = n.where("tier = 'cold'").select("id")
    f = lifecycle.forget(n, table(spark, sf, "chains"), web_edges(spark, sf), gone)
    return lifecycle.restore(f.nodes, f.archive, gone).select("id", "tier", "relevance")


_DUPES = "pr as (select x.id a, y.id b from nd x join nd y on y.id = 'n-' || lpad(cast(cast(substr(x.id, 3) as int) + 1 as varchar), 8, '0') where cast(substr(x.id, 3) as int) % 4 = 0)"


def _dupes(n: DataFrame) -> DataFrame:
    """Stand-in duplicate pairs: every fourth id and its successor."""
    num = F.substring("id", 3, 20).cast("int")
    a = n.where(num % 4 == 0).select(F.col("id").alias("a"), F.concat(F.lit("n-"), F.lpad((num + 1).cast("string"), 8, "0")).alias("b"))
    return a.join(n.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")


_WIN = """w as (select a, b, case when (coalesce(x.access_count, 0), length(coalesce(x.body, '')), coalesce(x.last_access, date '0001-01-01'), x.id) > (coalesce(y.access_count, 0), length(coalesce(y.body, '')), coalesce(y.last_access, date '0001-01-01'), y.id) then a else b end winner
  from pr join nd x on x.id = a join nd y on y.id = b)"""


@query(f"with {NODES_SQL}, {_DUPES}, {_WIN} select a, b, winner, case when winner = a then b else a end loser from w")
def q_merge_winner(spark: SparkSession, sf: str) -> DataFrame:
    """Which node of a duplicate pair stays."""
    n = nodes(spark, sf)
    return lifecycle.pick_winner(_dupes(n), n).select("a", "b", "winner", "loser")


@query(f"""with {NODES_SQL}, {_DUPES}, {_WIN}, l as (select winner, case when winner = a then b else a end loser from w)
select nd.id, case when lw.loser is null then nd.access_count else coalesce(nd.access_count, 0) + coalesce(z.access_count, 0) end access_count, case when lw.loser is null then nd.relevance else greatest(nd.relevance, z.relevance) end relevance,
  case when lw.loser is null then null else [lw.loser] end merged_from, case when ll.loser is not null and (nd.valid_to is null or nd.valid_to > date '{TODAY}') then date '{TODAY}' else nd.valid_to end valid_to
from nd left join l lw on lw.winner = nd.id left join nd z on z.id = lw.loser left join l ll on ll.loser = nd.id""")
def q_merge_dup(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes after duplicates were merged."""
    n = nodes(spark, sf)
    return lifecycle.merge_duplicates(n, _dupes(n), TODAY).select("id", "access_count", "relevance", "merged_from", "valid_to")


@query(f"""with {NODES_SQL}, {_DUPES} select nd.id, case when pr.a is not null and (valid_to is null or valid_to > date '{TODAY}') then date '{TODAY}' else valid_to end valid_to, pr.b superseded_by from nd left join pr on pr.a = nd.id""")
def q_supersede(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes closed by their successors."""
    n = nodes(spark, sf)
    return lifecycle.supersede(n, _dupes(n).select(F.col("a").alias("old_id"), F.col("b").alias("new_id")), TODAY).select("id", "valid_to", "superseded_by")


@query("""with e as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) k from events), a as (select * from e where event_type = 'view'), b as (select * from e where event_type = 'purchase')
select a.event_id pre_id, b.event_id post_id, b.event_id is null pending from a left join b on a.user_id = b.user_id and a.k = b.k""")
def q_prepost_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """The n-th view of a user paired with the n-th purchase; what is unmatched is pending."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    a = e.where("event_type = 'view'").select("user_id", "k", F.col("event_id").alias("pre_id"))
    b = e.where("event_type = 'purchase'").select("user_id", "k", F.col("event_id").alias("post_id"))
    return a.join(b, ["user_id", "k"], "left").select("pre_id", "post_id", F.col("post_id").isNull().alias("pending"))


@query("""with e as (select user_id, event_id, epoch_us(ts) / 1e6 t from events where event_type = 'error'), g as (select *, t - lag(t) over (partition by user_id order by t) gap from e) select event_id from g where gap is null or gap >= 3600""")
def q_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Errors at least an hour behind the user's previous one."""
    e = table(spark, sf, "events").where("event_type = 'error'").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return state.rate_limited(e, ["user_id"], "t", 3600).select("event_id")


@query("""select event_type || ':' || cast(floor(value / 50) as bigint) signature, count(*) seen_count, min(ts) first_seen, max(ts) last_seen from events group by 1""")
def q_bug_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Events of one signature counted once, with first and last sight."""
    return table(spark, sf, "events").groupBy(F.concat("event_type", F.lit(":"), F.floor(F.col("value") / 50).cast("bigint").cast("string")).alias("signature")).agg(
        F.count(F.lit(1)).alias("seen_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )


@query("""select event_type, count(*) n, count_if(value >= 50) n_high from events group by event_type having count_if(value >= 50) >= 3""")
def q_promotion_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures with three successes and more (a high value stands in for success)."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 50).alias("n_high")).where("n_high >= 3")


@query("""with e as (select user_id, ts, event_id, event_type = 'error' v from events), m as (select *, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, v order by ts, event_id) g from e),
r as (select user_id, v, g, count(*) n from m group by all) select user_id, max(n) longest from r where v group by user_id having max(n) >= 2""")
def q_run_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Users with two errors and more in a row."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("v"))
    return state.runs(e, ["user_id"], ["ts", "event_id"], F.col("v")).where("v").groupBy("user_id").agg(F.max("run").alias("longest")).where("longest >= 2")


@query(f"""with {WEB_SQL}, c as (select least(src, dst) a, greatest(src, dst) b, sum(n)::bigint n from we where ref_kind = 'mention' group by 1, 2), k as (select least(src, dst) a, greatest(src, dst) b, sum(n)::bigint n from we where ref_kind = 'provenance' group by 1, 2)
select coalesce(c.a, k.a) a, coalesce(c.b, k.b) b, coalesce(c.n, 0) + coalesce(k.n, 0) n from c full join k on c.a = k.a and c.b = k.b""")
def q_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Tallies of one kind merged into those of another."""
    def kind(name: str) -> DataFrame:
        return web_edges(spark, sf).where(F.col("ref_kind") == name).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("n").alias("n"))

    return state.upsert(kind("mention"), kind("provenance"), ["a", "b"], {"n": F.col("cur.n") + F.col("new.n")})


@query(f"""with recursive {NODES_SQL}, c as (select id, tier, ceil(length(coalesce(body, '')) / 4.0)::bigint tokens, row_number() over (partition by tier order by relevance desc nulls last, id) rn from nd where tier in ('hot', 'warm')),
w(tier, rn, id, spent, taken) as (select distinct tier, 0::bigint, null::varchar, 0::bigint, false from c union all
  select c.tier, c.rn, c.id, case when w.spent + c.tokens <= case c.tier when 'hot' then 240 else 360 end then w.spent + c.tokens else w.spent end, w.spent + c.tokens <= case c.tier when 'hot' then 240 else 360 end from w join c on c.tier = w.tier and c.rn = w.rn + 1 where c.rn <= 256)
select id, tier from w where taken""")
def q_inject_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Two layers packed first-fit, each into its share of 600 tokens, from all its nodes (the SQL walks the 256 best only)."""
    best = [F.col("relevance").desc_nulls_last(), "id"]
    c = nodes(spark, sf).where("tier in ('hot', 'warm')").select("tier", "id", "relevance", X.token_estimate_up("body").alias("tokens"))
    hot = packing.first_fit_taken(c.where("tier = 'hot'"), ["tier"], best, "tokens", 240)
    return hot.unionByName(packing.first_fit_taken(c.where("tier = 'warm'"), ["tier"], best, "tokens", 360)).select("id", "tier")


@query(f"""with {NODES_SQL}, b as (select id, 0.5 * coalesce(relevance, 0) + 0.2 * pow(0.5, case when last_access is null then 9999 else greatest(date_diff('day', last_access, date '{TODAY}'), 0) end / 14.0) + 0.15 * least(1.0, len(chains) / 8.0) + 0.10 * ln(1 + coalesce(access_count, 0)) / 5 s from nd)
select id, round(s, 6) score from b where s is not null order by s desc, id limit 50""")
def q_tier_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes ranked for the hot tier by relevance, recency, degree and access."""
    from mnemora.functions import scores as S

    s = 0.5 * F.coalesce("relevance", F.lit(0.0)) + 0.2 * S.half_life(S.days_since("last_access", TODAY), 14.0) + 0.15 * F.least(F.lit(1.0), F.size("chains") / 8.0) + 0.10 * F.log1p(F.coalesce("access_count", F.lit(0))) / 5
    return nodes(spark, sf).where("chains is not null").select("id", s.alias("s")).orderBy(F.col("s").desc(), "id").limit(50).select("id", F.round("s", 6).alias("score"))


@query(f"""with {ALL_NODES_SQL}, f as (select id, coalesce(body, '') body from an where target_state = 'frozen') select count(*) n, substr(sha256(string_agg(body, chr(10) order by id)), 1, 16) hash from f""")
def q_frozen_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Frozen nodes in order as one block, with its hash (a block is a prompt prefix, small by its purpose)."""
    f = all_nodes(spark, sf).where("target_state = 'frozen'").select("id", F.coalesce("body", F.lit("")).alias("body"))
    joined = f.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "body"))), lambda x: x["body"]), "\n").alias("t"))
    return joined.select("n", X.short_hash("t").alias("hash"))


@query(f"""with {ALL_NODES_SQL}, t as (select id, coalesce(body, '') body from an where coalesce(target_state, '') <> 'frozen'), i as (select id, coalesce(body, '') body from nd)
select coalesce(t.id, i.id) id, case when t.id is null then 'drop' when i.id is null or i.body <> t.body then 'embed' else 'keep' end action from t full join i on i.id = t.id""")
def q_index_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What an index of the nodes has to embed, drop and keep to become one of nodes and standing nodes without the frozen ones."""
    from mnemora.operators.index import VectorIndex

    built = VectorIndex.open(spark).build(nodes(spark, sf), "id", "body")
    return built.status(all_nodes(spark, sf).where("coalesce(target_state, '') <> 'frozen'"), "id", "body")


@query(f"""with {ALL_NODES_SQL} select count(*) "rows", 384 dim, 2 version from an where coalesce(target_state, '') <> 'frozen'""")
def q_index_info(spark: SparkSession, sf: str) -> DataFrame:
    """The index after it was built on the nodes and brought up to all nodes but the frozen ones."""
    from mnemora.operators.index import VectorIndex

    built = VectorIndex.open(spark).build(nodes(spark, sf), "id", "body")
    known = VectorIndex.open(spark, built.build(all_nodes(spark, sf).where("coalesce(target_state, '') <> 'frozen'"), "id", "body").path).info()
    return spark.createDataFrame([(known["rows"], known["dim"], known["version"])], "rows bigint, dim int, version int")


@query(f"""with {ALL_NODES_SQL}, c as (select id, title, body, 'x' from (select id, coalesce(name, '') title, coalesce(body, '') body from an)) select id,
  length(body) < 25 or regexp_matches(rtrim(body), '(\\.\\.\\.|…)$') or contains(title, '**') or contains(title, '…') or regexp_matches(ltrim(body), '^(\\*\\*|- |\\* |#|```|\\||>)') or regexp_matches(ltrim(title), '^(\\*\\*|- |\\* |#|```|\\||>)') junk from c""")
def q_junk(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes whose text is a leftover rather than a fact."""
    return all_nodes(spark, sf).select("id", X.is_junk(F.coalesce("name", F.lit("")), F.coalesce("body", F.lit(""))).alias("junk"))


@query()
def q_erosion_pass(spark: SparkSession, sf: str) -> DataFrame:
    """One erosion pass over anchored nodes (chosen characters come from a hash; tested on fixtures)."""
    n = all_nodes(spark, sf)
    return lifecycle.erosion_pass(n, lifecycle.capture_anchors(spark.createDataFrame([], "id string, anchor string"), n), TODAY)


@query(f"with {ALL_NODES_SQL} select id, body, case when body is null then integrity else floor(1000000.0 * (coalesce(integrity, 1.0) + (1 - coalesce(integrity, 1.0)) * 0.5) + 0.5) / 1000000.0 end integrity from an")
def q_partial_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies back from their anchors in full, the integrity number by half."""
    n = all_nodes(spark, sf)
    return lifecycle.repair(n, lifecycle.capture_anchors(spark.createDataFrame([], "id string, anchor string"), n), 0.5).select("id", "body", "integrity")

