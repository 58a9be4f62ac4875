"""Queries over nodes and documents: scores, predicates, texts, health; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import scores as S
from mnemora.functions import temporal as T
from mnemora.functions import text as X
from mnemora.operators import lifecycle
from mnemora.plans.common import ALL_NODES_SQL, NODES_SQL, NOW, TODAY, all_nodes, nodes
from mnemora.sources.tables import table

AT, LOW, HIGH = "2010-01-15", "2010-01-01", "2010-01-31"
_TIER = "case when {0} >= 0.75 then 'hot' when {0} >= 0.5 then 'warm' when {0} >= 0.25 then 'cold' else 'frozen' end"
_DAYS = f"case when last_access is null then 9999 else greatest(date_diff('day', last_access, date '{TODAY}'), 0) end"
_RATE = "case material_grade when 'enriched' then 0.001 when 'fertile' then 0.01 when 'depleted' then 0.10 when 'waste' then 0.20 else 0.05 end"
_CAPTURE = f"""case when coalesce(stc_capture_score, 0) <= 0 then 0.0 when coalesce(stc_capture_at, 0) <= 0 then least(1.0, stc_capture_score)
  else greatest(0.0, least(1.0, stc_capture_score * pow(0.5, greatest(0.0, ({NOW} - stc_capture_at) / 86400.0) / 3.0))) end"""
_CLAMPED = "greatest(0.0, least(1.0, coalesce(salience, 0)))"
_STEP = f"""(coalesce(relevance, 0.5) + ((case when ({_DAYS}) <= 7 then 0.5 else 0.0 end) - coalesce(relevance, 0.5)) * ({_RATE} * (1 - least(0.95, 0.9 * {_CLAMPED} + 0.5 * {_CAPTURE}))))"""

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


@query(f"with {NODES_SQL} select id, valid_from, valid_to from nd where (valid_from is null or valid_from <= date '{AT}') and (valid_to is null or valid_to >= date '{AT}')")
def q_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes valid on a day."""
    return nodes(spark, sf).where(T.holds_at(AT, F.col("valid_from"), F.col("valid_to"))).select("id", "valid_from", "valid_to")


@query(f"with {NODES_SQL} select id from nd where valid_to is null or valid_to >= date '{AT}'")
def q_since(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes not ended before a day."""
    return nodes(spark, sf).where(T.holds_since(AT, F.col("valid_to"))).select("id")


@query(f"with {NODES_SQL} select id from nd where not (coalesce(valid_to, date '9999-12-31') < date '{LOW}' or coalesce(valid_from, date '0001-01-01') > date '{HIGH}')")
def q_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes whose validity meets a range."""
    return nodes(spark, sf).where(T.overlaps(LOW, HIGH, F.col("valid_from"), F.col("valid_to"))).select("id")


@query(rf"""with {NODES_SQL} select id, coalesce(valid_from, last_access,
  list_min(list_transform(regexp_extract_all(coalesce(body, ''), '\b20\d\d-[01]\d-[0-3]\d\b'), lambda d: try_cast(d as date))), date '{TODAY}') valid_from from nd""")
def q_infer_date(spark: SparkSession, sf: str) -> DataFrame:
    """valid_from where it is set, else inferred from access or text."""
    return nodes(spark, sf).select("id", F.coalesce("valid_from", T.infer_valid_from(F.col("last_access"), F.col("body"), F.lit(TODAY).cast("date"))).alias("valid_from"))


@query(f"""with {NODES_SQL}, s as (select id, relevance, floor({_STEP} * 10000.0 + 0.5) / 10000.0 r from nd)
select id, r new_relevance, {_TIER.format("r")} new_tier from s""")
def q_decay_step(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance and tier after one decay step."""
    capture = S.attenuate("stc_capture_score", "stc_capture_at", NOW)
    step = S.step_relevance("relevance", S.days_since("last_access", TODAY), "material_grade", "salience", capture)
    return nodes(spark, sf).select("id", S.rounded(step).alias("new_relevance")).withColumn("new_tier", S.tier_for("new_relevance"))


@query(f"""with {NODES_SQL}, s as (select *, floor({_STEP} * 10000.0 + 0.5) / 10000.0 r from nd where coalesce(target_state, 'live') = 'live'),
d as (select id, tier, r, {_TIER.format("r")} t, coalesce(relevance, 0.5) old, coalesce(salience, 0) sal from s)
select id, r new_relevance, t new_tier, case when t = 'frozen' and coalesce(tier, '') <> 'frozen' and sal < 0.85 then 'archive' else 'update' end action
from d where t is distinct from tier or abs(r - old) > 1e-4""")
def q_decay_pass(spark: SparkSession, sf: str) -> DataFrame:
    """What the decay pass would write: changed rows, newly frozen ones to be archived."""
    return lifecycle.decay_pass(nodes(spark, sf), TODAY, NOW).select("id", "new_relevance", "new_tier", "action")


@query(f"""with recursive {NODES_SQL}, t(id, grade, sal, rel, tick) as (
  select id, material_grade, {_CLAMPED}, coalesce(relevance, 0.5)::double, 0 from nd
  union all select id, grade, sal, floor((rel + (0.0 - rel) * ((case grade when 'enriched' then 0.001 when 'fertile' then 0.01 when 'depleted' then 0.10 when 'waste' then 0.20 else 0.05 end) * (1 - least(0.95, 0.9 * sal)))) * 10000.0 + 0.5) / 10000.0, tick + 1 from t where tick < 14)
select id, rel, {_TIER.format("rel")} tier from t where tick = 14""")
def q_decay_14(spark: SparkSession, sf: str) -> DataFrame:
    """Fourteen rounded stale steps: the rounding feeds back, so the steps are folded, not solved."""
    rel = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.coalesce("relevance", F.lit(0.5)).cast("double"), lambda r, _: S.rounded(S.step_relevance(r, F.lit(99), "material_grade", "salience")))
    return nodes(spark, sf).select("id", rel.alias("rel")).withColumn("tier", S.tier_for("rel"))


@query(f"""with {NODES_SQL} select id, floor(1e8 * greatest(0.0, 0.02e0 * (case when type = 'fact' then 0.25e0 else case lower(tier) when 'hot' then 0.25e0 when 'cold' then 2.5e0 when 'frozen' then 0.25e0 else 1e0 end end)
  * (1 + least(3e0, ({_DAYS}) * 0.02e0)) * (1 - 0.9e0 * {_CLAMPED})) + 0.5) / 1e8 rate, floor(1e8 * ({_CAPTURE}) + 0.5) / 1e8 capture from nd""")
def q_erosion_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Erosion rate and faded capture score."""
    rate = S.erosion_rate(S.days_since("last_access", TODAY), "tier", "salience", F.col("type").eqNullSafe("fact"))
    return nodes(spark, sf).select("id", S.rounded(rate, 8).alias("rate"), S.rounded(S.attenuate("stc_capture_score", "stc_capture_at", NOW), 8).alias("capture"))


@query(f"""with {NODES_SQL}, q as (select *, case when coalesce(relevance, case lower(trim(coalesce(tier, 'warm'))) when 'hot' then 0.8 when 'cold' then 0.4 when 'frozen' then 0.1 else 0.6 end) >= 0.75 then 5
  when coalesce(relevance, case lower(trim(coalesce(tier, 'warm'))) when 'hot' then 0.8 when 'cold' then 0.4 when 'frozen' then 0.1 else 0.6 end) >= 0.5 then 4
  when coalesce(relevance, case lower(trim(coalesce(tier, 'warm'))) when 'hot' then 0.8 when 'cold' then 0.4 when 'frozen' then 0.1 else 0.6 end) >= 0.25 then 3 else 1 end q from nd where next_review <= date '{TODAY}'),
r as (select id, q, floor(1e3 * case when q < 3 then coalesce(easiness_factor, 2.5) else greatest(1.3, coalesce(easiness_factor, 2.5) + (0.1e0 - (5 - q) * (0.08e0 + (5 - q) * 0.02e0))) end + 0.5) / 1e3 easiness_factor,
  cast(case when q < 3 then 1 when coalesce(review_count, 0) = 0 then 1 when review_count = 1 then 6 else greatest(1, round_even(coalesce(review_interval_days, 1) * coalesce(easiness_factor, 2.5), 0)) end as bigint) review_interval_days,
  cast(case when q < 3 then 0 else coalesce(review_count, 0) + 1 end as bigint) review_count from q)
select id, cast(q as int) quality, easiness_factor, review_interval_days, review_count, cast(date '{TODAY}' + cast(review_interval_days as int) as date) next_review from r""")
def q_sm2(spark: SparkSession, sf: str) -> DataFrame:
    """Spaced-repetition update of every node that is due."""
    return lifecycle.review_sweep(nodes(spark, sf), TODAY)


@query(f"with {NODES_SQL} select id, next_review, coalesce(review_count, 0) review_count from nd where next_review <= date '{TODAY}'")
def q_sm2_due(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes due for review, earliest first."""
    return nodes(spark, sf).where(F.col("next_review") <= F.lit(TODAY).cast("date")).select("id", "next_review", F.coalesce("review_count", F.lit(0)).alias("review_count")).orderBy("next_review", "id")


@query(f"""with {ALL_NODES_SQL} select id, floor(1e6 * greatest(0.0, least(1.0, 0.5 * coalesce(relevance, 0.5) * pow(0.45, greatest(0, coalesce(review_count, 0))) + 0.3 * (case when valid_to is not null then 1.0 else 0.0 end)
  + 0.2 * least(1.0, coalesce(access_count, 0) / 5.0))) + 0.5) / 1e6 salience from an""")
def q_salience(spark: SparkSession, sf: str) -> DataFrame:
    """Composite salience; surprise stands in from relevance, contradiction from an ended validity."""
    s = S.composite_salience(F.coalesce("relevance", F.lit(0.5)), F.col("valid_to").isNotNull().cast("double"), F.coalesce("access_count", F.lit(0)), recalls=F.coalesce("review_count", F.lit(0)))
    return all_nodes(spark, sf).select("id", S.rounded(s, 6).alias("salience"))


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
WORDS_SQL = f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z0-9_]+')), lambda w: length(w) >= 3 and not list_contains([{_STOP}], w))"


@query(f"select doc_id, len({WORDS_SQL.format('text')})::int n_words from documents")
def q_word_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Number of content words of each document."""
    return table(spark, sf, "documents").select("doc_id", F.size(X.word_set("text")).alias("n_words"))


@query(r"""with seg as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') s from documents where text is not null),
e as (select doc_id, unnest(s) content, unnest(range(len(s))) pos from seg)
select doc_id, cast(pos as int) pos, substr(sha256(regexp_replace(lower(content), '\s+', ' ', 'g')), 1, 16) content_hash, cast(floor(length(content) / 3.6) as bigint) tokens from e""")
def q_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of documents with hash and token estimate."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(X.segments("text")).alias("pos", "content"))
    return d.select("doc_id", "pos", X.segment_hash("content").alias("content_hash"), X.token_estimate("content").alias("tokens"))


@query(r"""with p as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '`([^`\n]{2,40})`', 1), lambda s: trim(s)), lambda s: s <> '' and not regexp_full_match(s, '\d+')) code,
  regexp_extract_all(text, '\bv\d+(?:\.\d+){1,3}\b') ver, regexp_extract_all(text, '#\d{3,}') iss from documents where text is not null),
u as (select distinct doc_id, lower(e) entity from (select doc_id, unnest(list_concat(code, ver, iss)) e from p))
select doc_id, entity from u""")
def q_entity_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Three of the seven entity families, those whose patterns both engines read alike."""
    t = table(spark, sf, "documents").where("text is not null")
    code = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"`([^`\n]{2,40})`"), 1), lambda x: F.trim(x)), lambda s: (s != "") & ~s.rlike(r"^\d+$"))
    parts = F.concat(code, F.regexp_extract_all("text", F.lit(r"\bv\d+(?:\.\d+){1,3}\b"), 0), F.regexp_extract_all("text", F.lit(r"#\d{3,}"), 0))
    return t.select("doc_id", F.explode(parts).alias("e")).select("doc_id", F.lower("e").alias("entity")).distinct()


@query(r"""select doc_id, list_filter([case when regexp_matches(text, '(?i)ignore\s+previous\s+instructions') then 1 end, case when regexp_matches(text, '(?i)you\s+are\s+now\b') then 2 end,
  case when regexp_matches(text, '(?im)^system\s*:') then 3 end, case when regexp_matches(text, '(?i)disregard\s+(all\s+)?prior\s+(instructions|context)') then 4 end,
  case when regexp_matches(text, '(?i)new\s+instructions?\s*:') then 5 end], lambda x: x is not null) markers from documents where text is not null""")
def q_injection_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt-injection markers of every document."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", X.injection_markers("text").alias("markers"))


@query(f"""with {ALL_NODES_SQL} select coalesce(tier, '?') tier, coalesce(type, '?') type, count(*) n, count_if(valid_from is null) no_valid_from, count_if(len(chains) = 0 or chains is null) no_chain,
  round(avg(relevance), 6) mean_relevance from an group by 1, 2""")
def q_health(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and lacks by tier and type."""
    return all_nodes(spark, sf).groupBy(F.coalesce("tier", F.lit("?")).alias("tier"), F.coalesce("type", F.lit("?")).alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("valid_from").isNull()).alias("no_valid_from"),
        F.count_if(F.coalesce(F.size("chains"), F.lit(0)) <= 0).alias("no_chain"), F.round(F.avg("relevance"), 6).alias("mean_relevance"),
    )


@query(rf"""with {ALL_NODES_SQL}
select id, case when contains(lower(coalesce(body, '')), 'don''t') or contains(lower(coalesce(body, '')), 'do not') or contains(lower(coalesce(body, '')), 'stop ') or contains(lower(coalesce(body, '')), 'always ') or contains(lower(coalesce(body, '')), 'never ')
  or contains(lower(coalesce(body, '')), 'prefer ') or contains(lower(coalesce(body, '')), 'avoid ') then 'feedback'
  when regexp_matches(lower(coalesce(body, '')), 'i |my |we |i''m|i am ') and regexp_matches(lower(coalesce(body, '')), 'role|background|year|experience|engineer|scientist') then 'user'
  when regexp_matches(lower(coalesce(body, '')), 'see |tracked in |lives at |url|https://|linear|grafana') then 'reference' else 'project' end kind from an""")
def q_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kind of each node's text by key words."""
    return all_nodes(spark, sf).select("id", X.kind_of(F.coalesce("body", F.lit(""))).alias("kind"))


@query(f"""with {NODES_SQL}, u as (select unnest(chains) chain, valid_from from nd where chains is not null)
select chain, count(*) members, min(valid_from) oldest, count(*) >= 4 and coalesce(date_diff('day', min(valid_from), date '{TODAY}') >= 7, false) mature from u group by chain""")
def q_maturity(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of four members and more whose oldest is a week old."""
    m = nodes(spark, sf).select(F.explode("chains").alias("chain"), "valid_from").groupBy("chain").agg(F.count(F.lit(1)).alias("members"), F.min("valid_from").alias("oldest"))
    return m.withColumn("mature", (F.col("members") >= 4) & F.coalesce(F.datediff(F.lit(TODAY).cast("date"), "oldest") >= 7, F.lit(False)))


@query(f"""with {ALL_NODES_SQL}, c as (select * from (
  select 'tier_overflow' part, greatest(count_if(tier in ('hot', 'warm')) - 550, 0)::double raw, 0.2 weight, 200.0 cap from an
  union all select 'due_reviews', count_if(next_review <= date '{TODAY}')::double, 0.3, 100.0 from an
  union all select 'no_valid_from', count_if(valid_from is null)::double, 0.2, 500.0 from an
  union all select 'weak_edges', (select count_if(coalesce(weight, 0) < 0.85) from edges)::double, 0.3, 1000.0))
select round(sum(weight * least(1.0, raw / cap)), 6) pressure, sum(weight * least(1.0, raw / cap)) >= 0.5 sleepy from c""")
def q_pressure(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted backlog of maintenance work, each part capped."""
    n = all_nodes(spark, sf).agg(
        F.greatest(F.count_if(F.col("tier").isin("hot", "warm")) - 550, F.lit(0)).alias("a"), F.count_if(F.col("next_review") <= F.lit(TODAY).cast("date")).alias("b"), F.count_if(F.col("valid_from").isNull()).alias("c")
    )
    e = table(spark, sf, "edges").agg(F.count_if(F.coalesce("weight", F.lit(0.0)) < 0.85).alias("d"))
    part = lambda c, w, cap: w * F.least(F.lit(1.0), F.col(c) / cap)
    total = part("a", 0.2, 200.0) + part("b", 0.3, 100.0) + part("c", 0.2, 500.0) + part("d", 0.3, 1000.0)
    return n.crossJoin(e).select(F.round(total, 6).alias("pressure"), (total >= 0.5).alias("sleepy"))


@query(f"""with {NODES_SQL}, s as (select id, last_access, access_count from nd order by last_access desc nulls last, access_count desc nulls last, id desc limit 256) select id from s""")
def q_lru(spark: SparkSession, sf: str) -> DataFrame:
    """The 256 most recently accessed nodes."""
    from mnemora.operators.state import keep_newest

    return keep_newest(nodes(spark, sf), ["last_access", "access_count", "id"], 256).select("id")


@query(f"with {NODES_SQL} select id, description, access_count from nd")
def q_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Re-exported nodes reduced to one record each."""
    return nodes(spark, sf).select("id", "description", "access_count")


@query(f"""with {NODES_SQL}, t as (select id, string_agg(x, chr(10)) txt from (select id, unnest([coalesce(name, '') || '. ' || coalesce(description, ''), '', coalesce(body, '')]) x from nd) group by id),
o as (select id, cast(floor(length(coalesce(name, '') || '. ' || coalesce(description, '') || chr(10) || chr(10) || coalesce(body, '')) / 3.6) as bigint) tokens from nd),
r as (select *, sum(tokens) over (order by id rows unbounded preceding) total from o)
select id, tokens, cast(total as bigint) total from r where total <= 2000""")
def q_prefix_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes in order of id up to a token budget: the first that does not fit ends the list."""
    from mnemora.operators import packing

    sized = nodes(spark, sf).select("id", X.token_estimate(F.concat(F.coalesce("name", F.lit("")), F.lit(". "), F.coalesce("description", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))).alias("tokens"))
    return packing.prefix_budget(sized, [], ["id"], "tokens", 2000).select("id", "tokens", "total")


@query(f"""with {NODES_SQL}, o as (select lower(type) kind, id, access_count, count(*) over (partition by type) c from nd where type is not null)
select kind, quantile_cont(access_count, 0.5) p50, quantile_cont(access_count, 0.95) p95, avg(access_count) mean, min(access_count) low, max(access_count) high from o group by kind""")
def q_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """Linear-interpolation percentiles with mean and range."""
    from mnemora.operators.evaluate import spread

    return spread(nodes(spark, sf).where("type is not null").select(F.lower("type").alias("kind"), "access_count"), ["kind"], "access_count")


@query(f"""with {NODES_SQL} select id, case when coalesce(target_state, '') = 'archived' then false when target_state = 'frozen' then false else true end writable,
  case when target_state = 'archived' then 'archived is never writable' when target_state = 'frozen' then 'frozen needs an override' else 'ok' end reason from nd""")
def q_writable(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a node may be written in its state, and why not."""
    return lifecycle.check_writable(nodes(spark, sf)).select("id", "writable", "reason")

