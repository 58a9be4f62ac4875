"""Queries p2, p5, p6, p7 and p8 over the memory store's tables, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm import cooccurrence, leakage, mixing, neardup, residue
from mnemora.operators.sessions import epoch_micros
from mnemora.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _node(c: Column) -> Column:
    return F.regexp_replace(c, r"\.md$", "")


# ---- p2: items that appear together ----
PAIR_MIN_SITTINGS, PAIR_MIN_EDGES, PAIR_MIN_LIFT = 15, 40, 5


def sitting_baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Each sitting is a basket of its nodes; replay is none. A later delivery is a later version."""
    rows = table(spark, sf, "sittings").where("coalesce(provenance, 'genuine') <> 'replay'")
    # a sitting without an id is known by its content, so that a second delivery is the same sitting
    content = F.md5(F.to_json(F.struct("workspace", epoch_micros("t", "day").alias("us"), "events", "provenance")))
    return rows.select(
        F.coalesce(F.col("sitting_id").cast("string"), F.concat(F.lit("row-"), content)).alias("key"),
        F.coalesce(F.transform(F.flatten(F.filter("events", lambda e: e.isNotNull())), _node), F.array().cast("array<string>")).alias("items"),
        F.lit(1).alias("weight"), F.unix_micros(F.col("arrived_at").cast("timestamp")).alias("version"),
    )


def edge_baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Each directed co-activation edge is a basket of its two ends, weighted by its tally; a later snapshot is a later version."""
    src, dst = _node(F.col("src_node")), _node(F.col("dst_node"))
    rows = table(spark, sf, "edges").where("ref_kind = 'coactivation' and src_node is not null and dst_node is not null")
    return rows.select(
        F.concat_ws("\u0001", src, dst).alias("key"), F.array(src, dst).alias("items"),
        F.coalesce("occurrence_count", F.lit(1)).alias("weight"), F.unix_micros(F.col("last_seen_at").cast("timestamp")).alias("version"),
    ).where(src != dst)


def _increments(baskets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What arrived by the middle of the time of arrival, and the rest; of a basket delivered again, one part may hold the old and the other the new."""
    low, high = baskets.agg(F.min("version"), F.max("version")).first()
    middle = 0 if low is None else (low + high) // 2
    return baskets.where(F.col("version").isNull() | (F.col("version") < middle)), baskets.where(F.col("version") >= middle)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs far beyond chance, kept up over two increments: the second changes baskets of the first, and only pairs it affects are scored again."""

    def found(basis: str, baskets: DataFrame, least: int, factor: int) -> DataFrame:
        state = cooccurrence.PairTable(spark)
        for part in _increments(baskets):
            state.apply(part).refresh(least)
        return state.scores(least, factor, PAIR_MIN_LIFT).select(F.lit(basis).alias("basis"), "node_a", "node_b")

    return found("sittings", sitting_baskets(spark, sf), PAIR_MIN_SITTINGS, 1).unionByName(found("edges", edge_baskets(spark, sf), PAIR_MIN_EDGES, 2))


def p2_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and scores of all the sittings' pairs after two increments."""
    state = cooccurrence.PairTable(spark)
    for part in _increments(sitting_baskets(spark, sf)):
        state.apply(part)
    return state.scores(1, 1, 0).select("node_a", "node_b", "n_ab", "n_a", "n_b", "score")


_BASKET_SQL = r"""once as (select events from (
  select events, row_number() over (partition by sitting_id order by arrived_at desc) rn from sittings where coalesce(provenance, 'genuine') <> 'replay') where rn = 1),
rec as (select row_number() over () rid, list_distinct(list_transform(flatten(events), lambda x: regexp_replace(x, '\.md$', ''))) items from once),
m as (select rid, unnest(items) node from rec),
na as (select node, count(*) n from m group by node),
tot as (select count(*) n from rec),
nab as (select a.node node_a, b.node node_b, count(*) n from m a join m b on a.rid = b.rid and a.node < b.node group by 1, 2)"""

SQL: dict[str, str] = {
    "p2_found": rf"""with {_BASKET_SQL},
e as (select s, d, coalesce(occurrence_count, 1) c from (
  select *, row_number() over (partition by s, d order by last_seen_at desc, coalesce(occurrence_count, 1) desc) rn from (
    select *, regexp_replace(src_node, '\.md$', '') s, regexp_replace(dst_node, '\.md$', '') d from edges where ref_kind = 'coactivation')) where rn = 1 and s <> d),
c as (select least(s, d) node_a, greatest(s, d) node_b, sum(c) n from e group by 1, 2),
ma as (select node, sum(n) n from (select node_a node, n from c union all select node_b, n from c) group by 1),
t as (select sum(n) n from c)
select 'sittings' basis, node_a, node_b from nab join na x on x.node = node_a join na y on y.node = node_b, tot
where nab.n >= {PAIR_MIN_SITTINGS} and nab.n * tot.n >= {PAIR_MIN_LIFT} * x.n * y.n
union all
select 'edges', node_a, node_b from c join ma x on x.node = node_a join ma y on y.node = node_b, t
where c.n >= {PAIR_MIN_EDGES} and 2 * t.n * c.n >= {PAIR_MIN_LIFT} * x.n * y.n""",
    "p2_scores": rf"""with {_BASKET_SQL}
select node_a, node_b, nab.n n_ab, x.n n_a, y.n n_b, 1.0::double * nab.n * tot.n / (x.n::double * y.n) score
from nab join na x on x.node = node_a join na y on y.node = node_b, tot""",
}

QUERIES: dict[str, Query] = {"p2_found": p2_found, "p2_scores": p2_scores}


# ---- p5: near-duplicate segments ----
SEGMENT_WORDS, SEGMENT_SIMILARITY = 3, 0.5


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf, "pool"), "pool_addr", "content", SEGMENT_WORDS, SEGMENT_SIMILARITY)
    return found.pairs("addr_a", "addr_b").select("addr_a", "addr_b")


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every segment's class of near copies and its number of linked other texts."""
    found = neardup.near_duplicates(table(spark, sf, "pool"), "pool_addr", "content", SEGMENT_WORDS, SEGMENT_SIMILARITY)
    return found.classes().select(F.col("id").alias("pool_addr"), "class_id", "n_links")


QUERIES |= {"p5_found": p5_found, "p5_classes": p5_classes}
SQL["p5_found"] = """with d as (select distinct pool_addr, regexp_extract_all(lower(content), '[a-z0-9]+') w from pool where pool_addr is not null and content is not null),
s as (select distinct pool_addr, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) g from d where len(w) >= 3),
n as (select pool_addr, count(*) n from s group by 1),
c as (select a.pool_addr addr_a, b.pool_addr addr_b, count(*) i from s a join s b on a.g = b.g and a.pool_addr < b.pool_addr group by 1, 2)
select addr_a, addr_b from c join n x on x.pool_addr = addr_a join n y on y.pool_addr = addr_b where 2 * i >= x.n + y.n - i"""

SQL["p5_classes"] = """with recursive m as (select distinct pool_addr id, array_to_string(regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+'), ' ') t from pool where pool_addr is not null), d as (select distinct t, string_split(t, ' ') w from m),
k as (select t, w from d where len(w) >= 3), s as (select distinct t, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) g from k), n as (select t, count(*) n from s group by 1),
c as (select a.t x, b.t y, count(*) i from s a join s b on a.g = b.g and a.t <> b.t group by 1, 2), e as (select x, y from c join n p on p.t = x join n q on q.t = y where 2 * i >= p.n + q.n - i),
r(t, root) as (select t, t from k union select e.y, r.root from r join e on e.x = r.t), o as (select t, min(root) root from r group by 1), a as (select root, min(id) class_id from o join m using (t) group by 1), g as (select x t, count(*) n from e group by 1)
select id pool_addr, coalesce(class_id, id) class_id, coalesce(g.n, 0)::bigint n_links from m left join o using (t) left join a using (root) left join g using (t)"""


# ---- p6: held-out passages in documents ----
LEAK_WORDS = 12


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks of twelve whole words: bands and alignment with no room for an edit."""
    return leakage.leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "passage", LEAK_WORDS).select("doc_id", "item_id")


def p6_edited(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks of twelve words with at most one character changed, added or lost."""
    return leakage.leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "passage", LEAK_WORDS, 1)


QUERIES |= {"p6_found": p6_found, "p6_edited": p6_edited}
SQL["p6_found"] = """with d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents),
e as (select item_id, regexp_extract_all(lower(passage), '[a-z0-9]+') w from eval_items),
gd as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) g from d where len(w) >= 12),
ge as (select distinct item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) g from e where len(w) >= 12)
select distinct doc_id, item_id from gd join ge using (g)"""


# ---- p7: mixing sources to target weights ----
def _mix(spark: SparkSession, sf: str) -> mixing.Mix:
    return mixing.mix(table(spark, sf, "documents"), "doc_id", "text", "source", table(spark, sf, "mix_targets"))


def p7_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The documents drawn, in queue order."""
    return _mix(spark, sf).selection.withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share reached by each source, and its target."""
    return _mix(spark, sf).shares


QUERIES |= {"p7_selection": p7_selection, "p7_shares": p7_shares}


# ---- p8: template residue and error pages ----
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.find_residue(table(spark, sf, "documents"), "doc_id", "text").select("doc_id")


def p8_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the kinds of residue they hold."""
    found = residue.find_residue(table(spark, sf, "documents"), "doc_id", "text")
    return found.groupBy(F.array_join("kinds", "+").alias("kinds")).agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES |= {"p8_found": p8_found, "p8_kinds": p8_kinds}
