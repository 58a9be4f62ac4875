"""Vector retrieval: top-k, blocked searches of many queries, grouping by chain, blending, reserves and packing.

One query is a constant vector: rows are scored in whole Arrow batches and a distributed top-k keeps the best.
Many queries are read by the tasks in blocks: each task multiplies its rows with a block of query vectors and passes on its
own best k per query, so what is shuffled is queries x tasks x k rows, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from mnemora.functions import vectors as V
from mnemora.runtime import broadcast_if_small, new_dir, shared_files

#: Queries and rows whose scores are worked out at once: 64 MB.
QUERY_BLOCK, ROW_BLOCK = 1_024, 8_192
#: Candidate hits a task holds before it cuts them to the best.
HELD = 1_000_000


def top_k(rows: DataFrame, query: Sequence[float], k: int, embedding: str = "embedding", key: str = "id", boost: Column | None = None, where: Column | None = None) -> DataFrame:
    """The k rows with the greatest dot product (plus `boost`): all columns and `score`; ties go to the least key.

    `where` (for example: not tombstoned) is applied before the cut. Rows whose vector is null or of another length
    are left out.
    """
    if where is not None:
        rows = rows.where(where)
    rows = rows.where(F.size(embedding) == len(query))
    score = V.scores_against(query)(embedding)
    scored = rows.withColumn("score", score if boost is None else score + boost).where("score is not null")
    return scored.orderBy(F.col("score").desc(), F.col(key)).limit(k)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1; zero vectors stay."""
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _scan(path: str, k: int | None, bar: float | None, schema: pa.Schema):
    """Rows of a partition, ROW_BLOCK at a time, against all query blocks of a shared folder."""

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        from pyarrow import parquet as pq

        system, files = shared_files(path)
        for f in files:
            t = pq.read_table(f, filesystem=system, columns=["q", "v"])
            if t.num_rows:
                yield t["q"].to_numpy(), _matrix(t["v"])

    def met(item: np.ndarray, x: np.ndarray) -> Iterator[pd.DataFrame]:
        order = np.argsort(item, kind="stable")
        sorted_item = item[order]
        for ids, q in blocks():
            s = q @ x.T
            lo, hi = np.searchsorted(sorted_item, ids, "left"), np.searchsorted(sorted_item, ids, "right")
            for i in np.flatnonzero(hi > lo).tolist():
                s[i, order[lo[i] : hi[i]]] = -np.inf  # a row is not its own neighbour
            ok = s >= bar if bar is not None else s > -np.inf
            if k is not None and s.shape[1] > k:
                ok &= s >= np.partition(s, -k, axis=1)[:, -k, None]  # ties stay until ranks are given
            i, j = np.nonzero(ok)
            yield pd.DataFrame({"query": ids[i], "item": item[j], "score": s[i, j]})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        top: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            rows = pa.Table.from_batches(held)
            held.clear()
            for at in range(0, rows.num_rows, ROW_BLOCK):
                part = rows.slice(at, ROW_BLOCK)
                for found in met(part.column(0).to_numpy(), _matrix(part.column(1))):
                    if k is None:
                        yield found
                        continue
                    top.append(found)
                    if sum(map(len, top)) > HELD:
                        best = _cut(pd.concat(top), k)
                        top[:] = [best]
                        if len(best) > HELD // 2:  # the lists of very many queries go out in parts
                            top.clear()
                            yield best

        for b in parts:
            held.append(b)
            if sum(x.num_rows for x in held) >= ROW_BLOCK:
                yield from (pa.RecordBatch.from_pandas(d, schema=schema, preserve_index=False) for d in flush())
        if held:
            yield from (pa.RecordBatch.from_pandas(d, schema=schema, preserve_index=False) for d in flush())
        if top:
            yield pa.RecordBatch.from_pandas(_cut(pd.concat(top), k), schema=schema, preserve_index=False)

    return run


def search(queries: DataFrame, rows: DataFrame, k: int | None, bar: float | None = None, key: str = "id", embedding: str = "embedding") -> DataFrame:
    """For each query row its k best rows, and/or those with cosine >= bar: `query`, the key as `item`, `score`, and with k also `rank`.

    The queries are a stated set (as one in twenty rows). They are written to the shared folder in files of QUERY_BLOCK and read
    there by the tasks, none through the driver; the rows are scanned once, whatever the number of queries, and a task never holds
    more than a block of scores. A row is not its own neighbour. Rows with null vectors, or of another length than the
    queries', are left out.
    """
    spark, kind, qkind = rows.sparkSession, dict(rows.dtypes)[key], dict(queries.dtypes)[key]
    asked = queries.where(F.size(embedding) > 0).select(F.col(key).alias("q"), F.col(embedding).cast("array<double>").alias("v"))
    one = asked.select(F.size("v")).first()
    if one is None:
        found = spark.createDataFrame([], f"query {qkind}, item {kind}, score double")
    else:
        path = new_dir(spark, "queries")
        asked.where(F.size("v") == one[0]).write.option("maxRecordsPerFile", QUERY_BLOCK).parquet(path)
        schema = pa.schema([("query", to_arrow_type(queries.schema[key].dataType)), ("item", to_arrow_type(rows.schema[key].dataType)), ("score", pa.float64())])
        usable = rows.where(F.size(embedding) == one[0]).select(key, F.col(embedding).cast("array<double>"))
        found = usable.mapInArrow(_scan(path, k, bar, schema), f"query {qkind}, item {kind}, score double")
    if k is None:
        return found
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "item")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _cut(df: pd.DataFrame, k: int) -> pd.DataFrame:
    return df.sort_values(["query", "score", "item"], ascending=[True, False, True]).groupby("query", sort=False).head(k)


def by_chain(hits: DataFrame, chain: str = "chain", key: str = "id", edge_counts: DataFrame | None = None, max_chains: int = 8, bonus: float = 0.05) -> DataFrame:
    """Hits grouped by chain: `score` (sum of scores, plus bonus per counted edge), `best_score`, `best`, `n_hits`; the best chains.

    `edge_counts` has the chain and `n_edges`.
    """
    g = hits.groupBy(chain).agg(F.sum("score").alias("score"), F.max("score").alias("best_score"), F.min_by(key, F.struct(-F.col("score"), F.col(key))).alias("best"), F.count(F.lit(1)).alias("n_hits"))
    if edge_counts is not None:
        g = g.join(edge_counts, chain, "left").withColumn("score", F.col("score") + bonus * F.coalesce("n_edges", F.lit(0))).drop("n_edges")
    return g.orderBy(F.col("score").desc(), chain).limit(max_chains)


def blend_scores(candidates: DataFrame, vector: str, chain_score: str, top10: str) -> DataFrame:
    """Candidates with `hybrid`: 0.55 vector + 0.20 chain score by its greatest + 0.15 for the ten best hits."""
    most = candidates.agg(F.max(F.coalesce(F.col(chain_score), F.lit(0.0))).alias("_most"))  # one row
    norm = F.when(F.col("_most") > 0, F.coalesce(F.col(chain_score), F.lit(0.0)) / F.col("_most")).otherwise(F.lit(0.0))
    scored = candidates.crossJoin(F.broadcast(most)).withColumn("hybrid", 0.55 * F.coalesce(F.col(vector), F.lit(0.0)) + 0.20 * norm + 0.15 * F.col(top10).cast("int"))
    return scored.drop("_most")


def with_reserve(main: DataFrame, reserve: DataFrame, k: int, reserved: int, key: str = "id", score: str = "score") -> DataFrame:
    """k rows: k - reserved from `main`, `reserved` from `reserve` that main has not, and what is left from main. Adds `source`."""
    m = main.orderBy(F.col(score).desc(), key).limit(k).withColumn("_r", F.row_number().over(Window.orderBy(F.col(score).desc(), key)))
    r = reserve.orderBy(F.col(score).desc(), key).limit(k + reserved).join(m.where(F.col("_r") <= k - reserved).select(key), key, "left_anti")
    r = r.orderBy(F.col(score).desc(), key).limit(reserved)
    first = m.where(F.col("_r") <= k - reserved).select(key, score, F.lit(0).alias("_p"), F.lit("vector").alias("source"))
    second = r.select(key, score, F.lit(1).alias("_p"), F.lit("reserve").alias("source"))
    fill = m.where(F.col("_r") > k - reserved).select(key, score, F.lit(2).alias("_p"), F.lit("backfill").alias("source"))
    both = first.unionByName(second).unionByName(fill)
    once = both.groupBy(key).agg(F.min(F.struct("_p", F.col(score).alias("s"), "source")).alias("x")).select(key, F.col("x.s").alias(score), "x.source", "x._p")
    return once.orderBy("_p", F.col(score).desc(), key).limit(k).drop("_p")


def neighbours_of(hits: DataFrame, pairs: DataFrame, key: str = "id", parents: int = 5, most: int = 3, weight: float = 0.5, fade: float = 0.95) -> DataFrame:
    """Nodes next to the best hits in the web and not among the hits: `id`, `score` = the smaller of fade * parent score and weight * w.

    `pairs` has a, b, w. The greatest score per node counts; the `most` best are kept.
    """
    top = hits.orderBy(F.col("score").desc(), key).limit(parents).select(F.col(key).alias("parent"), "score")
    both = pairs.select(F.col("a").alias("parent"), F.col("b").alias("id"), "w").unionByName(pairs.select(F.col("b").alias("parent"), F.col("a").alias("id"), "w"))
    near = both.join(F.broadcast(top), "parent").join(broadcast_if_small(hits.select(F.col(key).alias("id"))), "id", "left_anti")
    scored = near.groupBy("id").agg(F.max(F.least(fade * F.col("score"), weight * F.col("w"))).alias("score"))
    return scored.orderBy(F.col("score").desc(), "id").limit(most)


def bridge(inverted: DataFrame, entities: Sequence[str] | DataFrame, most: int = 8) -> DataFrame:
    """Nodes that share entities with a question: `id`, `score` = sum of 1 / document frequency, `n_shared`. `inverted` has entity, id; the
    question's entities are a list or a table with `entity`."""
    if isinstance(entities, DataFrame):
        wanted = inverted.join(broadcast_if_small(entities.select("entity").distinct()), "entity", "left_semi").distinct()
    else:
        wanted = inverted.where(F.col("entity").isin(list(entities))).distinct()
    df = wanted.groupBy("entity").agg(F.count(F.lit(1)).alias("df"))
    shared = wanted.join(broadcast_if_small(df), "entity").groupBy("id").agg(F.sum(1 / F.col("df")).alias("score"), F.count(F.lit(1)).alias("n_shared"))
    return shared.orderBy(F.round("score", 9).desc(), "id").limit(most)


def novelty(best: DataFrame, bar: float = 0.85) -> DataFrame:
    """Decision per query from its nearest row (`query`, `item`, `score`): merge into it at the bar or above, else store as new."""
    return best.withColumn("decision", F.when(F.col("score") >= bar, "merge_into").otherwise("store_new"))


def distinctiveness(pool: DataFrame, key: str, seconds: str, sharpness: float = 1.0) -> DataFrame:
    """1 / sum over the pool of exp(-c * |difference of log times|), differences cut at log(1000): `key`, `distinct`.

    The pool is a ranked candidate list (a handful of chains). 0 for rows without a positive time, and for all when fewer than
    two times are usable or they are all equal.
    """
    p = pool.withColumn("_l", F.when(F.col(seconds) > 0, F.log(F.col(seconds).cast("double"))))
    logs = p.agg(F.collect_list("_l").alias("_all"))
    usable = (F.size("_all") >= 2) & (F.array_max("_all") - F.array_min("_all") >= 1e-9)
    total = F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.exp(-sharpness * F.least(F.abs(F.col("_l") - x), F.lit(float(np.log(1000.0))))))
    return p.crossJoin(F.broadcast(logs)).select(key, F.when(usable & F.col("_l").isNotNull(), 1 / total).otherwise(F.lit(0.0)).alias("distinct"))


def envelope(pool: DataFrame, base: str, gains: dict[str, float], match: str | None = None, match_gain: float = 0.0) -> DataFrame:
    """Base score (plus gain * context match) times 1 + the weighted sum of signals, each scaled to 0..1 over the pool: `enveloped`.

    A signal of weight 0 is not computed.
    """
    used = {name: g for name, g in gains.items() if abs(g) >= 1e-9}
    matched = match if match and abs(match_gain) >= 1e-9 else None
    ends = [f(c).alias(f"_{side}_{c}") for c in dict.fromkeys([*used, *([matched] if matched else [])]) for side, f in (("low", F.min), ("high", F.max))]
    wide = pool.crossJoin(F.broadcast(pool.agg(*ends))) if ends else pool  # one row of extremes

    def scaled(c: str) -> Column:
        low, high = F.col(f"_low_{c}"), F.col(f"_high_{c}")
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.0))

    factor = F.lit(1.0)
    for name, g in used.items():
        factor = factor + g * scaled(name)
    start = F.col(base) + (match_gain * scaled(matched) if matched else F.lit(0.0))
    return wide.withColumn("enveloped", start * factor).select(*pool.columns, "enveloped")


#: Time constants of the context bank, log-spaced from a quarter of an hour to two months (fixed values).
CONTEXT_TAUS = (900.0, 7200.0, 43200.0, 259200.0, 1209600.0, 5184000.0)


def context_bank(events: DataFrame, key: str, at: str, embedding: str, dim: int, taus: Sequence[float] = CONTEXT_TAUS) -> DataFrame:
    """Drifting context per key: for each time constant t <- rho t + sqrt(1 - rho^2) q, scaled to length 1: the key and `bank` (taus x dim).

    Events (epoch seconds in `at`) are folded in order of time; those of one moment are averaged first. The fold of a key
    streams through its sorted events, so a key of any length needs one state only.
    """
    kind = dict(events.dtypes)[key]
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull() & (F.size(embedding) == dim)).select(F.col(key).alias("k"), F.col(at).cast("double").alias("t"), F.col(embedding).cast("array<double>").alias("q"))
    tau = np.array(taus)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}

        def close(s: dict) -> None:
            q = s["sum"] / np.linalg.norm(s["sum"]) if np.linalg.norm(s["sum"]) > 0 else s["sum"]
            rho = np.zeros(len(tau)) if s["last"] is None else np.exp(-max(0.0, s["t"] - s["last"]) / tau)
            b = rho[:, None] * s["bank"] + np.sqrt(np.maximum(0.0, 1 - rho**2))[:, None] * q[None, :]
            n = np.linalg.norm(b, axis=1, keepdims=True)
            s["bank"] = np.divide(b, n, out=b.copy(), where=n > 0)
            s["last"] = s["t"]

        def emit(s: dict) -> pd.DataFrame:
            close(s)
            return pd.DataFrame({key: [s["k"]], "bank": [s["bank"].tolist()]})

        for p in parts:
            for k, t, q in zip(p["k"], p["t"], p["q"], strict=True):
                v = np.asarray(q, np.float64)
                n = np.linalg.norm(v)
                v = v / n if n > 0 else v
                if state and state["k"] == k:
                    if state["t"] == t:
                        state["sum"] = state["sum"] + v
                        continue
                    close(state)
                    state |= {"t": t, "sum": v}
                else:
                    if state:
                        yield emit(state)
                    state = {"k": k, "t": t, "sum": v, "last": None, "bank": np.zeros((len(tau), dim))}
        if state:
            yield emit(state)

    return rows.repartition("k").sortWithinPartitions("k", "t").mapInPandas(fold, f"{key} {kind}, bank array<array<double>>")


def context_match(bank: Column, vector: str) -> Column:
    """Mean cosine of a vector with the rows of a bank."""
    return F.aggregate(F.transform(bank, lambda b: V.cosine(b, vector)), F.lit(0.0), lambda s, x: s + x) / F.size(bank)
