"""Streams over co-activation events: pair tallies, sessions, a recency ring and unmatched calls.

Events carry `workspace`, `at` (timestamp), `nodes` (array) and `source`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemora.operators.coactivation import pairs


def pair_counts(events: DataFrame, late: str = "3 days", window: str = "1 day") -> DataFrame:
    """Pair tallies per day with a watermark: `window`, a, b, n. The pair explosion is map-side; state is one counter per pair and day."""
    clean = F.array_sort(F.array_distinct(F.transform("nodes", lambda n: F.regexp_replace(n, r"\.md$", ""))))
    genuine = events.where("coalesce(source, 'genuine') <> 'replay'").withWatermark("at", late).select("at", clean.alias("nodes"))
    return pairs(genuine, "nodes").groupBy(F.window("at", window), "a", "b").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "3 days") -> DataFrame:
    """Sessions per workspace: start, end (of the last event), number of events. An event exactly `gap` behind the last one still belongs."""
    w = F.session_window("at", gap)
    out = events.where("workspace is not null").withWatermark("at", late).groupBy("workspace", w.alias("w")).agg(F.min("at").alias("start_at"), F.max("at").alias("end_at"), F.count(F.lit(1)).alias("n"))
    return out.select("workspace", "start_at", "end_at", "n")


def merge_pairs(query_source: DataFrame, table_dir: str, checkpoint: str, key: str | None = None) -> StreamingQuery:
    """Each micro-batch's tallies appended as one run below `table_dir`, named by the batch, so that a batch that is done again
    replaces its own run. `pair_totals` reads the sum.

    With a `key`, a record delivered again counts once, however late: keys seen are kept beside the runs, by batch as well. Records
    without a key all count.
    """
    seen_dir = f"{table_dir}-seen"

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if key:
            batch = batch.persist()
            known = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(seen_dir)
            if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
                earlier = spark.read.parquet(seen_dir).where(F.col("batch") != number).select(key)
                known = known.join(earlier, key, "left_anti").select(*batch.columns)
            batch.where(F.col(key).isNotNull()).select(key).distinct().write.mode("overwrite").parquet(f"{seen_dir}/batch={number}")
            fresh = known.unionByName(batch.where(F.col(key).isNull()))
        else:
            fresh = batch
        clean = F.array_sort(F.array_distinct(F.transform("nodes", lambda n: F.regexp_replace(n, r"\.md$", ""))))
        counted = pairs(fresh.where("coalesce(source, 'genuine') <> 'replay'").select(clean.alias("nodes")), "nodes").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{table_dir}/batch={number}")
        if key:
            batch.unpersist()

    return query_source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pair_totals(spark, table_dir: str) -> DataFrame:
    """Sum of all runs: a, b, n."""
    return spark.read.parquet(table_dir).groupBy("a", "b").agg(F.sum("n").alias("n"))


def ring(events: DataFrame, size: int = 256) -> DataFrame:
    """Bounded recency set per workspace, updated with every micro-batch: the nodes seen last, newest first.

    State is at most `size` (node, time) entries a workspace. Output: workspace, `nodes`.
    """
    rows = events.where("workspace is not null").select("workspace", F.col("at"), F.explode("nodes").alias("node"))

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for p in parts:
            for n, t in zip(p["node"], p["at"].astype("int64"), strict=True):
                if n is not None and held.get(n, -1) < t:
                    held[n] = int(t)
            if len(held) > 8 * size:
                held = dict(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:size])
        best = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:size]
        state.update(([n for n, _ in best], [t for _, t in best]))
        yield pd.DataFrame({"workspace": [key[0]], "nodes": [[n for n, _ in best]]})

    return rows.groupBy("workspace").applyInPandasWithState(update, "workspace string, nodes array<string>", "nodes array<string>, times array<bigint>", "update", "NoTimeout")


def pairing(calls: DataFrame, results: DataFrame, key: str, wait: str = "1 hour") -> DataFrame:
    """Calls joined to their results within a time limit; calls whose time is up come with nulls. Both streams have the key and `at`."""
    c = calls.select(F.col(key).alias("call_key"), F.col("at").alias("call_at")).withWatermark("call_at", wait)
    r = results.select(F.col(key).alias("result_key"), F.col("at").alias("result_at")).withWatermark("result_at", wait)
    return c.join(r, F.expr(f"call_key = result_key and result_at between call_at and call_at + interval {wait}"), "left_outer")
