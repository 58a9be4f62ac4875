"""Streams run to their end over the event tables, as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.runtime import new_dir
from mnemora.streaming import flows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _source(spark: SparkSession, sf: str) -> DataFrame:
    """Sittings as a file stream: id, workspace, at, nodes, source. Times in milliseconds count as such."""
    path = f"{sf}/sittings.parquet"
    schema = spark.read.parquet(path).schema
    file = spark.readStream.schema(schema).parquet(path if _is_dir(spark, path) else f"{sf}/sittings*.parquet")
    seconds = F.when(F.col("t") >= 1e11, F.col("t") / 1000).otherwise(F.col("t"))
    return file.where("t is not null").select(F.col("sitting_id").alias("id"), "workspace", F.timestamp_micros(F.round(seconds * 1e6).cast("bigint")).alias("at"), F.flatten("events").alias("nodes"), F.col("provenance").alias("source"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def stream_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pair tallies merged batch by batch into a table; a sitting delivered again counts once."""
    out = new_dir(spark, "stream-pairs")
    flows.merge_pairs(_source(spark, sf), f"{out}/table", f"{out}/checkpoint", "id").awaitTermination()
    return flows.pair_totals(spark, f"{out}/table")


def _drain(df: DataFrame, mode: str) -> DataFrame:
    spark = df.sparkSession
    out, name = new_dir(spark, "stream"), f"s{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{name}/n={number}")

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/{name}")


def stream_ring(spark: SparkSession, sf: str) -> DataFrame:
    """The latest nodes of every workspace."""
    rows = _drain(flows.ring(_source(spark, sf), 32), "update")
    return rows.groupBy("workspace").agg(F.max_by("nodes", "batch").alias("nodes"))


QUERIES |= {"stream_pairs": stream_pairs, "stream_ring": stream_ring}
SQL["stream_pairs"] = r"""with r as (select row_number() over () id, list_sort(list_distinct(list_transform(flatten(events), lambda x: regexp_replace(x, '\.md$', '')))) u from (select *, row_number() over (partition by sitting_id order by arrived_at) rn from sittings where t is not null) where (rn = 1 or sitting_id is null) and coalesce(provenance, 'genuine') <> 'replay'),
x as (select id, u, unnest(u) a, unnest(range(1, len(u) + 1)) i from r), p as (select a, unnest(u[i + 1:]) b from x) select a, b, count(*) n from p group by a, b"""
SQL["stream_ring"] = """with e as (select workspace, cast(round(case when t >= 1e11 then t / 1000 else t end * 1e6) as bigint) us, unnest(flatten(events)) node from sittings where t is not null and workspace is not null),
m as (select workspace, node, max(us) us from e where node is not null group by 1, 2), r as (select *, row_number() over (partition by workspace order by us desc, node) k from m)
select workspace, list(node order by k) nodes from r where k <= 32 group by workspace"""
