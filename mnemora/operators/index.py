"""A vector index kept in a folder: built incrementally from texts, asked, and with tombstones."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import text as X
from mnemora.operators import dedup, retrieval
from mnemora.runtime import broadcast_if_small, new_dir, remove_path

_SCHEMA = "id string, sha string, embedding array<double>"


def hashed_embedding(dim: int = 384):
    """Pandas UDF: unit vectors of texts by feature hashing of words and word pairs; zero for null and empty texts. A model's UDF fits in its place."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for texts in parts:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                words = re.findall(r"\w+", t.lower()) if t else []
                for w in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                    h = xxhash.xxh3_64_intdigest(w)
                    out[i, h % dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.Series(list(np.divide(out, n, out=out, where=n > 0)))

    return F.pandas_udf(run, "array<double>")


@dataclass
class VectorIndex:
    """Versions of (id, sha of the text, embedding) below `path`, and ids that are not to be found. The last manifest names the version that counts."""

    spark: SparkSession
    path: str
    version: int = 0
    rows: int = 0
    dim: int = 0
    dead: tuple[int, ...] = ()

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None) -> VectorIndex:
        """The index of a folder as its last finished change left it; an empty one if there is none."""
        out = cls(spark, path or new_dir(spark, "index"))
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out.path}/manifest")
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            last = spark.read.text(f"{out.path}/manifest").orderBy(F.get_json_object("value", "$.serial").cast("bigint").desc()).first()[0]
            state = json.loads(last)
            out.version, out.rows, out.dim, out.dead = state["version"], state["rows"], state["dim"], tuple(state["dead"])
        return out

    def _commit(self) -> None:
        serial = self.version * 1_000_000 + len(self.dead)
        text = json.dumps({"serial": serial, "version": self.version, "rows": self.rows, "dim": self.dim, "dead": list(self.dead)})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/manifest")

    def vectors(self) -> DataFrame:
        """id, sha, embedding, tombstones included."""
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/v{self.version}") if self.version else self.spark.createDataFrame([], _SCHEMA)

    def tombstones(self) -> DataFrame:
        """Ids that are not to be found: of an id buried and raised, the last counts."""
        if not self.dead:
            return self.spark.createDataFrame([], "id string")
        all_ = self.spark.read.schema("id string, serial bigint, buried boolean").parquet(*(f"{self.path}/dead{n}" for n in self.dead))
        return all_.groupBy("id").agg(F.max_by("buried", "serial").alias("b")).where("b").select("id")

    def status(self, texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """What a build would do with every text: id, `action` (embed, drop, keep)."""
        now = texts.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
        return dedup.index_changes(now, self.vectors(), "id", "text")

    def build(self, texts: DataFrame, key: str = "id", text: str = "text", embed: Callable[[str], Column] | None = None) -> VectorIndex:
        """Bring the index up to the texts: only new and changed ones are embedded, vanished ones are dropped. Null ids are left out; an id's rows must be one."""
        embed = embed or hashed_embedding()
        now = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("now", X.short_hash("text"))
        old = self.vectors().withColumnsRenamed({"sha": "was", "embedding": "old"})
        both = now.join(old, "id", "left").withColumn("same", F.coalesce(F.col("now") == F.col("was"), F.lit(False)))
        kept = both.where("same").select("id", F.col("now").alias("sha"), F.col("old").alias("embedding"))
        new = both.where("not same").select("id", F.col("now").alias("sha"), embed("text").alias("embedding"))
        before, self.version = self.version, self.version + 1
        kept.unionByName(new).write.mode("overwrite").parquet(f"{self.path}/v{self.version}")
        self.rows, self.dim = self.vectors().agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
        self._commit()
        if before:
            remove_path(self.spark, f"{self.path}/v{before}")
        return self

    def info(self) -> dict:
        """Rows, dimension and version."""
        return {"rows": self.rows, "dim": self.dim, "version": self.version}

    def _mark(self, ids: DataFrame, buried: bool) -> VectorIndex:
        n = len(self.dead) + 1
        ids.select(F.col("id").cast("string").alias("id"), F.lit(n).cast("bigint").alias("serial"), F.lit(buried).alias("buried")).write.mode("overwrite").parquet(f"{self.path}/dead{n}")
        self.dead = (*self.dead, n)
        self._commit()
        return self

    def tombstone(self, ids: DataFrame) -> VectorIndex:
        """Hide ids; their vectors stay."""
        return self._mark(ids, True)

    def untombstone(self, ids: DataFrame) -> VectorIndex:
        """Show ids again."""
        return self._mark(ids, False)

    def top_k(self, vector: Sequence[float], k: int) -> DataFrame:
        """The k nearest that are not hidden: id, score."""
        rows = self.vectors()
        if self.dead:
            rows = rows.join(broadcast_if_small(self.tombstones()), "id", "left_anti")
        return retrieval.top_k(rows, vector, k).select("id", "score")
