"""Items that appear together: an incremental pair table with association scores.

The state is four hash-bucketed tables in a folder: the baskets as seen, counts of pairs, marginals of items, and the scores
last worked out. A change is a basket's new content (or its removal). Against the stored basket it
becomes signed deltas: minus the old pairs and marginals, plus the new. Deltas are summed and appended to the buckets they
touch; versions of a bucket are merged from time to time; scores are worked out again for the pairs affected.

A basket's weight counts for each of its pairs and items. score = factor * n_ab * N / (n_a * n_b), with
N the sum of all weights.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.runtime import broadcast_if_small, materialize, new_dir, plan_bytes, remove_path, shuffle_partitions

#: Bytes of changes a bucket is meant for, when a table is made, and bounds of the number of buckets.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 256 << 20, 16, 4096
#: Versions of a bucket that are merged into one.
COMPACT = 8
#: Baskets with more items are cut into blocks of this many; each pair of blocks is a row of its own.
BLOCK = 256

_BASKETS = "key string, items array<string>, weight bigint, version bigint, applied bigint"
_PAIRS = "node_a string, node_b string, n_ab bigint"
_ITEMS = "node string, n bigint"
_SCORED = "node_a string, node_b string, n_ab bigint, n_a bigint, n_b bigint"


def clean_items(items: str | Column) -> Column:
    """Sorted distinct items without nulls; null for null."""
    c = F.col(items) if isinstance(items, str) else items
    return F.array_sort(F.array_distinct(F.array_compact(c)))


def _pairs_of(left: Column, right: Column, same: Column) -> Column:
    """Pairs of two sorted blocks; within one block, each with those behind it."""
    return F.flatten(
        F.transform(left, lambda a, i: F.transform(F.when(same, F.slice(left, i + 2, BLOCK)).otherwise(right), lambda b: F.struct(a.alias("node_a"), b.alias("node_b"))))
    )


def signed_pairs(baskets: DataFrame) -> DataFrame:
    """Summed pair deltas of (items, weight): node_a < node_b, n_ab.

    A basket of any size is spread: beyond BLOCK items, its pairs of blocks go out as separate rows to separate tasks.
    """
    few = baskets.where(F.size("items").between(2, BLOCK))
    small = few.select("weight", F.posexplode("items").alias("i", "node_a"), "items").select("weight", "node_a", F.explode(F.slice("items", F.col("i") + 2, BLOCK)).alias("node_b"))
    many = baskets.where(F.size("items") > BLOCK)
    n = F.ceil(F.size("items") / BLOCK).cast("int")
    block = lambda i: F.slice("items", i * BLOCK + 1, BLOCK)
    wide = (
        many.select("weight", "items", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), n.alias("n"))
        .select("weight", "items", "i", F.explode(F.sequence(F.col("i"), F.col("n") - 1)).alias("j"))
        .select("weight", block(F.col("i")).alias("l"), block(F.col("j")).alias("r"), (F.col("i") == F.col("j")).alias("same"))
        .repartition(shuffle_partitions(baskets.sparkSession), F.rand(7))
        .select("weight", F.explode(_pairs_of(F.col("l"), F.col("r"), F.col("same"))).alias("p"))
        .select("weight", "p.node_a", "p.node_b")
    )
    both = small.select("weight", "node_a", "node_b").unionByName(wide)
    return both.groupBy("node_a", "node_b").agg(F.sum("weight").alias("n_ab")).where("n_ab <> 0")


def signed_items(baskets: DataFrame) -> DataFrame:
    """Summed marginal deltas: node, n."""
    return baskets.select("weight", F.explode("items").alias("node")).groupBy("node").agg(F.sum("weight").alias("n")).where("n <> 0")


class PairTable:
    """Persistent counts under `path`. Every change appends signed deltas to the buckets it touches and nowhere else; counts are sums over a
    bucket's versions, and COMPACT versions of a table are merged into one.

    A version counts once its manifest is written: what a lost driver left of an unfinished change is written over by the next.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path or new_dir(spark, "pairs"), buckets
        #: per table: bucket -> the versions that hold parts of it
        self.where: dict[str, dict[int, list[int]]] = {"baskets": {}, "pairs": {}, "items": {}, "scored": {}}
        self.version, self.total, self.least = 0, 0, 0
        self._changed: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PairTable:
        """The table as its last finished change left it."""
        state = json.loads(spark.read.text(f"{path}/manifest").orderBy(F.get_json_object("value", "$.version").cast("bigint").desc()).first()[0])
        out = cls(spark, path, state["buckets"])
        out.version, out.total, out.least = state["version"], state["total"], state["least"]
        out.where = {t: {int(b): v for b, v in w.items()} for t, w in state["where"].items()}
        return out

    def _commit(self) -> None:
        text = json.dumps({"version": self.version, "total": self.total, "buckets": self.buckets, "least": self.least, "where": self.where})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/manifest")

    def _read(self, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{table}/v{v}/bucket={b}" for b, vs in self.where[table].items() for v in vs if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _bucket(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, df: DataFrame, keys: tuple[str, ...], instead: list[int] | None = None) -> None:
        """Append df's buckets as this version; those of `instead` lose their earlier versions."""
        folder = f"{self.path}/{table}/v{self.version}"
        # a bucket is cut into slices of the key's hash; a task writes whole slices, so there are as many files as slices
        slices = -(-shuffle_partitions(self.spark) // self.buckets)
        piece = F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(slices))
        df.withColumn("bucket", self._bucket(*keys)).repartition(self.buckets * slices, "bucket", piece).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        for b in instead or ():
            self.where[table].pop(b, None)
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(folder)
        for f in root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root):
            name = f.getPath().getName()
            if name.startswith("bucket="):
                self.where[table].setdefault(int(name[7:]), []).append(self.version)

    def _drop_unused(self, before: set[tuple[str, int]]) -> None:
        """Remove the folders that no bucket names any more."""
        for table, v in before - {(t, v) for t, w in self.where.items() for vs in w.values() for v in vs}:
            remove_path(self.spark, f"{self.path}/{table}/v{v}")

    def _add(self, table: str, schema: str, delta: DataFrame, keys: tuple[str, ...], count: str) -> None:
        """Append deltas; merge all versions where there have come to be COMPACT of them."""
        if max(map(len, self.where[table].values()), default=0) + 1 < COMPACT:
            self._write(table, delta, keys)
            return
        merged = self._read(table, schema).unionByName(delta).groupBy(*keys).agg(F.sum(count).alias(count)).where(f"{count} <> 0")
        self._write(table, merged, keys, list(self.where[table]))

    def apply(self, changes: DataFrame) -> PairTable:
        """Take in changed baskets: columns `key`, `items`, `weight`, `version`.

        Of a key, the highest version counts, in this batch and against the store; an equal or lower one than
        the stored changes nothing. Null items remove the basket; null weight is 1; a null version is lowest;
        rows with a null key are left out. An item listed twice counts once, null items not at all.
        """
        if self.buckets is None:
            self.buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-plan_bytes(changes) // BUCKET_BYTES)))
        used = {(t, v) for t, w in self.where.items() for vs in w.values() for v in vs}
        self.version += 1
        new = (
            changes.where("key is not null")
            .select(F.col("key").cast("string").alias("key"), F.struct(F.coalesce("version", F.lit(-(2**62))).cast("bigint").alias("version"), F.coalesce("weight", F.lit(1)).cast("bigint").alias("weight"), clean_items("items").alias("items")).alias("x"))
            .groupBy("key").agg(F.max("x").alias("x")).select("key", "x.items", "x.weight", "x.version")
        )
        applied = F.lit(self.version).cast("bigint").alias("applied")
        # the store keeps what every change brought of a basket; the last is the one that counts, and a removed one may come back at any version
        if self.where["baskets"]:
            new = materialize(new, "batch")
            touched = [r[0] for r in new.select(self._bucket("key").alias("b")).distinct().collect()]  # never more values than buckets
            stored = self._read("baskets", _BASKETS, touched).groupBy("key").agg(F.max(F.struct("applied", "version", "weight", "items")).alias("old"))
            both = new.join(stored, "key", "left").where(F.col("old.items").isNull() & F.col("items").isNotNull() | (F.col("version") > F.col("old.version")))
            changed = f"{self.path}/changes/v{self.version}"
            both.select("key", "items", "weight", "version", "old").write.mode("overwrite").parquet(changed)
            moved = self.spark.read.parquet(changed)
            rows = moved.select("key", "items", "weight", "version", applied)
            if max(map(len, self.where["baskets"].values()), default=0) + 1 < COMPACT:
                self._write("baskets", rows, ("key",))
            else:
                last = self._read("baskets", _BASKETS).unionByName(rows).groupBy("key").agg(F.max(F.struct("applied", "version", "weight", "items")).alias("x"))
                self._write("baskets", last.select("key", "x.items", "x.weight", "x.version", "x.applied").where("items is not null"), ("key",), list(self.where["baskets"]))
            minus = moved.where("old.items is not null").select("old.items", (-F.col("old.weight")).alias("weight"))
            signed = minus.unionByName(moved.where("items is not null").select("items", "weight"))
        else:
            self._write("baskets", new.where("items is not null").select("key", "items", "weight", "version", applied), ("key",))
            signed = self._read("baskets", _BASKETS).where("items is not null").select("items", "weight")
        self._add("pairs", _PAIRS, signed_pairs(signed), ("node_a", "node_b"), "n_ab")
        self._add("items", _ITEMS, signed_items(signed), ("node",), "n")
        self.total += signed.agg(F.sum("weight")).first()[0] or 0
        nodes = signed.select(F.explode("items").alias("node"))
        self._changed = nodes if self._changed is None else self._changed.unionByName(nodes)
        self._commit()
        self._drop_unused(used)
        return self

    def refresh(self, min_count: int = 1) -> PairTable:
        """Bring the stored scores of pairs counted `min_count` times or more up to date: only pairs with an item of a basket changed since
        the last time are worked out again. Stored are the three counts, so that the total, which every change moves, enters on reading."""
        used = {(t, v) for t, w in self.where.items() for vs in w.values() for v in vs}
        whole = self._changed is None or min_count != self.least or not self.where["scored"]
        self.version += 1
        self.least = min_count
        if whole:
            scored = self._joined(min_count)
        else:
            hit = materialize(self._changed.distinct(), "changed")
            ends = [broadcast_if_small(hit.withColumnRenamed("node", c)) for c in ("node_a", "node_b")]
            kept = self._read("scored", _SCORED).join(ends[0], "node_a", "left_anti").join(ends[1], "node_b", "left_anti")
            scored = kept.unionByName(self._joined(min_count, hit))
        self._write("scored", scored, ("node_a", "node_b"), list(self.where["scored"]))
        self._changed = None
        self._commit()
        self._drop_unused(used)
        return self

    def pairs(self) -> DataFrame:
        """node_a, node_b, n_ab."""
        return self._summed("pairs", _PAIRS, ("node_a", "node_b"), "n_ab")

    def items(self) -> DataFrame:
        """node, n."""
        return self._summed("items", _ITEMS, ("node",), "n")

    def _summed(self, table: str, schema: str, keys: tuple[str, ...], count: str) -> DataFrame:
        """Sums over versions; buckets of a single version hold them already and go without a shuffle."""
        single, several = ([b for b, vs in self.where[table].items() if (len(vs) > 1) == more] for more in (False, True))
        summed = self._read(table, schema, several).groupBy(*keys).agg(F.sum(count).alias(count)).where(f"{count} <> 0")
        if not several:
            return self._read(table, schema, single)
        return self._read(table, schema, single).unionByName(summed) if single else summed

    def _joined(self, min_count: int, affected: DataFrame | None = None) -> DataFrame:
        """Pairs with their items' counts: node_a, node_b, n_ab, n_a, n_b. A pair can't count more often than either item, so rarer items are
        left out before the joins; each item is one row of its side, so a hot one only lengthens the side of pairs, which may be split."""
        items = materialize(self.items().where(F.col("n") >= min_count), "item-counts")
        pairs = self.pairs().where(F.col("n_ab") >= min_count)
        if affected is not None:
            hit = broadcast_if_small(affected.select("node").distinct().withColumn("hit", F.lit(True)))
            for c in ("node_a", "node_b"):
                pairs = pairs.join(hit.withColumnsRenamed({"node": c, "hit": f"hit_{c}"}), c, "left")
            pairs = pairs.where("hit_node_a or hit_node_b").select("node_a", "node_b", "n_ab")
        for c, n in (("node_a", "n_a"), ("node_b", "n_b")):
            pairs = pairs.join(broadcast_if_small(items.withColumnsRenamed({"node": c, "n": n})), c)
        return pairs.select("node_a", "node_b", "n_ab", "n_a", "n_b")

    def scores(self, min_count: int = 1, factor: int = 1, min_score: float = 0.0, affected: DataFrame | None = None) -> DataFrame:
        """Scores of pairs: node_a, node_b, n_ab, n_a, n_b, n_total, score; read from the stored ones where refresh() has made them for this
        count and nothing changed since, else worked out. `affected` (column `node`) restricts to pairs with such an item. Bounds are exact."""
        fresh = self.where["scored"] and self._changed is None and self.least <= min_count and affected is None
        out = self._read("scored", _SCORED).where(F.col("n_ab") >= min_count) if fresh else self._joined(min_count, affected)
        out = out.withColumn("n_total", F.lit(self.total).cast("bigint"))
        wide = "decimal(38,0)"
        score = (F.lit(float(factor)) * F.col("n_ab") * F.col("n_total")) / (F.col("n_a").cast("double") * F.col("n_b"))
        out = out.withColumn("score", score)
        if min_score > 0:
            whole = float(min_score).is_integer()
            exact = (F.lit(factor).cast("decimal(9,0)") * F.col("n_ab").cast("decimal(14,0)") * F.col("n_total").cast("decimal(14,0)")).cast(wide) >= (
                F.lit(int(min_score)).cast("decimal(9,0)") * F.col("n_a").cast("decimal(14,0)") * F.col("n_b").cast("decimal(14,0)")
            ).cast(wide)
            out = out.where(exact if whole else F.col("score") >= min_score)
        return out.select("node_a", "node_b", "n_ab", "n_a", "n_b", "n_total", "score")
