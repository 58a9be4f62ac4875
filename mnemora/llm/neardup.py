"""Near-duplicate texts by anchor points of a covering code.

A text is the set of its runs of `k` consecutive words. A fingerprint is a word of `n` MinHash symbols over
the field Z_p, p = 2^31 - 1; two texts agree in a symbol with the probability of their similarity. The
anchors are the codewords of the parity-check code (symbols sum to 0), whose covering radius is 1: every
fingerprint has a codeword within distance 1 for each coordinate that is corrected. The threshold is one
differing symbol. In general a fingerprint has to go to every anchor within radius plus threshold, here 2; over p
symbols those are about n * p / 2 anchors, so that can't be done. It needn't: two fingerprints that differ in one
coordinate have a codeword within distance 1 of both, namely the one that corrects that coordinate, so the `n` anchors
within the radius already bring every such pair together (the README gives figures for codes over bits). Pairs at one anchor are compared on 192-bit sketches, then verified exactly on the sets.

One table of fingerprints finds a pair of similarity s with probability s^n + n s^(n-1) (1-s). As many tables
are used as leave a pair exactly at the threshold unfound with probability `miss` at most; more similar pairs
are missed far less often. Texts with the same words are one representative, so copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.operators.graph import connected_components
from mnemora.runtime import broadcast_if_small, materialize

P = np.uint64(2**31 - 1)
WORDS = 3  # 64-bit words of a sketch
#: Fingerprints compared in one group; an anchor with more is dealt into cells.
CELL = 1_000
_SCHEMA = "row bigint, key binary, n int, s0 bigint, s1 bigint, s2 bigint, anchors array<bigint>, shingles array<bigint>"
_ARROW = pa.schema(
    [("row", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("s0", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("anchors", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))]
)


@dataclass(frozen=True)
class Covering:
    """Parameters of the covering for one similarity threshold."""

    threshold: float
    n: int
    tables: int
    far: int  # greatest sketch distance that is still verified

    @classmethod
    def of(cls, threshold: float, miss: float = 1e-4) -> Covering:
        """Fewest anchors for a false-candidate rate at similarity 0.02 of 1e-3 or less per pair of texts."""
        best = None
        for n in range(2, 17):
            meet = lambda s: s**n + n * s ** (n - 1) * (1 - s)  # noqa: B023, E731
            tables = math.ceil(math.log(miss) / math.log(1 - meet(threshold)))
            if tables * meet(0.02) <= 1e-3 and (best is None or tables * n < best[0]):
                best = (tables * n, n, tables)
        bits = 64 * WORDS
        differ = (1 - threshold) / 2
        return cls(threshold, best[1], best[2], math.floor(bits * differ + 4.5 * math.sqrt(bits * differ * (1 - differ))))


def normal_words(text: str | Column) -> Column:
    """Lower case, runs of a-z and 0-9 separated by single blanks; empty for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingle_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in order of (text, hash), and each one's text number."""
    import xxhash

    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten().dictionary_encode()
    vocabulary = np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    h = vocabulary[flat.indices.to_numpy(zero_copy_only=False)] if len(vocabulary) else np.empty(0, np.uint64)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    s = np.zeros(m, np.uint64)
    for i in range(k):
        s = _mix(s + h[i : i + m] + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1)))
    whole = owner[:m] == owner[k - 1 :]
    s, owner = s[whole], owner[:m][whole]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], owner[new]


def _fingerprints(k: int, cov: Covering, part_words: int = 400_000):
    """From (key, words) to sketch, anchors and shingle set; texts without a shingle are left out."""
    count = max(cov.n * cov.tables, 64 * WORDS)
    rng = np.random.default_rng(20240607)
    mult = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, count, dtype=np.uint64)
    weights = rng.integers(0, 2**63, (cov.tables, cov.n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seeds = rng.integers(0, 2**63, (1, cov.tables, 1), dtype=np.uint64)

    def part(key: pa.Array, texts: pa.Array, number: int) -> pa.RecordBatch | None:
        s, owner = _shingle_hashes(texts, k)
        if not len(s):
            return None
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        who = owner[start]
        sym = np.empty((len(who), count), np.uint64)
        for j in range(count):
            sym[:, j] = np.minimum.reduceat(s * mult[j] + add[j], start)
        sym = _mix(sym)
        bits = (sym[:, : 64 * WORDS] >> np.uint64(40)) & np.uint64(1)
        sketch = [(bits[:, 64 * i : 64 * i + 64] << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64) for i in range(WORDS)]
        x = (sym[:, : cov.n * cov.tables] % P).reshape(len(who), cov.tables, cov.n)
        syndrome = x.sum(2, dtype=np.uint64, keepdims=True) % P
        fixed = (x + P - syndrome) % P  # the symbol that makes the sum 0, for each coordinate
        base = (x * weights).sum(2, dtype=np.uint64, keepdims=True)
        anchors = _mix(_mix(base + weights * (fixed - x)) + seeds).view(np.int64).reshape(len(who), -1)
        n = np.diff(np.append(start, len(s)))
        lists = lambda flat, sizes: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(number + np.arange(len(who)), pa.int64()), key.take(pa.array(who)), pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in sketch),
                lists(anchors.ravel(), np.full(len(who), anchors.shape[1])), lists(s.view(np.int64), n),
            ],
            schema=_ARROW,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36  # a number for each text, short in place of its key; stored with the sketches
        for b in batches:
            key, texts = b.column(0).cast(pa.binary()), b.column(1).cast(pa.string())
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) // 6 + 64)
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + part_words)))
                if (out := part(key.slice(lo, hi - lo), texts.slice(lo, hi - lo), number)) is not None:
                    number += out.num_rows
                    yield out
                lo = hi

    return run


@dataclass
class NearDuplicates:
    """Result of a search. members: id, key of its text (null without a shingle). links: pairs of keys of different texts, with similarity."""

    members: DataFrame
    links: DataFrame

    def pairs(self, a: str = "id_a", b: str = "id_b") -> DataFrame:
        """All pairs of different ids, id_a < id_b, with similarity: linked texts, and ids that share a text."""
        m = self.members
        left, right = m.select(F.col("id").alias("x"), F.col("key").alias("key_a")), m.select(F.col("id").alias("y"), F.col("key").alias("key_b"))
        linked = self.links.join(left, "key_a").join(right, "key_b").where("x <> y").select("x", "y", "similarity")
        same = left.join(right, (F.col("key_a") == F.col("key_b")) & (F.col("x") < F.col("y"))).select("x", "y", F.lit(1.0).alias("similarity"))
        both = linked.unionByName(same)
        return both.select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b), "similarity").dropDuplicates([a, b])

    def classes(self) -> DataFrame:
        """One row per id: `class_id` (the least id of all that are linked, directly or through others), `n_links` (linked other texts)."""
        alone = self.members.where("key is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
        members = self.members.where("key is not null")
        reps = members.groupBy("key").agg(F.min("id").alias("rep"))
        ends = self.links.select(F.col("key_a").alias("key"), F.col("key_b").alias("other")).unionByName(self.links.select(F.col("key_b").alias("key"), F.col("key_a").alias("other")))
        degree = ends.groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
        edges = self.links.select(F.hex("key_a").alias("src"), F.hex("key_b").alias("dst"))
        comp = connected_components(edges).select(F.unhex("node").alias("key"), F.unhex("component").alias("comp"))
        labelled = reps.join(comp, "key", "left").join(degree, "key", "left").select("key", "rep", F.coalesce("comp", "key").alias("comp"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
        label = labelled.groupBy("comp").agg(F.min("rep").alias("class_id"))
        labels = labelled.select("key", "comp", "n_links").join(label, "comp").drop("comp")
        return members.join(labels, "key").select("id", "class_id", "n_links").unionByName(alone)


def _meet(sketches: DataFrame, cov: Covering) -> DataFrame:
    """Pairs of rows (`row_a` < `row_b`) that share an anchor and whose sketches are near.

    Anchors of one fingerprint, by far the most, are left out by a count that is combined before the shuffle. The fingerprints of
    an anchor are dealt into cells of about CELL; each pair of cells is a group of its own, so the
    comparisons of a hot anchor spread over as many tasks as it needs, and none is left out.
    """
    at = sketches.select("row", "n", "s0", "s1", "s2", F.explode("anchors").alias("anchor"))
    shared = materialize(at.groupBy("anchor").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("anchor", F.ceil(F.col("held") / CELL).cast("int").alias("cells")), "anchors")
    at = at.join(broadcast_if_small(shared), "anchor").withColumn("cell", F.pmod(F.xxhash64("row"), F.col("cells")).cast("int"))
    rest = ("row", "n", "s0", "s1", "s2")
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other")
    spread = at.select("anchor", "cell", other, *rest).select("anchor", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"), "cell", *rest)
    a, b = (spread.select("anchor", "low", "high", *(F.col(c).alias(f"{c}_{s}") for c in ("cell", *rest))) for s in "ab")
    distance = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(1, WORDS)), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
    sizes = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * cov.threshold
    # in a group of two cells only pairs across them: those inside a cell meet in its own group
    across = (F.col("low") == F.col("high")) | (F.col("cell_a") != F.col("cell_b"))
    met = a.hint("merge").join(b, ["anchor", "low", "high"]).where((F.col("row_a") < F.col("row_b")) & across & sizes & (distance <= cov.far))
    return met.select("row_a", "row_b").distinct()


def near_duplicates(texts: DataFrame, id_column: str, text: str, k: int = 5, threshold: float = 0.8, miss: float = 1e-4) -> NearDuplicates:
    """Texts whose shingle sets have Jaccard similarity >= threshold.

    Rows with a null id are left out; a null text and one of fewer than `k` words has no shingle and is similar to
    nothing (a class of its own). A row that occurs again changes nothing; an id with two texts belongs to both. Empty tables give empty results. Other columns are not read.
    """
    cov = Covering.of(threshold, miss)
    rows = texts.select(F.col(id_column).alias("id"), normal_words(text).alias("words")).where("id is not null")
    enough = (F.length("words") > 0) & (F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) >= k - 1)
    rows = materialize(rows.select("id", "words", F.when(enough, F.unhex(F.md5("words"))).alias("key")), "texts")  # read twice
    reps = rows.where("key is not null").groupBy("key").agg(F.first("words").alias("words"))
    sketches = materialize(reps.mapInArrow(_fingerprints(k, cov), _SCHEMA), "sketches")
    candidates = _meet(sketches, cov)
    sets = sketches.select("row", "key", "n", "shingles")
    left, right = (sets.select(*(F.col(c).alias(f"{c}_{s}") for c in sets.columns)) for s in "ab")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    links = candidates.join(left, "row_a").join(right, "row_b").withColumn("i", both)
    links = links.withColumn("similarity", F.col("i") / (F.col("n_a") + F.col("n_b") - F.col("i"))).where(F.col("similarity") >= threshold)
    return NearDuplicates(rows.select("id", "key").distinct(), materialize(links.select("key_a", "key_b", "similarity"), "links"))
