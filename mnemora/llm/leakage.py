"""Held-out passages that occur in a corpus, by q-gram filtering in overlapping diagonal bands and banded alignment.

Both sides are words (runs of a-z and 0-9) joined by single blanks. A leak is a run of `min_words` consecutive
words of an item that a document holds with at most `max_edits` character edits. Such a run of w characters
shares at least w - q + 1 - max_edits * q q-grams with the item, all on max_edits + 1 neighbouring diagonals
(document position less item position). Hits are counted in overlapping bands of diagonals; a stretch of
one band that reaches the bound for the item's shortest run is kept, and every run of words in it is verified
by alignment within the band. The bound is met by each true leak, so nothing is lost.

The corpus is scanned once, whatever the number of items. A task asks a bitmap of the items' q-grams (FILTER_BITS bits, read from
the shared folder) which of a document's q-grams may occur in an item at all, and passes on the zones around those that
do: their text and the q-grams. Zones meet the items' q-grams in a join, so neither items nor an index of them go to the driver, and
all that follows the scan grows with what leaked, not with the corpus.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.neardup import normal_words
from mnemora.runtime import broadcast_if_small, materialize, new_dir

#: Bits of the bitmap: 4 MB, however many items there are; with more q-grams than bits it lets more through and loses none.
FILTER_BITS = 25
#: Characters of documents handled at once.
PIECE = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_ITEM = pa.schema([("item_key", pa.int64()), ("p", pa.string()), ("need", pa.int32()), ("grams", pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int32())])))])
_ITEM_SQL = "item_key bigint, p string, need int, grams array<struct<gram:bigint,pos:int>>"


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams of a byte array, built by doubling."""
    level, width = chars.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB), 1
    out, done = None, 0
    while True:
        if q & width:
            if out is None:
                out, done = level, width
            else:
                m = len(chars) - done - width + 1
                if m <= 0:
                    return np.empty(0, np.uint64)
                out = out[:m] * np.uint64(pow(_BASE, width, 2**64)) + level[done : done + m]
                done += width
        if done == q:
            out = out[: max(0, len(chars) - q + 1)]
            return out ^ (out >> np.uint64(29))
        m = len(chars) - 2 * width + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        level = level[:m] * np.uint64(pow(_BASE, width, 2**64)) + level[width : width + m]
        width *= 2


def aligned(a: bytes, b: bytes, shift: int, limit: int) -> tuple[int, int]:
    """Least edits that turn the whole of `a` into some stretch of `b`, on diagonals shift - limit .. shift + limit, and where it ends.

    limit + 1 if more are needed. Position i of `a` may meet b[i + d] for each diagonal d of the band. A diagonal that needs no edit is
    recognised as a whole, whole words in `b` first.
    """
    n, inside = len(a), None
    for d in range(max(0, shift - limit), shift + limit + 1):
        if b[d : d + n] == a:
            if _edge(b, d - 1) and _edge(b, d + n):
                return 0, d + n
            inside = d + n
    if inside is not None:
        return 0, inside
    width, big = 2 * limit + 1, limit + 1
    row = [0 if 0 <= shift - limit + j <= len(b) else big for j in range(width)]
    for i in range(1, n + 1):
        new, left = [big] * width, big
        for j in range(width):
            p = i + shift - limit + j  # characters of b used
            if not 0 <= p <= len(b):
                left = big
                continue
            best = row[j] + (0 if p > 0 and b[p - 1] == a[i - 1] else 1) if p > 0 else big
            if j + 1 < width and row[j + 1] + 1 < best:
                best = row[j + 1] + 1
            if left + 1 < best:
                best = left + 1
            new[j] = left = min(best, big)
        row = new
        if min(row) > limit:
            return big, 0
    least = min(row)
    return least, n + shift - limit + row.index(least)


def _edge(text: bytes, p: int) -> bool:
    return p < 0 or p >= len(text) or text[p] == 32


def _bounds(text: str, min_words: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Starts and ends of the words, characters of the shortest and of the longest run of `min_words` (0 if there is none)."""
    words = text.split(" ")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(words) < min_words:
        return starts, ends, 0, 0
    runs = ends[min_words - 1 :] - starts[: len(words) - min_words + 1]
    return starts, ends, int(runs.min()), int(runs.max())


def _item_rows(q: int, min_words: int, max_edits: int):
    """q-grams of items and what counting them needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = _bounds(text, min_words)[2]
                h = gram_hashes(np.frombuffer(text.encode(), np.uint8), q).view(np.int64).tolist()
                out.append({"item_key": key, "p": text, "need": max(1, w - q + 1 - max_edits * q), "grams": [{"gram": g, "pos": i} for i, g in enumerate(h)]})
            yield pa.RecordBatch.from_pylist(out, schema=_ITEM)

    return run


def _bitmap(size: int):
    """Bits of the q-grams of one partition, as rows of (word, bits) for the words that are not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (size - 3), np.uint8)
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - size)
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        words = bits.view(np.int64)
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(words[full], pa.int64())], names=["word", "bits"])

    return run


def _read_bitmap(path: str, size: int) -> np.ndarray:
    """The bitmap from the shared folder, through the file system its address names."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    system, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    words = np.zeros(1 << (size - 6), np.int64)
    for f in system.get_file_info(fs.FileSelector(inside)):
        if f.base_name.endswith(".parquet"):
            t = pq.read_table(f.path, filesystem=system)
            words[t["word"].to_numpy()] = t["bits"].to_numpy()
    return words.view(np.uint8)


def _zones(path: str, filter_bits: int, q: int, longest: int, least: int, max_edits: int, out: pa.Schema):
    """Stretches of documents whose q-grams may be an item's: id, begin, text, and (q-gram, position in the document)."""
    gap = longest + 2 * max_edits + q  # hits of one run are never further apart
    pad = longest + 4 * max_edits + q + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for b in batches:
            if bits is None:
                bits = _read_bitmap(path, filter_bits)
            texts = b.column(1).cast(pa.string())
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PIECE)))
                yield from part(bits, b.column(0), [t.encode() for t in texts.slice(lo, hi - lo).to_pylist()], lo)
                lo = hi

    def part(bits: np.ndarray, ids: pa.Array, docs: list[bytes], first: int) -> Iterator[pa.RecordBatch]:
        buffer = np.frombuffer(b"\n".join(docs), np.uint8)
        begin = np.cumsum([0] + [len(d) + 1 for d in docs])
        at, grams = [], []
        for off in range(0, max(1, len(buffer)), 4 * PIECE):  # a document longer than a piece goes in pieces that overlap by a q-gram
            h = gram_hashes(buffer[off : off + 4 * PIECE + q - 1], q)
            top = h >> np.uint64(64 - filter_bits)
            seen = np.flatnonzero((bits[top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8)) & 1)
            at.append(seen + off)
            grams.append(h[seen].view(np.int64))
        at, grams = np.concatenate(at), np.concatenate(grams)
        if not len(at):
            return
        # of a run, some `least` hits lie within least - 1 + max_edits * (q + 1): its q-grams without those an edit touches
        near = np.zeros(len(at), bool)
        if len(at) >= least:
            near[: len(at) - least + 1] = at[least - 1 :] - at[: len(at) - least + 1] <= least - 1 + max_edits * (q + 1)
        ahead = np.cumsum(np.r_[near, np.zeros(least, bool)])
        dense = ahead[: len(at)] - np.r_[np.zeros(least, np.int64), ahead][: len(at)] > 0
        at, grams = at[dense], grams[dense]
        if not len(at):
            return
        owner = np.searchsorted(begin, at, side="right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > gap)
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(at))
        kept = np.flatnonzero(end - start >= least)
        rows: dict[str, list] = {"i": [], "begin": [], "zone": [], "hits": []}
        for s, e in zip(start[kept].tolist(), end[kept].tolist(), strict=True):
            o = int(owner[s])
            base = int(begin[o])
            a, z = max(0, int(at[s]) - base - pad), int(at[e - 1]) - base + q + pad
            rows["i"].append(first + o)
            rows["begin"].append(a)
            rows["zone"].append(docs[o][a:z].decode())
            rows["hits"].append([{"gram": g, "at": p - base} for g, p in zip(grams[s:e].tolist(), at[s:e].tolist(), strict=True)])
        if rows["i"]:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows["i"], pa.int64())), *(pa.array(rows[c], out.field(c).type) for c in ("begin", "zone", "hits"))], schema=out)

    return run


def verify(text: str, zone: bytes, found: list[tuple[int, int, int]], q: int, min_words: int, max_edits: int) -> tuple[int, int] | None:
    """Words and edits of the best leaked run at the regions (positions within the zone); None if no run is within the edits."""
    starts, ends, _, longest = _bounds(text, min_words)
    whole, best = text.encode(), None
    reach = 2 * max_edits + 1
    for middle, lo, hi in found:
        a, b = lo - middle - reach - longest, hi - middle + q + reach + longest
        for i in range(max(0, bisect_left(starts, a)), len(starts) - min_words + 1):
            s, e = int(starts[i]), int(ends[i + min_words - 1])
            if e > b:
                break
            d, stop = aligned(whole[s:e], zone, s + middle, reach)
            if d == 0 and not (_edge(zone, stop) and _edge(zone, stop - (e - s) - 1)):
                d = 1  # a blank is missing
            if d <= max_edits and (best is None or d < best[1]):
                k = i + min_words
                while k < len(starts) and zone[stop : stop + 1 + int(ends[k] - starts[k])] == whole[int(starts[k]) - 1 : int(ends[k])] and _edge(zone, stop + 1 + int(ends[k] - starts[k])):
                    stop += 1 + int(ends[k] - starts[k])
                    k += 1
                best = (k - i, d)
                if d == 0:
                    return best
    return best


def _verified(q: int, min_words: int, max_edits: int, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at_row, words, edits = [], [], []
            for r in range(b.num_rows):
                stretches = [(x["middle"], x["lo"], x["hi"]) for x in b.column("regions")[r].as_py()]
                got = verify(b.column("p")[r].as_py(), b.column("zone")[r].as_py().encode(), stretches, q, min_words, max_edits)
                if got:
                    at_row.append(r)
                    words.append(got[0])
                    edits.append(got[1])
            if at_row:
                i = pa.array(at_row, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(i), b.column("item_key").take(i), pa.array(words, pa.int32()), pa.array(edits, pa.int32())], schema=out)

    return run


def leaks(
    documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, min_words: int = 12, max_edits: int = 0
) -> DataFrame:
    """Documents that hold a run of `min_words` words of an item: `doc_id`, `item_id`, `n_words`, `edits`.

    `edits` are the fewest of any run, `n_words` the words of that run and of its unedited continuation. One row per (document id,
    item id). Null texts and ids and items shorter than `min_words` give no rows; repeated rows count once, an id with several texts
    is affected by each. Empty tables give no rows. Ids may be of any type Arrow has and are never hashed.
    """
    spark = documents.sparkSession
    kinds = {"d": dict(documents.dtypes)[doc_id], "i": dict(items.dtypes)[item_id]}
    none = spark.createDataFrame([], f"`{doc_id}` {kinds['d']}, `{item_id}` {kinds['i']}, n_words int, edits int")
    named = items.select(F.col(item_id).alias("i"), normal_words(passage).alias("p")).where("i is not null")
    words = F.split("p", " ")
    named = materialize(named.distinct().where(F.size(words) >= min_words).withColumn("item_key", F.monotonically_increasing_id()), "items")
    # characters of the shortest and longest run of any item: one row
    sizes = F.transform(words, F.length)
    run = F.transform(F.sequence(F.lit(0), F.size(words) - min_words), lambda i: F.aggregate(F.slice(sizes, i + 1, min_words), F.lit(min_words - 1), lambda s, x: s + x))
    least, longest = named.select(run.alias("r")).agg(F.min(F.array_min("r")), F.max(F.array_max("r"))).first()
    if least is None:
        return none
    # the longest q that leaves a bound of a quarter of the shortest run, or 1 at least
    q = max(1, (least + 1 - max(1, least // 4)) // (max_edits + 1))
    index = materialize(named.select("item_key", "p").mapInArrow(_item_rows(q, min_words, max_edits), _ITEM_SQL), "item-grams")
    fewest = index.agg(F.min("need")).first()[0]
    path = new_dir(spark, "bitmap")
    grams = index.select(F.explode("grams").alias("g"), "item_key").select("g.gram", "g.pos", "item_key")
    parts = grams.select("gram").mapInArrow(_bitmap(FILTER_BITS), "word int, bits bigint")
    parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).coalesce(1).write.parquet(path)
    docs = documents.select(F.col(doc_id).alias("d"), normal_words(text).alias("t")).where("d is not null and t <> ''")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["d"].dataType)
    hit = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int64())]))
    shape = pa.schema([("d", kind), ("begin", pa.int64()), ("zone", pa.string()), ("hits", hit)])
    zones = docs.mapInArrow(_zones(path, FILTER_BITS, q, longest, fewest, max_edits, shape), f"d {kinds['d']}, begin bigint, zone string, hits array<struct<gram:bigint,at:bigint>>")
    zones = materialize(zones.withColumn("z", F.monotonically_increasing_id()), "zones")
    # hits per diagonal band of max_edits + 1, then bands of twice that width at every one of them: any max_edits + 1 neighbours lie in one
    width = max_edits + 1
    met = zones.select("z", "begin", F.explode("hits").alias("h")).select("z", (F.col("h.at") - F.col("begin")).alias("at"), "h.gram").join(broadcast_if_small(materialize(grams, "grams")), "gram")
    met = met.groupBy("z", "item_key", F.expr(f"cast(floor((at - pos) / {width}) as bigint)").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    bands = met.withColumn("band", F.explode(F.array(F.col("low") - 1, "low"))).groupBy("z", "item_key", "band").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    bands = bands.join(broadcast_if_small(index.select("item_key", "need")), "item_key").where("n >= need")
    kept = materialize(bands.select("z", "item_key", (F.col("band") * width + width).alias("middle"), "lo", "hi"), "regions")
    # a document and an item share no more regions than there are bands between their ends
    near = kept.groupBy("z", "item_key").agg(F.collect_list(F.struct("middle", "lo", "hi")).alias("regions"))
    pairs = near.join(broadcast_if_small(index.select("item_key", "p")), "item_key").join(zones.select("z", "d", "zone"), "z")
    shape = pa.schema([("d", kind), ("item_key", pa.int64()), ("n_words", pa.int32()), ("edits", pa.int32())])
    found = pairs.select("d", "item_key", "zone", "p", "regions").mapInArrow(_verified(q, min_words, max_edits, shape), f"d {kinds['d']}, item_key bigint, n_words int, edits int")
    found = found.join(broadcast_if_small(named.select("item_key", "i")), "item_key")
    best = found.groupBy("d", "i").agg(F.min(F.struct("edits", (-F.col("n_words")).alias("w"))).alias("b"))
    return best.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), (-F.col("b.w")).cast("int").alias("n_words"), F.col("b.edits").alias("edits"))
