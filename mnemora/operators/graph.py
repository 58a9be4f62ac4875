"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.runtime import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Component of every node that has an edge: `node`, `component` (its least node).

    Alternating large-star and small-star steps: each hooks neighbours to the least one known. The number of
    rounds grows with the logarithm of the component size, and a round shuffles each edge twice. Self edges and
    edges with a null end are left out; repeated edges change nothing.
    """
    start = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    current = materialize(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        current = materialize(small, "cc")
        # the rewritten edges stand still when every component is a star around its least node
        stamp = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if stamp == before:
            break
        before = stamp
    return current.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def both_ways(pairs: DataFrame, a: str = "a", b: str = "b", value: str = "w") -> DataFrame:
    """Directed rows (`src`, `dst`, the value) of undirected pairs."""
    return pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"), value).unionByName(pairs.select(F.col(b).alias("src"), F.col(a).alias("dst"), value))


def degrees(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs per node: `node`, `degree`."""
    return pairs.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def row_normalized(edges: DataFrame, value: str = "w") -> DataFrame:
    """Share of each edge in its source's sum: `src`, `dst`, `p`. Sources whose sum is not positive are left out.

    The sums are aggregated and joined back, so that a source with any number of edges is spread over tasks.
    """
    sums = edges.groupBy("src").agg(F.sum(value).alias("_s")).where("_s > 0")
    return edges.join(sums, "src").select("src", "dst", (F.col(value) / F.col("_s")).alias("p"))


def forward_kernel(directed: DataFrame, symmetric: DataFrame, value: str = "n", weight: str = "w") -> DataFrame:
    """Rows of the directed counts where a source has any, else of the symmetric weights, normalised per source."""
    own = row_normalized(directed, value)
    rest = row_normalized(symmetric, weight).join(own.select("src").distinct(), "src", "left_anti").select("src", "dst", "p")
    return own.unionByName(rest)


def seeds(active: DataFrame, node: str = "node", score: str = "score") -> DataFrame:
    """Start distribution: positive scores normalised, or all equal when none is positive: `node`, `p`."""
    a = active.groupBy(F.col(node).alias("node")).agg(F.greatest(F.max(score), F.lit(0.0)).alias("s"))
    total = a.agg(F.sum("s").alias("t"), F.count(F.lit(1)).alias("c"))
    return a.crossJoin(F.broadcast(total)).select("node", F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(1 / F.col("c")).alias("p"))


def discounted_walk(kernel: DataFrame, start: DataFrame, discount: float = 0.5, steps: int = 3) -> DataFrame:
    """Sum over t = 0..steps of discount^t times the distribution after t steps: `node`, `need`. Each step is one join and one aggregation."""
    now, out = start.select("node", "p"), start.select("node", F.col("p").alias("need"))
    for t in range(1, steps + 1):
        now = now.withColumnRenamed("p", "_m").join(kernel, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("_m") * F.col("p")).alias("p")).withColumnRenamed("dst", "node")
        out = out.unionByName(now.select("node", (F.col("p") * discount**t).alias("need")))
    return out.groupBy("node").agg(F.sum("need").alias("need"))


def reachable(edges: DataFrame, start: DataFrame, depth: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """Nodes reached forwards within `depth` steps: keys, `node`, `depth` (the least; 0 for the start).

    `start` has the keys and `node`; edges have the keys, `src`, `dst`. Each step joins the newest frontier only.
    """
    k = list(keys)
    seen = start.select(*k, "node", F.lit(0).alias("depth")).distinct()
    frontier, e = seen, edges.select(*k, "src", "dst").distinct()
    for d in range(1, depth + 1):
        step = frontier.select(*k, F.col("node").alias("src")).join(e, [*k, "src"]).select(*k, F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select(*k, "node"), [*k, "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def degree_cap(pairs: DataFrame, cap: int = 32) -> DataFrame:
    """Pairs (a, b, w) among the `cap` heaviest at both ends; equal weights go by a, then b, descending.

    A rank within a node's pairs is only needed up to the cap: per salted part the cap heaviest are kept first, so that no
    task ranks all pairs of a hot node.
    """
    from pyspark.sql import Window

    order = (F.col("w").desc_nulls_last(), F.col("a").desc(), F.col("b").desc())
    ends = pairs.select("a", "b", "w", F.explode(F.array("a", "b")).alias("node"))
    salted = ends.withColumn("_s", F.pmod(F.xxhash64("a", "b"), F.lit(32)))
    near = salted.withColumn("_r", F.row_number().over(Window.partitionBy("node", "_s").orderBy(*order))).where(F.col("_r") <= cap)
    kept = near.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(*order))).where(F.col("_r") <= cap)
    return kept.groupBy("a", "b").agg(F.first("w").alias("w"), F.count(F.lit(1)).alias("_n")).where("_n = 2").drop("_n")


def scale_down(pairs: DataFrame, limit: float = 4.0) -> DataFrame:
    """Weights scaled so that no node's sum exceeds the limit: each pair by the smaller scale of its ends. Adds `scaled`."""
    sums = pairs.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("s"))
    scale = sums.select("node", F.when(F.col("s") > limit, limit / F.col("s")).otherwise(F.lit(1.0)).alias("f"))
    a, b = scale.withColumnsRenamed({"node": "a", "f": "_fa"}), scale.withColumnsRenamed({"node": "b", "f": "_fb"})
    return pairs.join(a, "a").join(b, "b").withColumn("scaled", F.col("w") * F.least("_fa", "_fb")).drop("_fa", "_fb")


def live_edges(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges both of whose ends exist (`nodes.id`)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", src), src, "left_semi").join(ids.withColumnRenamed("id", dst), dst, "left_semi").select(*edges.columns)


def ghost_edges(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with an end that does not exist, with `missing` (src, dst or both)."""
    ids = nodes.select("id").distinct()
    a, b = (ids.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}")) for c in (src, dst))
    both = edges.join(a, src, "left").join(b, dst, "left")
    lost = F.when(F.col(f"_{src}").isNull() & F.col(f"_{dst}").isNull(), "both").when(F.col(f"_{src}").isNull(), "src").when(F.col(f"_{dst}").isNull(), "dst")
    return both.withColumn("missing", lost).where("missing is not null").select(*edges.columns, "missing")


def incident(edges: DataFrame, focus: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges that touch a focus node (`id`)."""
    ids = focus.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", src), src, "left_semi").select(*edges.columns)
    right = edges.join(ids.withColumnRenamed("id", dst), dst, "left_semi").join(ids.withColumnRenamed("id", src), src, "left_anti").select(*edges.columns)
    return left.unionByName(right)


def transition_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that are new or gone: all columns and `change` (added, dropped)."""
    return after.exceptAll(before).withColumn("change", F.lit("added")).unionByName(before.exceptAll(after).withColumn("change", F.lit("dropped")))
