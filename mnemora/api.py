"""The store as one object: tables in, DataFrames out, and a registry of named operations.

`MemoryStore` holds no data of its own. Reads are DataFrames; changes return a new store over the changed tables, which
`save` writes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import temporal, text
from mnemora.operators import chains, dedup, graph, lifecycle, packing, retrieval, state

_OPERATIONS: dict[str, Callable] = {}


def operation(name: str) -> Callable:
    """Register a function under a name; the last registration of a name counts."""

    def add(function: Callable) -> Callable:
        _OPERATIONS[name] = function
        return function

    return add


def run(name: str, *args, **kwargs):
    """Call a registered operation."""
    if name not in _OPERATIONS:
        raise KeyError(f"no operation {name!r}; known: {', '.join(sorted(_OPERATIONS))}")
    return _OPERATIONS[name](*args, **kwargs)


def operations() -> list[str]:
    """Names of all operations."""
    return sorted(_OPERATIONS)


@dataclass(frozen=True)
class MemoryStore:
    """nodes (id and header columns, body, chains), edges (chain edges), web (a, b, w, n), vectors (id, embedding), archive."""

    nodes: DataFrame
    edges: DataFrame
    web: DataFrame
    vectors: DataFrame | None = None
    archive: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MemoryStore:
        """A store as `save` wrote it."""
        read = lambda t: spark.read.parquet(f"{path}/{t}.parquet")
        return cls(read("nodes"), read("edges"), read("web"), read("vectors"), read("archive"))

    def save(self, path: str) -> None:
        """Write all tables below a folder that does not exist yet (a version); tables that are missing are written empty."""
        spark = self.nodes.sparkSession
        vectors = self.vectors if self.vectors is not None else spark.createDataFrame([], "id string, embedding array<double>")
        archive = self.archive if self.archive is not None else self.nodes.limit(0).withColumn("reason", F.lit(""))
        for name, df in (("nodes", self.nodes), ("edges", self.edges), ("web", self.web), ("vectors", vectors), ("archive", archive)):
            df.write.parquet(f"{path}/{name}.parquet")

    def members(self) -> DataFrame:
        """chain, pos, node from the nodes' own lists of chains, in order of id."""
        from pyspark.sql import Window

        m = self.nodes.select(F.col("id").alias("node"), F.explode("chains").alias("chain"))
        return m.withColumn("pos", F.row_number().over(Window.partitionBy("chain").orderBy("node")) - 1)

    @operation("read_node")
    def read_node(self, node: str) -> DataFrame:
        """One node."""
        return self.nodes.where(F.col("id") == node)

    @operation("temporal_query")
    def temporal_query(self, at: str | None = None, since: str | None = None, between: tuple[str, str] | None = None, vector: Sequence[float] | None = None, k: int = 10) -> DataFrame:
        """Nodes by validity. With a vector the max(4k, 16) nearest are cut first and the time filters apply to them."""
        rows = self.nodes
        if vector is not None:
            near = retrieval.top_k(self.vectors, vector, max(4 * k, 16)).select("id", "score")
            rows = rows.join(F.broadcast(near), "id")
        if at:
            rows = rows.where(temporal.holds_at(at, F.col("valid_from"), F.col("valid_to")))
        if since:
            rows = rows.where(temporal.holds_since(since, F.col("valid_to")))
        if between:
            rows = rows.where(temporal.overlaps(*between, F.col("valid_from"), F.col("valid_to")))
        order = (F.col("score").desc(), "id") if vector is not None else ("id",)
        return rows.orderBy(*order).limit(k)

    @operation("search")
    def search(self, vector: Sequence[float], k: int = 8, term: str | None = None, neighbours: bool = False, runtime: str | None = None) -> DataFrame:
        """Hits of a term first, then the nearest vectors by type-weighted score, cut at k; web neighbours come beyond the cut.

        Columns: id, score, source. `runtime` keeps nodes of one runtime (null counts as main).
        """
        live = self.nodes if runtime is None else self.nodes.where(F.coalesce("runtime", F.lit("main")) == runtime)
        near = retrieval.top_k(self.vectors, vector, 2 * k).select("id", "score")
        weight = F.when(F.lower("type").isin("fact", "decision"), 1.2).when(F.lower("type") == "episode", 0.8).otherwise(1.0)
        hits = live.join(F.broadcast(near), "id").select("id", (F.col("score") * weight).alias("score"), F.lit("vector").alias("source"), F.lit(1).alias("_p"))
        if term:
            t = F.lit(term.lower())
            found = live.where(F.contains(F.lower("id"), t) | F.contains(F.lower(F.concat_ws(" ", "name", "body")), t))
            found = found.select("id", F.when(F.contains(F.lower("id"), t), 1.0).otherwise(0.85).alias("score"), F.lit("term").alias("source"), F.lit(0).alias("_p")).orderBy(F.col("score").desc(), "id").limit(5)
            hits = found.unionByName(hits.join(F.broadcast(found.select("id")), "id", "left_anti"))
        best = hits.orderBy("_p", F.col("score").desc(), "id").limit(k).drop("_p")
        if not neighbours:
            return best
        return best.unionByName(retrieval.neighbours_of(best, self.web).withColumn("source", F.lit("neighbour")))

    @operation("retrieve")
    def retrieve(self, vector: Sequence[float], budget: int = 2000, hits: int = 24, max_chains: int = 8) -> DataFrame:
        """Members of the best chains, packed first-fit under a token budget: chain, node, tokens, taken.

        Chains by the sum of their hits; members in order; a node of several chains counts in its best one.
        """
        from pyspark.sql import Window

        members = self.members()
        first = members.groupBy("node").agg(F.min("chain").alias("chain"))
        near = retrieval.top_k(self.vectors, vector, hits).select("id", "score")
        inside = first.join(F.broadcast(near.withColumnRenamed("id", "node")), "node").withColumnRenamed("node", "id")
        best = retrieval.by_chain(inside, max_chains=max_chains)
        best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "chain")))
        listed = members.join(F.broadcast(best.select("chain", "rank")), "chain")
        once = listed.groupBy("node").agg(F.min(F.struct("rank", "pos", "chain")).alias("x")).select("node", "x.*")
        sized = once.join(self.nodes.select(F.col("id").alias("node"), text.token_estimate(F.concat_ws("\n\n", "description", "body")).alias("tokens")), "node")
        return packing.first_fit(sized.withColumn("_g", F.lit(1)), ["_g"], ["rank", "pos", "node"], "tokens", budget).select("chain", "node", "tokens", "taken")

    @operation("chain_at")
    def chain_at(self, chain: str, at: str) -> DataFrame:
        """Members of a chain on a day."""
        return chains.members_at(self.members().where(F.col("chain") == chain).select("chain", "node"), self.edges.where(F.col("chain") == chain), at)

    @operation("traverse")
    def traverse(self, chain: str, start: str, at: str, depth: int = 3) -> DataFrame:
        """Nodes reached forwards over edges valid on a day."""
        e = chains.valid_edges(self.edges.where(F.col("chain") == chain), at)
        return graph.reachable(e, self.nodes.sparkSession.createDataFrame([(start,)], "node string"), depth)

    @operation("snapshot")
    def snapshot(self, at: str) -> DataFrame:
        """Valid and all edges per chain on a day."""
        return chains.snapshot(self.edges, at)

    @operation("duplicates")
    def duplicates(self, bar: float = 0.15) -> DataFrame:
        """Similar nodes inside chains."""
        return dedup.similar_pairs(self.nodes.select("id", "body", F.explode("chains").alias("chain")), "chain", "id", "body", bar)

    @operation("ingest")
    def ingest(self, rows: DataFrame, vectors: DataFrame | None = None) -> MemoryStore:
        """Nodes written over those of the same id; vectors likewise."""
        old = self.nodes.join(rows.select("id"), "id", "left_anti")
        out = replace(self, nodes=old.unionByName(rows, allowMissingColumns=True).select(*self.nodes.columns))
        if vectors is None:
            return out
        return replace(out, vectors=vectors if self.vectors is None else self.vectors.join(vectors.select("id"), "id", "left_anti").unionByName(vectors))

    @operation("forget")
    def forget(self, ids: DataFrame, reason: str = "forgotten") -> MemoryStore:
        """Nodes out of every table and into the archive."""
        web = self.web.withColumnsRenamed({"a": "src", "b": "dst"})
        f = lifecycle.forget(self.nodes, self.edges, web, ids, self.vectors, reason)
        kept = f.archive if self.archive is None else self.archive.unionByName(f.archive, allowMissingColumns=True)
        return MemoryStore(f.nodes, f.chain_edges, f.web_edges.withColumnsRenamed({"src": "a", "dst": "b"}), f.vectors, kept)

    @operation("restore")
    def restore(self, ids: DataFrame) -> MemoryStore:
        """Archived nodes back."""
        return self if self.archive is None else replace(self, nodes=lifecycle.restore(self.nodes, self.archive, ids))

    @operation("supersede")
    def supersede(self, pairs: DataFrame, on: str) -> MemoryStore:
        """Nodes of `old_id` closed on a day."""
        return replace(self, nodes=lifecycle.supersede(self.nodes, pairs, on).select(*self.nodes.columns))

    @operation("decay")
    def decay(self, today: str, now: float) -> MemoryStore:
        """One decay pass: new relevance and tier; newly frozen nodes go to the archive as well."""
        d = lifecycle.decay_pass(self.nodes, today, now)
        new = d.select("id", F.col("new_relevance").alias("relevance"), F.col("new_tier").alias("tier"))
        nodes = state.upsert(self.nodes, new, ["id"], {"relevance": F.col("new.relevance"), "tier": F.col("new.tier")})
        rows = self.nodes.join(d.where("action = 'archive'").select("id"), "id", "left_semi").withColumn("reason", F.lit("frozen"))
        return replace(self, nodes=nodes, archive=rows if self.archive is None else self.archive.unionByName(rows, allowMissingColumns=True))
