"""All registered queries and their SQL."""

from __future__ import annotations

from mnemora.plans import graph_queries, more_queries, node_queries, pass_queries, problems, recall_queries, store_queries, stream_queries, vector_queries

_MODULES = (problems, node_queries, vector_queries, graph_queries, store_queries, stream_queries, pass_queries, recall_queries, more_queries)
FLAGSHIP = vector_queries.q_chain_retrieve


def queries() -> dict:
    """Name to callable (spark, directory)."""
    return {name: q for module in _MODULES for name, q in module.QUERIES.items()}


def sql() -> dict[str, str]:
    """Name to SQL text."""
    return {name: s for module in _MODULES for name, s in module.SQL.items()}
