"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from tessera.plans import graph_queries, text_queries, vector_queries

_MODULES = (vector_queries, graph_queries, text_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLES.items()}
