"""All queries outside the llm subpackage."""

from __future__ import annotations

from graphloom.plans import context_queries, graph_queries, links, model_queries, resolve_queries, search_queries, source_queries

REGISTRIES = (graph_queries.R, search_queries.R, resolve_queries.R, source_queries.R, context_queries.R, model_queries.R)


def queries() -> dict:
    return links.queries() | {k: v for r in REGISTRIES for k, v in r.functions.items()}


def oracle_sql() -> dict[str, str]:
    return links.oracle_sql() | {k: v for r in REGISTRIES for k, v in r.sql.items()}
