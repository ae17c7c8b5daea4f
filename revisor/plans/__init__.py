"""Queries of the library over the given tables, with their SQL."""

from __future__ import annotations


def queries() -> dict:
    from revisor.plans import compare_queries, cost_queries, graph_queries, source_queries, vintage_queries  # noqa: F401
    from revisor.plans.registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from revisor.plans.registry import SQL

    queries()
    return dict(SQL)
