"""The named queries of the retrieval and planning operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from placeloom.plans import build_queries, clean_queries, plan_queries, retrieve_queries, store_queries

_MODULES = (clean_queries, build_queries, retrieve_queries, plan_queries, store_queries)


def queries() -> dict[str, Callable]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
