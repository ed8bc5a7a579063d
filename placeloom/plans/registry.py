"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """Two tables and a decorator that enters a function under its (or another) name, with its oracle's SQL if it has one."""
    found: dict[str, Callable] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None, name: str | None = None):
        def enter(f: Callable) -> Callable:
            found[name or f.__name__] = f
            if sql:
                oracles[name or f.__name__] = sql
            return f

        return enter

    return found, oracles, query
