"""Registration of queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); ``sql`` computes the same rows over the same tables."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
