"""All registered queries of the engine: each has a callable (spark, sf_dir) -> DataFrame and, where SQL can say it, its SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict[str, str] = {}
_MODULES = ["events", "sets", "texts", "effects", "models"]


def query(name: str, sql: str | None = None):
    """Register a query; sql is its DuckDB form."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"threadloom.plans.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
