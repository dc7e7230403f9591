"""Queries for the operators of the library, over the tables that stand in for reads.

A query's name begins with the operator's; each module of ``MODULES`` registers its own.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("scalar_queries", "aggregate_queries", "order_queries", "join_queries", "graph_queries", "kernel_queries", "source_queries")

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with the SQL that gives the same rows if there is any."""

    def keep(f: Callable) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    for m in MODULES:
        import_module(f"longweave.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
