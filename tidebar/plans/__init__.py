"""Queries over the tables, each with its SQL; ``QUERIES`` and ``SQL`` hold them by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

_MODULES = ("indicators", "pointintime", "markets", "flows", "extras", "accounts", "landed", "streams", "laws")


def query(name: str, sql: str | None = None):
    """Registers a query function (spark, sf_dir) and the SQL that gives the same rows."""

    def keep(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return keep


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    for module in _MODULES:
        importlib.import_module(f"tidebar.plans.{module}")
    return QUERIES, SQL
