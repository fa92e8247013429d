"""Registered queries of the general operators, each with its SQL for DuckDB."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Add a query function, and the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


MODULES = [f"operators.{m}" for m in ("aggregates", "quantiles", "ordered", "projections", "joins", "intervals", "recursion", "windows", "sorting", "sets")]
MODULES += ["functions.scalars", "functions.sketches", "functions.udfs", "sources.formats", "sources.merge", "sources.jdbc", "sources.connector", "streaming.streams", "streaming.stateful"]
for module in MODULES:
    importlib.import_module(f"millrace.{module}")
