"""The queries of the graph engine by name, and the DuckDB SQL that checks them."""

from __future__ import annotations

from .queries import dynamic, extended, prepared, relational, structural


def _modules() -> list:
    return [relational, structural, prepared, extended, dynamic]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
