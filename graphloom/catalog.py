"""All queries of the engine by name, with their SQL equivalents."""

from __future__ import annotations

from graphloom.queries import derived, files, graphs, outputs, reads, rules

_MODULES = (reads, graphs, derived, rules, outputs, files)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
