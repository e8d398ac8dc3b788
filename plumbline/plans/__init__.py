"""Registered queries and the SQL that says the same."""

from __future__ import annotations

from .adapters import whole_oracles


def _modules() -> list:
    from . import analyses, architecture, assembly, evaluation, facts, programs

    return [architecture, evaluation, facts, assembly, programs, analyses]


def all_queries() -> dict:
    """Name -> (spark, sf_dir) -> DataFrame."""
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    own = {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
    return own | whole_oracles()
