"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from . import baseline, chat, corpus, files, grids, ledger, problems, programs, registry, scoring, text  # noqa: F401  (each registers its queries)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
