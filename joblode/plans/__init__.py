"""Registered queries: adapters from the driver's tables, the operators applied to them, and their SQL."""

from __future__ import annotations


def _load() -> None:
    from joblode.plans import aggregating, filtering, joining, ordering, projections, reading, reporting, streaming  # noqa: F401


def all_queries() -> dict:
    from joblode.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    from joblode.plans.registry import SQL

    _load()
    return dict(SQL)
