"""Registered queries over the driver's tables, with their SQL twins."""

from __future__ import annotations


def queries() -> dict:
    from . import graph, whole  # noqa: F401  (both register)

    return dict(graph.QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import graph, whole  # noqa: F401  (both register)

    return dict(graph.SQL)
