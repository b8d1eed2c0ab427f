"""Registered queries: each runs an operator over the whole test tables and, where SQL
can say the same, carries the equivalent SQL text."""

from __future__ import annotations

from .base import QUERIES, SQL


def load_all() -> None:
    from . import calendar, catalog, colours, dashboards, ensembles, grids, layers, missing, points, quality, rolling, series, sources, streams, tiles, views  # noqa: F401


__all__ = ["QUERIES", "SQL", "load_all"]
