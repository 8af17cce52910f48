"""All queries of the core."""

from __future__ import annotations

from chronoloom.plans import cleaning, clustering, series, sources, streams

MODULES = [cleaning, sources, streams, clustering, series]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
