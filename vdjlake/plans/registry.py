"""All queries of the library, and their SQL."""

from __future__ import annotations

from vdjlake.plans import clones, data_quality, exchange, records, repertoire, scalars, statistics

MODULES = [data_quality, scalars, repertoire, clones, statistics, records, exchange]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: q.strip() for m in MODULES for k, q in m.SQL.items()}
