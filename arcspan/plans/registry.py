"""All queries of the core and their SQL."""

from __future__ import annotations

from arcspan.plans import reference, reference_mc, reference_more, reference_stats, training

_MODULES = (reference, reference_stats, reference_more, reference_mc, training)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
