"""All registered queries of the library's own operators."""

from __future__ import annotations

from helixframe.plans import catalog, cohort, coverage, exports, inference, io, matching, placement, reports, rules, sources, structure, upkeep, variants  # noqa: F401  importing a module registers its queries


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict:
    return dict(catalog.SQL)
