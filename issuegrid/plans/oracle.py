"""DuckDB text for each registered query (the differential oracle).

Bodies name the stand-in views (``t_issue``, ``t_worklog``, ...); :func:`oracle_sql`
prefixes the view definitions as CTEs. Every computed column is aliased to the
Spark name, sums are cast to DECIMAL(18,2) and null order is spelled out.
"""

from __future__ import annotations

from ..sources.fixture import oracle_with

BODIES: dict[str, str] = {}


def sql(name: str, body: str) -> None:
    BODIES[name] = body


def oracle_sql() -> dict[str, str]:
    return {name: oracle_with(body) for name, body in BODIES.items()}


# Bodies live in these modules.
from . import o_access, o_changes, o_core, o_io, o_labels, o_pages, o_quality  # noqa: E402,F401
from . import o_maintain  # noqa: E402,F401  (over the bodies of the others)
