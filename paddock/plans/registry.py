"""All registered queries except the text subpackage's."""

from __future__ import annotations

from paddock.plans import lap_queries, live_queries, more_queries, session_queries, sink_queries, storage_queries, trace_queries  # noqa: F401  importing registers
from paddock.plans.session_queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
