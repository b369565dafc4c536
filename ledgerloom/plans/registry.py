"""All queries of the advisor and their DuckDB statements."""

from __future__ import annotations

from ledgerloom.plans import analytics, market, monitor, news, portfolio, streams
from ledgerloom.sources.tables import with_views

MODULES = (portfolio, market, monitor, news, analytics, streams)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for m in MODULES for name, sql in m.SQL.items()}
