"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import audit, conversations, decontaminate, html, jaccard, language, licenses, nearest, packing, pii, quality, secrets, sentencepieces

MODULES = (pii, decontaminate, licenses, sentencepieces, nearest, html, quality, language, secrets, jaccard, conversations, packing, audit)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
