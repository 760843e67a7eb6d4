"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from .plans import bindings, evidence, fleet, intake, normalizers, pages, records, review, rules  # noqa: F401  registers the queries
from .plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
