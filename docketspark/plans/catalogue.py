"""The registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import case_queries, search_queries, text_queries  # noqa: F401  they register themselves
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
