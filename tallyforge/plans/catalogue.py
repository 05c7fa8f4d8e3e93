"""Every registered query with its SQL twin."""

from __future__ import annotations

from . import analytics, converted, layouts, ordered, resumes, texts  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
