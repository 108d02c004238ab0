"""All queries of the engine over the driver's tables, and their SQL."""

from __future__ import annotations

from . import catalog_more, catalog_parts, catalog_policies, catalog_stats, catalog_uris  # noqa: F401
from .base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
