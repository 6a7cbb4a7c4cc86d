"""All registered queries of the library's operators, and their SQL."""

from __future__ import annotations

from geoloom.plans import chain_queries, dataset_queries, kernel_queries, more_queries, network_queries, raster_queries  # noqa: F401
from geoloom.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
