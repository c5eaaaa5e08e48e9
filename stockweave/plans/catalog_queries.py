"""All queries of the catalog engine over the driver's tables."""

from __future__ import annotations

from . import q_facets, q_filters, q_ingest, q_request, q_scalars, q_search  # noqa: F401  they register queries
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
