"""Queries over the reference tables by name, each with its SQL equivalent where there is one."""

from __future__ import annotations

from lorespark.plans import evaluation_queries, function_queries, ingest_queries, search_queries, table_queries  # noqa: F401
from lorespark.plans.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
