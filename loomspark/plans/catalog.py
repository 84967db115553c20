"""All registered queries of the memory engine and their DuckDB twins."""

from __future__ import annotations

from loomspark.plans import evaluation_queries, note_queries, pipeline_queries, retrieval_queries  # noqa: F401  (they register)
from loomspark.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
