"""All queries of the engine's own operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import graph_queries, search_queries, text_queries  # noqa: F401  they register themselves
from tessera.plans.derive import QUERIES, SQL

FLAGSHIP = "hybrid_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
