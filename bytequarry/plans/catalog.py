"""Registry of the engine's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bytequarry.plans import analytics_queries, archive_queries, catalogue_queries, chunk_queries, kernel_queries

FLAGSHIP = "byte_entropy"
_MODULES = (chunk_queries, catalogue_queries, analytics_queries, kernel_queries, archive_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
