"""All registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notelith.plans import data_quality, evaluation_queries, page_queries, scalar_queries, stream_queries, supplier_queries, total_queries

MODULES = [data_quality, scalar_queries, total_queries, evaluation_queries, page_queries, supplier_queries, stream_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
