"""All queries of the library by name, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.plans import alignment_queries, etl_queries, event_queries, retrieval_queries, storage_queries, synthesis_queries, text_queries, validation_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (etl_queries, text_queries, retrieval_queries, validation_queries, event_queries, alignment_queries, storage_queries, synthesis_queries)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
