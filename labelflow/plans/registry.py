"""Registry of the named queries exposed through ``__spark_entry__``.

Each query is a callable ``(spark, sf_dir) -> DataFrame`` over the driver
tables; most carry an equivalent DuckDB SQL text used as the correctness
oracle.  Queries and their SQL live side by side so column names agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Decorator: register ``fn`` under ``key`` with its oracle SQL (if any)."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE_SQL[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module so that its queries register."""
    from labelflow.plans import (catalog_eval, catalog_sampling,  # noqa: F401
                                 catalog_fewshot, catalog_matching, catalog_prepare,
                                 catalog_similarity,
                                 catalog_text,
                                 catalog_taxonomy)
