"""Deterministic, engine-independent row hash.

Sampling, splitting and shuffling in this package never depend on task order
or on a random generator: they order rows by this hash and break ties by the
row id.  The same value is reproducible in SQL engines that have ``md5``:

    Spark : conv(substring(md5(concat('<seed>:', id)), 1, 8), 16, 10)
    DuckDB: ('0x' || substr(md5('<seed>:' || id), 1, 8))::UBIGINT::BIGINT
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def det_hash(col, seed: int | str = DEFAULT_SEED) -> Column:
    """32-bit unsigned hash (as bigint) of ``seed:value``."""
    key = F.concat(F.lit(f"{seed}:"), _c(col).cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def det_hash_sql(expr: str, seed: int | str = DEFAULT_SEED) -> str:
    """DuckDB spelling of :func:`det_hash`, for oracle queries."""
    return f"('0x' || substr(md5('{seed}:' || ({expr})), 1, 8))::UBIGINT::BIGINT"
