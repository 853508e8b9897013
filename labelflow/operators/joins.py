"""Joins against dimension tables whose size is checked, not assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from labelflow.session import scratch_path

# Dimension rows shipped to every task at most; beyond this the join is a
# regular shuffle join (AQE may still pick a broadcast from runtime sizes).
MAX_BROADCAST_DIM_ROWS = 1_000_000


MAX_BROADCAST_DIM_BYTES = 32 << 20


def bounded_broadcast(dim: DataFrame, max_rows: int = MAX_BROADCAST_DIM_ROWS,
                      max_bytes: int = MAX_BROADCAST_DIM_BYTES, beyond: str | None = None) -> DataFrame:
    """``dim``, written once, as a broadcast side when it has at most ``max_rows``
    rows and, as JSON, ``max_bytes`` bytes, else as a plain table (with the join
    hint ``beyond``, if given).

    Rows and bytes are observed while the table is written into the shared
    scratch folder, so its plan runs once: the join reads what was measured, and
    every later use reads it too.  Two numbers reach the driver."""
    seen = Observation()
    size = F.octet_length(F.to_json(F.struct(*[dim[c] for c in dim.columns])))
    path = scratch_path(dim.sparkSession, "dimension")
    dim.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).write.parquet(path)
    written = dim.sparkSession.read.schema(dim.schema).parquet(path)
    if seen.get["rows"] <= max_rows and (seen.get["bytes"] or 0) <= max_bytes:
        return F.broadcast(written)
    return written.hint(beyond) if beyond else written


def shuffled(table: DataFrame) -> DataFrame:
    """``table`` as the side of a join that both sides are shuffled for.

    For tables of a row for each query: Spark judges them by the size of the
    files they come from, where a text that many rows repeat is stored once, and
    would broadcast rows of many times that size through the driver."""
    return table.hint("merge")
