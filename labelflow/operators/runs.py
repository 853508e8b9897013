"""Running sums, row numbers and lags over one global order, without one global task.

A table is written in ranges of the order.  Inside a range a window does the
work; what a range needs from the ranges before it (a sum, a count, a last row)
comes from a border table of one row per range, which is broadcast.  Equal keys
share a range, so the order should end in a column that tells rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.session import written

RANGE = "_range"


def ranged(df: DataFrame, order: list[Column], name: str = "ranged") -> DataFrame:
    """``df`` written in ranges of ``order``, with the number of its range as ``_range``."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(parts, *order).withColumn(RANGE, F.spark_partition_id())
    return written(out, name)


def running(table: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its column over all rows before this one (0 at the first).

    ``table`` comes from ``ranged`` with the same ``order``; the border table
    holds one row for each range.
    """
    inside = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    border = table.groupBy(RANGE).agg(*[F.sum(c).alias(f"_b_{k}") for k, c in sums.items()])
    border = border.select(RANGE, *[F.coalesce(F.sum(f"_b_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}")
                                    for k in sums])
    own = table.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    out = own.join(F.broadcast(border), RANGE)
    return out.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums}).drop(*[f"_b_{k}" for k in sums])


def lagged(table: DataFrame, order: list[str], key: str, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Adds ``columns`` of the row before, null where that row has another ``key`` (null keys are equal).

    ``table`` comes from ``ranged`` ordered by ``key`` and then ``order``, columns
    that tell rows apart (rows equal in all of them stand in any order).  The last
    row of each range is passed on to the range after it, where it sorts first,
    so neither a key nor a range of keys has to be in one task.
    """
    place = F.struct(F.col(key), *[F.col(c) for c in order])
    last = table.groupBy(RANGE).agg(F.max(place).alias("_place"))
    # a row a range: where it ends and which range comes next
    after = last.select(F.col(RANGE).alias("_from"), "_place", F.lead(RANGE).over(Window.orderBy(RANGE)).alias("_to"))
    carried = (table.join(F.broadcast(after), (F.col(RANGE) == F.col("_from")) & place.eqNullSafe(F.col("_place")))
               .where(F.col("_to").isNotNull()).dropDuplicates(["_from"])
               .withColumn(RANGE, F.col("_to")).select(*table.columns, F.lit(0).alias("_own")))
    rows = table.withColumn("_own", F.lit(1)).unionByName(carried)
    w = Window.partitionBy(RANGE).orderBy("_own", key, *order)
    same = F.lag(F.struct(F.col(key).alias("k"))).over(w).eqNullSafe(F.struct(F.col(key).alias("k")))
    out = rows.withColumns({prefix + c: F.when(same, F.lag(c).over(w)) for c in columns})
    return out.where("_own = 1").drop("_own")
