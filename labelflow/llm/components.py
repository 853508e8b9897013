"""Connected components of an edge table, all in Spark.

Alternates large-star and small-star steps: each node links its larger (then
its smaller) neighbours to the smallest one it knows.  With every edge pointing
to its smaller end, a large-star step replaces that end by its own least
neighbour: one map-side combined minimum and one join.  The same minimum tells
whether each component is a star around its smallest node, which ends the loop
without a round to confirm it.  A step never adds an edge.  Tables are written
between steps, nothing reaches the driver but whether a table is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm import common as C


def _least(edges: DataFrame) -> DataFrame:
    """(node, low, high, centre): least and largest smaller neighbour, whether larger ones exist."""
    ends = edges.select(F.col("u").alias("node"), "v", F.lit(False).alias("centre")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v"), F.lit(True).alias("centre")))
    return ends.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("centre").alias("centre"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label), written: label is the smallest node of the component; nodes without an edge are left out."""
    now = C.materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .where("u <> v"), name)
    while True:
        least = C.materialize(_least(now), f"{name}_least")
        label = F.coalesce("low", "node")
        if least.where("low <> high or (centre and low is not null)").isEmpty():
            return least.select("node", label.alias("label"))
        jumped = C.materialize(now.join(least.select(F.col("node").alias("v"), label.alias("m")), "v")
                               .select("u", F.col("m").alias("v")), name)
        low = jumped.groupBy("u").agg(F.min("v").alias("m"))
        # the edge to the least neighbour stays, each other neighbour is linked to it
        now = C.materialize(jumped.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), name)
