"""Label taxonomies as small dimension tables.

A taxonomy maps a raw label key to a readable class name.  Dimensions are
tiny and fixed-size (tens to hundreds of rows), so joins against them are
broadcast hash joins.  Keys are always strings: integer-keyed taxonomies are
cast, so int and string label columns join the same way.

Large dictionaries (77-label and 151-label benchmark taxonomies, the two-level
hierarchy) are data, not code: load them with :func:`read_taxonomy` /
:func:`read_hierarchy` from a JSON object file ``{"key": "name", ...}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values ----------------------------------------------------------
# ATIS intent key -> class name (18 active entries, in the reference's order).
ATIS_TAXONOMY = {
    "abbreviation": "Abbreviation and Fare Code Meaning Inquiry",
    "aircraft": "Aircraft Type Inquiry",
    "airfare": "Airfare and Fares Questions",
    "airline": "Airline Information Request",
    "airport": "Airport Information and Queries",
    "capacity": "Aircraft Seating Capacity Inquiry",
    "cheapest": "Cheapest Fare Inquiry",
    "city": "Airport Location Inquiry",
    "distance": "Airport Distance Inquiry",
    "flight": "Flight Booking Request",
    "flight_no": "Flight Number Inquiry",
    "flight_time": "Time Inquiry",
    "ground_fare": "Ground Transportation Cost Inquiry",
    "ground_service": "Ground Transportation Inquiry",
    "ground_service+ground_fare": "Airport Ground Transportation and Cost Query",
    "meal": "Inquiry about In-flight Meals",
    "quantity": "Flight Quantity Inquiry",
    "restriction": "Flight Restriction Inquiry",
}
# Banking label 22 -> extra accepted class names (label expansion).
BANKING_EXPANSION = {
    22: ["Freeze Account", "Stolen", "Somebody Using My Account Or Card Or Information",
         "Fraud Hack", "Improper Use"],
}
# ----------------------------------------------------------------------------

# Dimension used by the registered queries over ``events.event_type``: four
# of the five event types are mapped ('signup' is not) and one key ('refund')
# never occurs, so lookups drop rows and the semi-join drops a key.
EVENT_TAXONOMY = {
    "click": "Click Interaction",
    "error": "Error Report",
    "purchase": "Purchase Completed",
    "refund": "Refund Request",
    "view": "Page View",
}


def taxonomy_dim(spark: SparkSession, mapping: dict, name: str = "taxonomy") -> DataFrame:
    """``(taxonomy, key, name)`` with string keys."""
    rows = [(name, str(k), v) for k, v in mapping.items()]
    return spark.createDataFrame(rows, "taxonomy string, key string, name string")


def expansion_dim(spark: SparkSession, mapping: dict) -> DataFrame:
    """``(key, names)``: extra accepted names per key."""
    rows = [(str(k), list(v)) for k, v in mapping.items()]
    return spark.createDataFrame(rows, "key string, names array<string>")


def hierarchy_dim(spark: SparkSession, mapping: dict) -> DataFrame:
    """``(l2, name)`` many-to-many memberships of a two-level hierarchy."""
    rows = [(g, n) for g, names in mapping.items() for n in names]
    return spark.createDataFrame(rows, "l2 string, name string")


def _entries(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``(key, value)`` of a JSON object file on any storage Spark reads; a broken file is an error."""
    parsed = F.from_json("value", f"map<string,{value}>", {"mode": "FAILFAST"})
    return spark.read.text(path, wholetext=True).select(F.explode(parsed).alias("key", "value"))


def read_taxonomy(spark: SparkSession, path: str, name: str = "taxonomy") -> DataFrame:
    """Taxonomy from a JSON object file ``{"key": "name", ...}``."""
    return _entries(spark, path, "string").select(F.lit(name).alias("taxonomy"), "key", F.col("value").alias("name"))


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Hierarchy from a JSON object file ``{"group": ["name", ...], ...}``."""
    return _entries(spark, path, "array<string>").select(F.col("key").alias("l2"), F.explode("value").alias("name"))


def map_labels(df: DataFrame, label_col: str, taxonomy: DataFrame, out_col: str = "label",
               keep_original: str | None = "orig_label", drop_unmapped: bool = True) -> DataFrame:
    """Look ``label_col`` up in ``taxonomy``; rows without a mapping are
    dropped (inner join) or kept with a null name (left join).  The
    taxonomy is broadcast after its size is checked; a large one is
    shuffle-joined."""
    from labelflow.operators.joins import bounded_broadcast

    dim = bounded_broadcast(taxonomy.select(F.col("key").alias("_key"), F.col("name").alias("_name")))
    src = df.withColumn(keep_original, F.col(label_col)) if keep_original else df
    how = "inner" if drop_unmapped else "left"
    j = src.join(dim, F.col(label_col).cast("string") == F.col("_key"), how)
    return j.withColumn(out_col, F.col("_name")).drop("_key", "_name")


def taxonomy_from_table(df: DataFrame, key_col: str, name_col: str,
                        name: str = "taxonomy") -> DataFrame:
    """A taxonomy dimension derived from a table: distinct (key, name)."""
    return df.select(F.lit(name).alias("taxonomy"), F.col(key_col).cast("string").alias("key"),
                     F.col(name_col).alias("name")).distinct()


def default_label_switch(df: DataFrame, key_col: str, name_col: str,
                         use_default_labels: bool, out_col: str = "y") -> DataFrame:
    """``y`` is the raw key when ``use_default_labels`` else the mapped name."""
    src = F.col(key_col).cast("string") if use_default_labels else F.col(name_col)
    return df.withColumn(out_col, src)


def present_labels(taxonomy: DataFrame, df: DataFrame, label_col: str) -> DataFrame:
    """Taxonomy entries whose key occurs in ``df`` (left semi join).  The
    keys are made distinct first: the partial aggregate leaves each task with
    its few distinct labels, so the semi join never shuffles the table."""
    keys = df.select(F.col(label_col).cast("string").alias("key")).distinct()
    return taxonomy.join(keys, "key", "left_semi")


def l2_rollup(df: DataFrame, name_col: str, hierarchy: DataFrame) -> DataFrame:
    """Rows per level-2 group.  Many-to-many: a name in several groups counts
    in each; names in no group count under a null group.

    Rows are counted per name first (map-side combine), so the join sees
    one row per distinct name and a hot name cannot skew it."""
    h = hierarchy.select(F.col("l2"), F.col("name").alias("_name"))
    per_name = df.groupBy(F.col(name_col).alias("_name")).agg(F.count(F.lit(1)).alias("_n"))
    j = per_name.join(h, per_name["_name"] == h["_name"], "left")
    return j.groupBy("l2").agg(F.sum("_n").cast("bigint").alias("n"))
