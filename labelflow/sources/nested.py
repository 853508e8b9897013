"""Nested labelled datasets: a list of companies, each with its examples.

Read with an explicit schema (``Taxonomy`` is never read: writers store it as
an array in one file and as an empty object in another, so inference would
disagree between files).  ``explode_examples`` flattens with the example's
stored ``pos`` when present, else its array position in the whole company.

Scale: a company is not one record.  ``nest_examples`` cuts each company
into records bounded by examples and by bytes, so no task ever holds a whole
company; readers treat repeated company names as one company.  Each record holds its ``First Position``, the
number of the company's examples in the records before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.operators.runs import RANGE, ranged
from labelflow.session import written

EXAMPLE_TYPE = T.StructType([
    T.StructField("sample_text", T.StringType()),
    T.StructField("class", T.StringType()),
    T.StructField("class number", T.IntegerType()),
    T.StructField("entity_action", T.StringType()),
    # written by nest_examples; absent (null) in hand-made files
    T.StructField("pos", T.LongType()),
])
NESTED_SCHEMA = T.StructType([
    T.StructField("Company Name", T.StringType()),
    T.StructField("Examples", T.ArrayType(EXAMPLE_TYPE)),
    # written by nest_examples; absent (null) in hand-made files
    T.StructField("First Position", T.LongType()),
])


def read_nested_dataset(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON array of companies (``multi_line``) or JSON Lines, one company
    per line (what :func:`write_nested_dataset` writes)."""
    return spark.read.schema(NESTED_SCHEMA).option("multiLine", multi_line).json(path)


def filter_datasets(nested: DataFrame, names: str | list[str]) -> DataFrame:
    """Keep companies named in a space-separated list (before exploding)."""
    if isinstance(names, str):
        names = names.split()
    return nested.filter(F.col("`Company Name`").isin(list(names)))


# examples and bytes of text per written record (bounds the task that assembles one record)
MAX_EXAMPLES_PER_RECORD = 10_000
MAX_BYTES_PER_RECORD = 32 << 20


def explode_examples(nested: DataFrame) -> DataFrame:
    """One row per example with the company copied down:
    ``company_name, pos, sample_text, class_name, class_number, entity_action``.
    ``pos`` is the stored position when the file has one, else the record's
    first position plus the array position.  A record without a first position
    is its whole company (as hand-made files hold it); reading positions fails
    if such a company has several records.  The records are written as Parquet
    first, so JSON is parsed once and the check reads names and positions only."""
    nested = written(nested, "nested-records")
    stored = "pos" in nested.schema["Examples"].dataType.elementType.names
    first = (F.col("`First Position`") if "First Position" in nested.columns
             else F.lit(None).cast("bigint"))
    unplaced = F.exists("Examples", lambda e: e["pos"].isNull() if stored else F.lit(True))
    repeated = (nested.filter(first.isNull() & unplaced).groupBy("Company Name")
                      .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
                      .agg(F.max(F.coalesce("Company Name", F.lit("null"))).alias("_repeated")))
    ex = (nested.select(F.col("`Company Name`").alias("company_name"), first.alias("_first"),
                        F.posexplode("Examples").alias("_i", "e"))
                .crossJoin(F.broadcast(repeated)))                      # one row
    refuse = F.raise_error(F.concat(F.lit("several records without a first position: "),
                                    F.col("_repeated"))).cast("bigint")
    start = (F.when(F.col("_first").isNotNull(), F.col("_first"))
              .when(F.col("_repeated").isNotNull(), refuse).otherwise(F.lit(0)))
    pos = F.coalesce(*([F.col("e.pos")] if stored else []), start + F.col("_i"))
    return ex.select("company_name", pos.alias("pos"),
                     F.col("e.sample_text").alias("sample_text"),
                     F.col("e.class").alias("class_name"),
                     F.col("e.`class number`").alias("class_number"),
                     F.col("e.entity_action").alias("entity_action"))


def nest_examples(flat: DataFrame, company_col: str = "company_name", pos_col: str = "pos",
                  text_col: str = "sample_text", class_col: str = "class_name",
                  number_col: str = "class_number",
                  entity_col: str | None = None,
                  max_examples: int = MAX_EXAMPLES_PER_RECORD,
                  max_bytes: int = MAX_BYTES_PER_RECORD) -> DataFrame:
    """Regroup flat rows into ``{Company Name, Examples: [...], First Position}``
    records ordered by ``pos`` (null last, rows of one ``pos`` by a hash).

    Rows are dealt by ranges of (company, pos), and numbered within range and
    company; what a company has in earlier ranges, one row a range, is added.  A
    record ends after ``max_examples`` examples and where the texts' running
    bytes pass a multiple of ``max_bytes``, so it holds at most that and one
    text, however large the company and whatever its positions."""
    fields = [F.col(pos_col).cast("bigint").alias("_pos"), F.col(text_col).alias("sample_text"),
              F.col(class_col).alias("class"), F.col(number_col).cast("int").alias("class number")]
    fields.append((F.col(entity_col) if entity_col else F.lit(None).cast("string"))
                  .alias("entity_action"))
    # as a struct, a null company equals itself in joins
    rows = flat.select(F.struct(F.col(company_col).alias("company")).alias("_c"), *fields)
    rows = rows.withColumn("_tie", F.xxhash64(*[c for c in rows.columns if c not in ("_c", "_pos")]))
    order = [F.col("_pos").asc_nulls_last(), F.col("_tie")]
    table = ranged(rows.withColumn("_b", F.coalesce(F.octet_length("sample_text"), F.lit(0)).cast("bigint")),
                   [F.col("_c"), *order], "nested")
    upto = Window.partitionBy("_c").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = (table.groupBy("_c", RANGE).agg(F.count(F.lit(1)).alias("_n"), F.sum("_b").alias("_s"))
                   .select("_c", RANGE, F.sum("_n").over(upto).alias("_n0"), F.sum("_s").over(upto).alias("_s0"))
                   .where(F.col("_n0").isNotNull()))        # companies that go on from earlier ranges: one a range
    inside = Window.partitionBy(RANGE, "_c").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (table.withColumn("_i", (F.row_number().over(inside) - 1).cast("bigint"))
                   .withColumn("_a", F.coalesce(F.sum("_b").over(earlier), F.lit(0)))
                   .join(F.broadcast(before), ["_c", RANGE], "left")
                   .withColumn("_i", F.col("_i") + F.coalesce("_n0", F.lit(0)))
                   .withColumn("_a", F.col("_a") + F.coalesce("_s0", F.lit(0))))
    example = F.struct("_i", "sample_text", "class", "class number", "entity_action", F.col("_pos").alias("pos"))
    # grouped where the window left the rows: its partitioning is part of the key
    g = (placed.groupBy(RANGE, "_c", F.floor(F.col("_i") / max_examples).alias("_k"),
                        F.floor(F.col("_a") / max_bytes).alias("_m"))
               .agg(F.array_sort(F.collect_list(example)).alias("_ex"), F.min("_i").alias("_first")))
    return g.select(F.col("_c.company").alias("Company Name"),
                    F.transform("_ex", lambda e: e.dropFields("_i")).alias("Examples"),
                    F.col("_first").alias("First Position"))


def write_nested_dataset(nested: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write companies as JSON Lines (one company per line, many files).
    Read back with ``read_nested_dataset(..., multi_line=False)``."""
    nested.write.mode(mode).json(path)
