"""CSV prediction tables: quoted cells may contain commas and newlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PREDICTION_SCHEMA = T.StructType([
    T.StructField("prediction", T.StringType()),
    T.StructField("y", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("prompt_options", T.StringType()),
    T.StructField("original", T.StringType()),
])
SPLIT_SCHEMA = T.StructType([
    T.StructField("sample_text", T.StringType()),
    T.StructField("class_name", T.StringType()),
    T.StructField("class_number", T.IntegerType()),
])


def read_predictions_csv(spark: SparkSession, path: str,
                         schema: T.StructType | str = PREDICTION_SCHEMA, multi_line: bool = True) -> DataFrame:
    """CSV with a header row.  With ``multi_line`` quoted cells may span lines and a
    file is one task; turn it off for large files without such cells.  An empty
    cell, quoted or not, is null, as in the reference's reader."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
                 .option("quote", '"').option("escape", '"').csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header + quoted cells, no index column; many part files."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))
