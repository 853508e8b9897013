"""Stateless operators on a streaming DataFrame give the batch result."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from labelflow.functions.text import clean_prediction, extract_class_name, normalize_label
from labelflow.operators.sampling import hash_split


def _plan(df):
    return hash_split(df, "doc_id").select(
        "doc_id", "split", normalize_label("lang").alias("norm"),
        extract_class_name(F.concat(F.lit("Class name: "), F.upper("lang"))).alias("cls"),
        clean_prediction(F.col("doc_id")).alias("clean"))


def test_stateless_operators_stream_like_batch(spark, sf_dir):
    path = os.path.join(sf_dir, "documents.parquet")
    batch = spark.read.parquet(path)
    # a file stream source watches a folder; the glob picks the one table
    stream = (spark.readStream.schema(batch.schema).option("pathGlobFilter", "documents.parquet")
              .parquet(sf_dir))
    base = tempfile.mkdtemp(prefix="labelflow-stream-")
    q = (_plan(stream).writeStream.format("parquet")
         .option("checkpointLocation", os.path.join(base, "ckpt"))
         .option("path", os.path.join(base, "out"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.read.parquet(os.path.join(base, "out")).collect())
    want = sorted(tuple(r) for r in _plan(batch).collect())
    assert got == want
