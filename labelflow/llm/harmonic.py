"""Harmonic packing of token sequences.

Pieces of at most ``capacity`` tokens fall into reciprocal classes: class k
holds lengths of about capacity / k, and a sequence of class k holds exactly k
of its pieces.  Documents may be cut freely, so a document is cut into full
pieces and a tail, and the tail into class lengths capacity // k, the largest
that fits first.  Every piece of a class then has the class's length, and a
filled sequence wastes less than k tokens.

Classes are filled independently: pieces are dealt to buckets by a row number
written with them, so equal pieces part too, a window numbers them within (bucket, class), and a small table of counts gives
each bucket its first number.  Number n of class k is slot n mod k of sequence
n div k.  What is left over is fewer than k pieces per class, a constant
number whatever the input; those are packed first-fit by falling length.

A document is its ids and then the end id.  A null or empty text is the end id
alone; an empty table gives no piece.  Null and repeated document ids are
allowed; each row is packed.  A very long text is encoded as one slice and
becomes as many pieces as it needs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm import bpe_codec as B
from labelflow.llm import common as C

CAPACITY = 1024
END_ID = 0
ROWS_PER_BUCKET = 200_000
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n tokens; each is capacity // k for some k."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        # the smallest k with capacity // k <= n
        size = capacity // (capacity // (n + 1) + 1)
        out.append(size)
        n -= size
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece of every document."""
    text = B.load(docs.sparkSession, path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType),
                           *(T.StructField(c, T.LongType()) for c in PIECE[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = B.Codec(text.value)
        tails = {n: cut_lengths(n, capacity) for n in range(capacity)}
        for b in batches:
            for lo, hi, data, off in C.text_slices(b.column(1)):
                ids, at = codec.encode(data, off)
                row, start, size, crc, total = [], [], [], [], []
                for i in range(hi - lo):
                    own = np.append(ids[at[i]:at[i + 1]], np.uint32(end_id)).astype("<u4")
                    n, s = len(own), 0
                    for m in [capacity] * (n // capacity) + tails[n % capacity]:
                        row.append(lo + i)
                        start.append(s)
                        size.append(m)
                        crc.append(zlib.crc32(own[s:s + m].tobytes()))
                        total.append(n)
                        s += m
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())),
                     *(pa.array(x, pa.int64()) for x in (start, size, crc, total))], PIECE)
    return rows.mapInArrow(run, schema)


def _first_fit(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending")] + [(c, "ascending") for c in PIECE if c != "length"])
        used = np.zeros(len(t) + 1, np.int64)
        seq, off = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        for i, n in enumerate(t.column("length").to_pylist()):
            j = int(np.argmax(used + n <= capacity))
            seq[i], off[i] = j, used[j]
            used[j] += n
        return t.append_column("sequence_id", pa.array(seq * (2 * capacity))).append_column("offset", pa.array(off))
    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece (lengths capacity // k) a sequence and an offset in it."""
    spark = cut.sparkSession
    base = C.materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    buckets = max(C.partitions(spark), math.ceil(base.count() / ROWS_PER_BUCKET))
    keyed = (base.withColumn("k", F.floor(F.lit(capacity) / F.col("length")).cast("int"))
             .withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")))
    by_class = Window.partitionBy("k")
    counts = (keyed.groupBy("bucket", "k").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(by_class.orderBy("bucket")) - F.col("n"))
              .withColumn("total", F.sum("n").over(by_class)).drop("n"))
    within = Window.partitionBy("bucket", "k").orderBy(*PIECE)
    placed = (keyed.withColumn("i", F.row_number().over(within) - 1)
              .join(counts, ["bucket", "k"])
              .withColumn("number", F.col("before") + F.col("i"))
              .withColumn("spare", F.col("number") >= F.col("total") - F.col("total") % F.col("k")))
    number, k = F.col("number"), F.col("k")
    full = placed.where("not spare").select(
        *PIECE, (F.floor(number / k) * (2 * capacity) + k).cast("long").alias("sequence_id"),
        ((number % k) * F.col("length")).cast("long").alias("offset"))
    schema = T.StructType([*(base.schema[c] for c in PIECE), T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    # fewer than k pieces of each class: at most a few thousand rows in all
    spare = placed.where("spare").select(*PIECE).groupBy(F.lit("spare").alias("all")).applyInArrow(_first_fit(capacity), schema)
    return full.unionByName(spare)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(pieces(docs, path, capacity, end_id), capacity)


def q_op1(spark, sf_dir):
    return pack_documents(C.read(spark, sf_dir, "documents"), B.default_path())


QUERIES = {"op1_harmonic_packing": q_op1}
ORACLE_SQL: dict[str, str] = {}
