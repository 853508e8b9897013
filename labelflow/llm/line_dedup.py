"""Line dedup by range-partitioned hashes; the result is keep bitmaps, not text.

1. A task turns its documents into (line hash, document, positions) rows, one
   per document and distinct line key; the 128-bit hash stands for the key (a
   line stripped of bytes 0x20 and 0x09-0x0D at both ends, A-Z lower-cased).
2. Misra-Gries summaries find hashes that may be frequent.  At most
   ``counters`` of them are settled by an exact map-side combined aggregate
   and a broadcast, so no line that many documents share meets in one task.
3. All other rows are range-partitioned by hash and sorted by hash, document
   and position.  A task streams its sorted rows, sees first occurrences and
   run lengths, and emits the positions to drop.
4. Dropped positions are gathered per document into a zlib-compressed bitmap
   (bit i = line i stays).  A document without a dropped line has no bitmap.

Policies: ``frequent`` drops every line whose key occurs in at least
``min_docs`` documents, ``first`` drops all but the first occurrence in
(document, position) order.  A null or empty text is one empty line; keys
shorter than ``min_chars`` are never dropped.  Every row counts as a document,
also a repeated one.  Documents are told apart by id and a hash of the text,
so null or repeated ids are no problem.  A very long text is split whole in one
slice; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm import common as C
from labelflow.llm.exact_dedup import misra_gries

# no hash that is left to the ranges holds more than this share of all rows
COUNTERS = 16_384
STRIP = b" \t\n\x0b\x0c\r"
RUN = ["h", "id", "text_key", "n_lines", "pos"]


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in C.text_slices(b.column(2)):
                raw = data.tobytes()
                rows, hashes, pos, n_lines = [], [], [], []
                for r in range(hi - lo):
                    seen: dict[bytes, list[int]] = {}
                    lines = raw[off[r]:off[r + 1]].split(b"\n")
                    for i, line in enumerate(lines):
                        key = line.strip(STRIP).lower()
                        if len(key) < min_chars or min_chars > 1 and len(key.decode()) < min_chars:
                            continue
                        seen.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                    rows.extend([lo + r] * len(seen))
                    hashes.extend(seen)
                    pos.extend(seen.values())
                    n_lines.extend([len(lines)] * len(seen))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes, pa.binary()), b.column(0).take(at), b.column(1).take(at),
                     pa.array(n_lines, pa.int32()), pa.array(pos, pa.list_(pa.int32()))], RUN)
    return run


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("text_key"), t.alias("t"))


def _run_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("h", T.BinaryType()), T.StructField("id", id_type),
                         T.StructField("text_key", T.LongType()), T.StructField("n_lines", T.IntegerType()),
                         T.StructField("pos", T.ArrayType(T.IntegerType()))])


def _runs(h: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first row, size) of every run of equal hashes."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.frombuffer(C.buffers(h)[0].tobytes(), "S1").reshape(len(h), -1).view(np.uint8)
    change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
    first = np.concatenate([[0], change])
    return first, np.diff(np.concatenate([first, [len(h)]]))


def _drop_frequent(min_docs: int):
    """Rows of hashes with at least min_docs rows, from rows sorted by hash.

    Only an undecided run (fewer than min_docs rows) is carried from one batch
    to the next, so a run of any length streams through.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, decided = None, None
        for b in batches:
            t = pa.Table.from_batches([b])
            if pending is not None:
                t = pa.concat_tables([pending, t])
            t = t.combine_chunks()
            if not len(t):
                continue
            h = t.column("h").combine_chunks()
            first, size = _runs(h)
            drop = size >= min_docs
            if decided is not None and h[0].as_py() == decided:
                drop[0] = True
            last = len(first) - 1
            decided = h[int(first[last])].as_py() if drop[last] else None
            pending = None if drop[last] else t.slice(int(first[last]))
            mask = np.repeat(drop, size)
            out = t.filter(pa.array(mask)).combine_chunks()
            yield from out.to_batches()
    return run


def _drop_later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All positions but the first one of every hash, from sorted rows."""
    carry = None
    for b in batches:
        if not len(b):
            continue
        h, pos = b.column(0), b.column(4).to_pylist()
        first, _ = _runs(h)
        head = set(first.tolist())
        if carry is not None and h[0].as_py() == carry:
            head.discard(0)
        carry = h[len(h) - 1].as_py()
        left = [p[1:] if i in head else p for i, p in enumerate(pos)]
        out = pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(left, pa.list_(pa.int32()))], RUN)
        yield out.filter(pa.array([bool(p) for p in left], pa.bool_()))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: str = "frequent",
                  min_docs: int = 10, min_chars: int = 1, counters: int = COUNTERS) -> DataFrame:
    """(h, id, text_key, n_lines, pos) of the lines that leave."""
    spark = docs.sparkSession
    source = _identified(docs, id_col, text_col)
    schema = _run_schema(source.schema["id"].dataType)
    narrow = source.select("id", "text_key", "t")
    lines = C.materialize(narrow.mapInArrow(_line_rows(min_chars), schema), "lines")
    frequent = (lines.select(F.col("h").alias("digest")).mapInArrow(misra_gries(counters), "digest binary, n bigint")
                .groupBy("digest").agg(F.sum("n").alias("n"))
                .orderBy(F.desc("n"), "digest").limit(counters).select(F.col("digest").alias("h")))
    order = F.struct("id", "text_key", F.element_at("pos", 1).alias("p"))
    verdict = (lines.join(F.broadcast(frequent), "h").groupBy("h")
               .agg(F.count(F.lit(1)).alias("docs"), F.min(order).alias("first")))
    verdict = C.materialize(verdict, "frequent_lines")        # at most ``counters`` rows
    hot = lines.join(F.broadcast(verdict), "h")
    cold = (lines.join(F.broadcast(verdict.select("h")), "h", "left_anti")
            .repartitionByRange(C.partitions(spark), "h").sortWithinPartitions("h", "id", "text_key", "pos"))
    if policy == "frequent":
        return (hot.where(F.col("docs") >= min_docs).select(*RUN)
                .unionByName(cold.mapInArrow(_drop_frequent(min_docs), schema)))
    if policy != "first":
        raise ValueError(f"unknown policy {policy!r}")
    # repeated rows share id and text: one bitmap serves them, so all of them keep the line
    is_first = order.eqNullSafe(F.col("first"))
    rest = F.when(is_first, F.slice("pos", 2, F.greatest(F.size("pos") - 1, F.lit(0)))).otherwise(F.col("pos"))
    return (hot.select("h", "id", "text_key", "n_lines", rest.alias("pos")).where(F.size("pos") > 0)
            .unionByName(cold.mapInArrow(_drop_later, schema)))


def _bitmap(n_lines, groups):
    keep = np.ones(int(n_lines), bool)
    for g in groups:
        keep[g] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def gathered(dropped: DataFrame) -> DataFrame:
    """(id, text_key, n_lines, pos): a document's dropped positions; equal ones of repeated rows are one, before the shuffle."""
    return dropped.groupBy("id", "text_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("pos"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, text_key, n_lines, bitmap) of every document that loses a line."""
    @F.pandas_udf("binary")
    def pack(n_lines, groups):
        import pandas as pd
        return pd.Series([_bitmap(n, g) for n, g in zip(n_lines, groups)])

    return (gathered(dropped_lines(docs, id_col, text_col, **options))
            .select("id", "text_key", "n_lines", pack("n_lines", "pos").alias("bitmap")))


def kept_mask(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    if bitmap is None:
        return np.ones(n_lines, bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, t, bitmap): every document once; the small side is hashed, texts are not sorted."""
    maps = keep_bitmaps(docs, id_col, text_col, **options).select(
        F.col("id").alias("bid"), F.col("text_key").alias("bkey"), "bitmap")
    hit = F.col("id").eqNullSafe(F.col("bid")) & (F.col("text_key") == F.col("bkey"))
    return (_identified(docs, id_col, text_col).join(maps.hint("shuffle_hash"), hit, "left")
            .select("id", "t", "bitmap"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = C.buffers(b.column(1))
        raw, maps = data.tobytes(), b.column(2).to_pylist()
        n, gone, sha = [], [], []
        for i in range(len(b)):
            text = raw[off[i]:off[i + 1]]
            lines = text.count(b"\n") + 1
            lost = 0
            if maps[i] is not None:
                keep = kept_mask(maps[i], lines)
                lost = lines - int(keep.sum())
                text = b"\n".join(x for x, k in zip(text.split(b"\n"), keep) if k)
            n.append(lines)
            gone.append(lost)
            sha.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def q_op6(spark, sf_dir):
    rows = with_bitmaps(C.read(spark, sf_dir, "documents"), policy="frequent", min_docs=10, min_chars=1)
    return rows.mapInArrow(_digests, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


QUERIES = {"op6_line_dedup": q_op6}
ORACLE_SQL = {"op6_line_dedup": r"""
with l as (
  select row, doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
        from (select row_number() over () as row, doc_id, text from documents))),
f as (select k from l where length(k) >= 1 group by k having count(distinct row) >= 10)
select any_value(l.doc_id) as doc_id, count(*) as n_lines, count(f.k) as n_dropped,
       sha256(coalesce(string_agg(case when f.k is null then line end, chr(10) order by pos), '')) as kept_sha256
from l left join f on l.k = f.k group by l.row"""}
