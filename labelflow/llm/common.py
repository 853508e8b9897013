"""Helpers the operators share: columns, scratch tables, Arrow text buffers.

Text leaves the JVM as Arrow batches.  ``text_slices`` cuts a batch into
slices of a few MB, each one contiguous UTF-8 buffer with row offsets, so a
task's memory does not depend on the batch size or on the length of a table.
A single longer text is a slice of its own: texts are never cut off.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.session import scratch_path

SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(modulus))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared scratch folder and read it back.

    Cuts the lineage (a lost executor rereads files instead of recomputing)
    and fixes the rows, so that several later passes see the same ones.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of about ``BATCH_BYTES``, unless the session sets a bound of its own.

    Spark's default is 64 MB: a task's vectors double up to that outside the JVM heap,
    and its Python worker holds the batch again.  Which rows a batch has does not change a result.
    """
    if spark.conf.get(BATCH_BOUND, None) is None:
        spark.conf.set(BATCH_BOUND, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type)
                            else "")
    arr = arr.cast(pa.large_binary())
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    if data is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8), offsets


def text_slices(arr, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive row ranges."""
    data, offsets = buffers(arr)
    n, lo = len(arr), 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        base = offsets[lo]
        yield lo, hi, data[base:offsets[hi]], offsets[lo:hi + 1] - base
        lo = hi
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on after their task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):        # not on every platform
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# bytes 0x20 and 0x09-0x0D separate words
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# A-Z to a-z, every other byte as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2, _GOLD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB),
                   np.uint64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix): every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD + np.uint64(seed))


BYTE_CODE = stream(256, 7)


def powers(n: int) -> np.ndarray:
    """g**0 .. g**(n-1) modulo 2**64, for an odd g."""
    p = np.full(max(n, 1), _GOLD | np.uint64(1), np.uint64)
    p[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p)


def words(data: np.ndarray, offsets: np.ndarray,
          sep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of non-separator bytes; ``sep`` marks them, white space if not given."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    if sep is None:
        sep = SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= sep[:-1]
    after = edge[1:].copy()
    after[:-1] |= sep[1:]
    start = np.flatnonzero(~sep & before)
    end = np.flatnonzero(~sep & after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of every span (spans must not be empty)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(first, size)
    at = pos + np.repeat(start, size)
    with np.errstate(over="ignore"):
        v = BYTE_CODE[data[at]] * powers(int(size.max()))[pos]
        return mix(np.add.reduceat(v, first) + size.astype(np.uint64))


def gather_spans(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i]+lengths[i]-1 for every i, one after another."""
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)


def parts(data: np.ndarray, offsets: np.ndarray, edge: np.ndarray,
          max_bytes: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A slice as it is, or a single long text in parts that begin at a byte marked in ``edge``."""
    n = len(data)
    if len(offsets) > 2 or n <= 2 * max_bytes:
        yield data, offsets
        return
    lo = 0
    while lo < n:
        hi = min(n, lo + max_bytes)
        while hi < n:
            cut = np.flatnonzero(edge[data[hi:hi + 65_536]])
            if len(cut):
                hi += int(cut[0])
                break
            hi = min(n, hi + 65_536)
        yield data[lo:hi], np.array([0, hi - lo])
        lo = hi


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind=pa.binary()) -> pa.Array:
    """The bytes of every span as an Arrow array."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    body = np.ascontiguousarray(data[gather_spans(size, start)]) if len(start) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(off), pa.py_buffer(body)])
