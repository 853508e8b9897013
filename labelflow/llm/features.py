"""Hashed text features and the linear scorer both classifiers use.

A feature is a 64-bit hash.  ``feature_counts`` counts in how many sampled
documents of each class a feature occurs, ``select`` keeps the most telling
ones, ``indicators`` gives a document's selected features, and ``score`` sums
their weights over every whole text in one pass.  A feature counts once per
document, so long texts do not outweigh their telling words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm import common as C

Extract = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _tag(h: np.ndarray, kind: int) -> np.ndarray:
    return C.mix(h ^ np.uint64(kind * 0x51ED2701))


def word_prefixes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): words in lower case and their first 4, 5 and 6 bytes."""
    low = C.LOWER[data]
    start, end, row = C.words(low, offsets)
    out = [_tag(C.span_hashes(low, start, end), 1)]
    rows = [row]
    for n in (4, 5, 6):
        long = end - start >= n
        out.append(_tag(C.span_hashes(low, start[long], start[long] + n), n))
        rows.append(row[long])
    return np.concatenate(rows), np.concatenate(out)


def word_ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): words, pairs of words, word endings, letter cases and immediate repeats."""
    low = C.LOWER[data]
    start, end, row = C.words(low, offsets)
    word = C.span_hashes(low, start, end)
    out, rows = [_tag(word, 1)], [row]
    same_row = row[1:] == row[:-1]
    with np.errstate(over="ignore"):
        pair = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]
    out.append(_tag(pair[same_row], 2))
    rows.append(row[1:][same_row])
    again = same_row & (word[1:] == word[:-1])
    out.append(_tag(np.zeros(int(again.sum()), np.uint64), 3))
    rows.append(row[1:][again])
    for n in (2, 3):
        long = end - start > n
        out.append(_tag(C.span_hashes(low, end[long] - n, end[long]), 10 + n))
        rows.append(row[long])
    if len(start):
        # letter cases beyond the first letter, digits and signs of a word
        kind = _CLASS[data]
        kind[start] &= 0xFE
        edges = np.column_stack([start, end]).ravel()
        shape = np.bitwise_or.reduceat(np.append(kind, 0).astype(np.uint8), edges)[::2]
        out.append(_tag(shape.astype(np.uint64), 4))
        rows.append(row)
    return np.concatenate(rows), np.concatenate(out)


_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 8
_CLASS[128:] = 16


def feature_counts(sample: DataFrame, extract: Extract, least: int) -> DataFrame:
    """(f, n1, n0): sampled documents of class 1 and 0 holding feature f; sample is (y, t)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, off in C.text_slices(b.column(1)):
                row, f = extract(data, off)
                order = np.lexsort((row, f))
                row, f = row[order], f[order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (row[1:] != row[:-1])
                row, f = row[new], f[new]
                if not len(f):
                    continue
                first = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
                n1 = np.add.reduceat((y[lo + row] == 1).astype(np.int64), first)
                n = np.diff(np.append(first, len(f)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f[first].view(np.int64)), pa.array(n1), pa.array(n - n1)], ["f", "n1", "n0"])

    return (sample.select("y", "t").mapInArrow(run, "f bigint, n1 bigint, n0 bigint")
            .groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
            .where(F.col("n1") + F.col("n0") >= least))


def select(counts: DataFrame, size1: int, size0: int, most: int, least_z: float = 4.0) -> np.ndarray:
    """(f, n1, n0) of at most ``most`` features, sorted by hash: those whose shares in the two
    classes differ by ``least_z`` standard errors or more, half a document being taken off."""
    n1, n0, a, b = F.col("n1"), F.col("n0"), float(size1), float(size0)
    p = (n1 + n0) / F.lit(a + b)
    gap = F.abs(n1 / F.lit(a) - n0 / F.lit(b)) - F.lit(0.5 / a + 0.5 / b)
    z = gap / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * F.lit(1 / a + 1 / b))
    best = counts.withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "f").limit(most).collect()
    rows = sorted((int(np.int64(r.f).view(np.uint64)), r.n1, r.n0) for r in best)
    return np.array(rows, dtype=[("f", np.uint64), ("n1", np.int64), ("n0", np.int64)])


class Lookup:
    """Position of a feature among the selected ones; most others fall at a bit test."""

    def __init__(self, selected: np.ndarray):
        self.selected = selected
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(selected >> np.uint64(44)).astype(np.int64)] = True

    def unique(self, row: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of each selected feature once per row."""
        if not len(self.selected):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = self.maybe[(f >> np.uint64(44)).astype(np.int64)]
        row, f = row[hit], f[hit]
        at = np.minimum(np.searchsorted(self.selected, f), len(self.selected) - 1)
        ok = self.selected[at] == f
        key = np.unique(row[ok] * len(self.selected) + at[ok])
        return key // len(self.selected), key % len(self.selected)


def indicators(sample: DataFrame, extract: Extract, selected: np.ndarray) -> DataFrame:
    """(y, at array<int>): positions of a sampled document's selected features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(selected)
        for b in batches:
            for lo, hi, data, off in C.text_slices(b.column(1)):
                row, at = look.unique(*extract(data, off))
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))], ["y", "at"])
    return sample.select("y", "t").mapInArrow(run, T.StructType(
        [sample.schema["y"], T.StructField("at", T.ArrayType(T.IntegerType()))]))


@dataclass
class Linear:
    """sigmoid(slope * (sum of weights + bias) + shift); constant if ``fixed`` is set."""

    features: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    fixed: float | None = None


def constant(score: float) -> Linear:
    return Linear(np.zeros(0, np.uint64), np.zeros(0), fixed=score)


def score(docs: DataFrame, model: Linear, extract: Extract, text_col: str = "text",
          columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``columns`` and the score (as ``name``) of every row; whole texts are read."""
    kept = [docs[c] for c in columns]
    rows = docs.select(*kept, docs[text_col].cast("string").alias("scored text")) if text_col not in columns \
        else docs.select(*kept)
    at = list(columns).index(text_col) if text_col in columns else len(columns)
    schema = T.StructType([*rows.schema.fields[:len(columns)], T.StructField(name, T.DoubleType())])
    # plain data: workers may not have this package
    sent = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias, model.slope,
                                                     model.shift, model.fixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Linear(*sent.value)
        look = Lookup(m.features)
        for b in batches:
            for lo, hi, data, off in C.text_slices(b.column(at)):
                if m.fixed is not None:
                    p = np.full(hi - lo, m.fixed)
                else:
                    row, pos = look.unique(*extract(data, off))
                    z = np.bincount(row, m.weights[pos], hi - lo) + m.bias
                    p = 1 / (1 + np.exp(-np.clip(m.slope * z + m.shift, -40, 40)))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(columns)], pa.array(p, pa.float64())],
                                                 schema.names)
    return rows.mapInArrow(run, schema)


def draw(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(y, t) of one document for each row of ``chosen`` (i, y), a table of bounded size; written once.
    Further columns of ``chosen`` stay.

    Of rows that share a chosen id, the one with the smallest text is drawn.
    """
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    one = texts.join(F.broadcast(chosen), "i").groupBy(*chosen.columns).agg(F.min("t").alias("t"))
    return C.materialize(one.drop("i"), name)
