"""Ranked lexical search by hashed max-sketches, exact.

A term's impact in a document is (10**9 * tf) div (1000 * tf + 20 * m), where m
grows with the document's length; a score is the sum of weight * impact over an
item's distinct terms.

1. One pass over all texts writes a forward index: for each document with a term
   its number of terms, and the terms of the item set that it holds with their
   counts.  Terms no item asks for add to no score and are not kept.
2. N, L and each term's document count come from the index by aggregates, so the
   weights rest on all documents.
3. Each task reads documents in blocks.  A document's impacts fold into
   ``SKETCH`` coordinates (a hash of the term) by maximum; one matrix product of
   sketches and weights bounds every (document, item) score from above.
4. For each item the documents of a block are scored exactly by falling bound
   until the bound is below the item's kth best score so far.  That threshold
   goes on from block to block, and starts at the kth score over a first part of
   the index (about ``FIRST_ROWS`` documents, found in the same way), so a task
   returns only documents that can still rank.  A ranked window merges the tasks.

Items are worked through in sets of at most ``SET_ITEMS`` items and about
``SET_BYTES`` of terms, as that is what a task holds of them; each set reads the
texts once.  An item whose terms alone exceed the bytes is a set by itself.

Texts are read whole; a long one is tokenised in parts cut between terms.  Null
and empty texts have no term and count nowhere.  Rows repeated with one doc_id
are documents each; equal scores go by doc_id, null first.  Rows that share an
item_id (null too) are one item with the terms of all.  Items without a term,
and empty tables, give no rows.  Other columns are not read.  Terms are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm import common as C

TOP = 50
SKETCH = 512
BLOCK_DOCS = 2048
BLOCK_POSTINGS = 1 << 20
FIRST_SCORED = 64
FIRST_ROWS = 20_000
SET_ITEMS = 4096
SET_BYTES = 16 << 20
ITEM_COLUMNS = 512

# bytes outside [0-9A-Za-z] below 0x80 separate terms
BREAK = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    BREAK[_lo:_hi] = False


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, start, end, row) of every term of a slice."""
    low = C.LOWER[data]
    return low, *C.words(low, offsets, BREAK[low])


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term, h): the distinct terms of every item, written."""
    rows = items.select(items[id_col].alias("item"), items[text_col].cast("string").alias("t"))
    schema = T.StructType([T.StructField("item", rows.schema["item"].dataType),
                           T.StructField("term", T.BinaryType()), T.StructField("h", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, off in C.text_slices(b.column(1)):
                for part, cut in C.parts(data, off, BREAK):
                    low, start, end, row = terms(part, cut)
                    h = C.span_hashes(low, start, end)
                    order = np.lexsort((h, row))
                    new = np.ones(len(order), bool)
                    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
                    keep = order[new]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(lo + row[keep])), C.spans(low, start[keep], end[keep]),
                         pa.array(h[keep].view(np.int64))], schema.names)
    return C.materialize(rows.mapInArrow(run, schema).distinct(), "item_terms")


def item_sets(asked: DataFrame) -> tuple[DataFrame, int]:
    """``asked`` with the number of its set, and how many sets there are."""
    items, total = asked.agg(F.count_distinct(F.struct("item")), F.sum(F.octet_length("term") + 16)).first()
    sets = max(1, math.ceil(items / SET_ITEMS), math.ceil((total or 0) / SET_BYTES))
    return asked.withColumn("set", F.pmod(F.xxhash64("item"), F.lit(sets))), sets


def forward_index(docs: DataFrame, hashes: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, at, tf) of every document with a term, written.

    n: its terms; at, tf: positions in ``hashes`` (sorted) and counts, int32 each.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("t"))
    sent = docs.sparkSession.sparkContext.broadcast(hashes)
    names = ["doc_id", "n", "at", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        size = max(len(known), 1)
        maybe = np.zeros(1 << 20, bool)
        maybe[(known >> np.uint64(44)).astype(np.int64)] = True
        for b in batches:
            for lo, hi, data, off in C.text_slices(b.column(1)):
                n = np.zeros(hi - lo, np.int64)
                keys, tfs = [], []
                for part, cut in C.parts(data, off, BREAK):
                    low, start, end, row = terms(part, cut)
                    n += np.bincount(row, minlength=hi - lo)
                    h = C.span_hashes(low, start, end)
                    hit = maybe[(h >> np.uint64(44)).astype(np.int64)]
                    h, row = h[hit], row[hit]
                    pos = np.minimum(np.searchsorted(known, h), size - 1)
                    ok = known[pos] == h if len(known) else np.zeros(0, bool)
                    k, c = np.unique(row[ok] * size + pos[ok], return_counts=True)
                    keys.append(k)
                    tfs.append(c)
                key, where = np.unique(np.concatenate(keys), return_inverse=True)
                tf = np.bincount(where, np.concatenate(tfs), len(key)).astype(np.int32)
                some = np.flatnonzero(n)
                ends = np.searchsorted(key, np.arange(hi - lo + 1) * size)
                at = (key % size).astype(np.int32).view(np.uint8)
                first, last = ends[some] * 4, ends[some + 1] * 4
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(lo + some)), pa.array(n[some]), C.spans(at, first, last),
                     C.spans(tf.view(np.uint8), first, last)], names)
    return C.materialize(rows.mapInArrow(run, "doc_id bigint, n bigint, at binary, tf binary"), "forward_index")


def document_counts(index: DataFrame, size: int) -> np.ndarray:
    """Documents holding each of the ``size`` terms; each task returns one count a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(C.buffers(b.column(0))[0].view(np.int32), minlength=size) if len(b) else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "m"])

    out = np.zeros(size, np.int64)
    found = index.select("at").mapInArrow(run, "at bigint, m bigint").groupBy("at").agg(F.sum("m").alias("m"))
    for r in found.collect():                     # at most one row a term of the set
        out[r.at] = r.m
    return out


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row starts, term positions, counts) of bounded ranges of index rows."""
    at, off = C.buffers(b.column(2))
    tf, off2 = C.buffers(b.column(3))
    lo = 0
    while lo < len(b):
        hi = min(len(b), lo + BLOCK_DOCS, max(lo + 1, int(np.searchsorted(off, off[lo] + 4 * BLOCK_POSTINGS, "right")) - 1))
        yield (lo, hi, (off[lo:hi + 1] - off[lo]) // 4, at[off[lo]:off[hi]].view(np.int32),
               tf[off2[lo]:off2[hi]].view(np.int32))
        lo = hi


class _Best:
    """The k best (score, id) of one item so far; a null id comes before the others."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.least
        s, i, z = (np.concatenate([a, b[keep]]) for a, b in
                   ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((i, ~z, -s))[:self.k]
        self.score, self.id, self.null = s[order], i[order], z[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.score[-1]))


def scored(index: DataFrame, ids: pa.Array, wanted: list[np.ndarray], weights: np.ndarray, coordinate: np.ndarray,
           total_docs: int, total_terms: int, least: np.ndarray, k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's documents that may be among an item's k best."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((ids, wanted, weights, coordinate, least))
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("doc_id", T.LongType()),
                           T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted, weights, coordinate, least = sent.value
        best = [_Best(k, int(x)) for x in least]
        dense = np.zeros(max(len(weights), 1), np.int64)
        for b in batches:
            doc, null = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
            length = b.column(1).to_numpy()
            for lo, hi, starts, at, tf in _blocks(b):
                size = np.diff(starts)
                row = np.repeat(np.arange(hi - lo), size)
                m = 50 + (50 * length[lo:hi] * total_docs) // total_terms
                impact = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m[row])
                sketch = np.zeros((hi - lo) * SKETCH)
                np.maximum.at(sketch, row * SKETCH + coordinate[at], impact)
                sketch = sketch.reshape(hi - lo, SKETCH)
                for q0 in range(0, len(wanted), ITEM_COLUMNS):
                    group = wanted[q0:q0 + ITEM_COLUMNS]
                    ask = np.zeros((SKETCH, len(group)))
                    for j, t in enumerate(group):
                        np.add.at(ask[:, j], coordinate[t], weights[t])
                    # sums are whole numbers; the factor covers rounding beyond 2**53
                    bound = (sketch @ ask) * (1 + 1e-9)
                    floor = np.array([x.least for x in best[q0:q0 + ITEM_COLUMNS]])
                    for j in np.flatnonzero((bound >= floor).any(axis=0)):
                        mine, t = best[q0 + j], group[j]
                        may = np.flatnonzero(bound[:, j] >= mine.least)
                        may = may[np.argsort(-bound[may, j], kind="stable")]
                        dense[t] = weights[t]
                        done, step = 0, FIRST_SCORED
                        while done < len(may) and bound[may[done], j] >= mine.least:
                            d = may[done:done + step]
                            near = C.gather_spans(size[d], starts[d])
                            exact = np.add.reduceat(dense[at[near]] * impact[near], np.cumsum(size[d]) - size[d])
                            mine.add(exact, doc[lo + d], null[lo + d])
                            done, step = done + step, 2 * step
                        dense[t] = 0
        count = np.array([len(x.score) for x in best], np.int64)
        if not count.sum():
            return
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(np.repeat(np.arange(len(best)), count))),
             pa.array(np.concatenate([x.id for x in best]), mask=np.concatenate([x.null for x in best])),
             pa.array(np.concatenate([x.score for x in best]))], schema.names)
    return index.mapInArrow(run, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_set(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """The candidates of one set of items; ``asked`` is (item, h), bounded as ``item_sets`` says."""
    pairs = asked.select("item", "h").toArrow()
    groups = pairs.group_by("item").aggregate([("h", "list")])
    ids = groups.column("item").combine_chunks().cast(pa.int64())
    hashes = np.unique(pairs.column("h").to_numpy().view(np.uint64))
    wanted = [np.searchsorted(hashes, np.array(x, np.int64).view(np.uint64)) for x in groups.column("h_list").to_pylist()]
    index = forward_index(docs, hashes, id_col, text_col)
    n, total = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = document_counts(index, len(hashes))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    coordinate = (C.mix(hashes) % np.uint64(SKETCH)).astype(np.int64)
    least = np.ones(len(wanted), np.int64)
    common = (ids, wanted, weights, coordinate, n, total or 1)
    every = n // FIRST_ROWS
    if every > 1:
        part = index.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(every)) == 0)
        at = {i: j for j, i in enumerate(ids.to_pylist())}
        for r in ranked(scored(part, *common, least, k), k).where(F.col("rank") == k).collect():   # a row an item
            least[at[r.item_id]] = r.score
    return scored(index, *common, least, k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``k`` best documents with a score above 0; ids are long integers."""
    asked, sets = item_sets(item_terms(items, item_id_col, item_text_col))
    found = None
    for i in range(sets):
        part = search_set(docs, asked.where(F.col("set") == i), k, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    return ranked(found, k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def q_op11(spark, sf_dir):
    return search(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


QUERIES = {"op11_max_sketch_search": q_op11}
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {"op11_max_sketch_search": f"""
with d as (
  select row_number() over () as row, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') as ts from documents),
s as (select count(*) as n_docs, cast(sum(len(ts)) as bigint) as n_terms from d where len(ts) > 0),
q as (select distinct item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as term from benchmark),
p as (
  select row, doc_id, len(ts) as n, unnest(ts) as term from d),
f as (
  select row, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*) as tf
  from p where term in (select term from q) group by row, term),
w as (
  select term, cast(floor(1000 * ln((2 * max(n_docs) + 2) / cast(2 * count(*) + 1 as double))) as bigint) as w
  from f, s group by term),
c as (
  select q.item_id, f.row, any_value(f.doc_id) as doc_id,
         cast(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (50 + (50 * f.n * s.n_docs) // s.n_terms)))) as bigint) as score
  from q join f using (term) join w using (term), s group by q.item_id, f.row),
r as (
  select *, cast(row_number() over (partition by item_id order by score desc, doc_id nulls first) as integer) as rank
  from c where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50"""}
