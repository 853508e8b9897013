"""Exact top-k inner product search by Fagin's threshold algorithm.

Vectors become integers floor(scale * x).  Candidates are dealt into blocks and
queries into chunks, both sized by the bytes a task holds; each block meets each
chunk once (a stated query set against all rows, in blocks).  Within a block
every dimension has its list of rows sorted by value.  The queries of a chunk
walk the lists together, each from the end its sign prefers and all at one depth.
Rows newly met by any of them are scored in full, by one matrix product for the
queries still walking.  A query stops when its threshold (the score of an
imaginary row with every dimension's value at the current depth) is below the
kth score it knows; equal scores go to the smaller id, so it goes on while the
threshold equals that score.

The kth score known at the start comes from a first block, which all queries walk
before the others: later blocks stop sooner and return only rows that reach it.
The blocks' best rows per query are merged by a ranked window.

Every row that the condition picks is a query and is answered by itself: all
other rows are its candidates, also rows that repeat its id or its vector, and
the answers of rows that share an id stand side by side.  Vectors that are null
or hold a null, NaN or infinite component, and rows with a null id, take no part;
vectors meet only vectors of the same length.  With fewer than k candidates all
are returned.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm import common as C

BLOCK_BYTES = 32 << 20      # a block's vectors, sorted lists and row numbers
CHUNK_BYTES = 16 << 20      # a chunk's query vectors
SCORE_BYTES = 32 << 20      # scores of one step
LEAST_BLOCK = 2048          # rows below which no further task is worth while
FIRST_DEPTH = 32


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    return (table.select(F.col(id_col).alias("id"), x.alias("x"))
            .where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(finite)
            .select("id", F.transform("x", lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v")))


def numbered_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, row) written once, so a row keeps its number."""
    rows = integer_vectors(table, id_col, vector_col, scale).withColumn("id", F.col("id").cast("long"))
    return C.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def dealt(count: int):
    """One of ``count`` parts; the row number deals repeated rows apart."""
    return F.pmod(F.xxhash64("id", "row"), F.lit(count)).cast("int")


def _merged(best: tuple, score: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """The k best (score, row) of each query, from those known and a matrix of new scores."""
    if score.shape[1] > 4 * k:
        # every score that may be among the k best: the kth largest and its equals
        kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        kth = np.maximum(kth, best[0].min(axis=1))
        q, at = np.nonzero(score >= kth[:, None])
    else:
        q, at = np.nonzero(score > _NONE)
    n = len(score)
    allq = np.concatenate([np.repeat(np.arange(n), k), q])
    alls = np.concatenate([best[0].ravel(), score[q, at]])
    allr = np.concatenate([best[1].ravel(), rows[at]])
    order = np.lexsort((ids[allr], -alls, allq))
    allq, alls, allr = allq[order], alls[order], allr[order]
    first = np.searchsorted(allq, np.arange(n))
    keep = first[:, None] + np.arange(k)
    return alls[keep], allr[keep]


_NONE = np.iinfo(np.int64).min // 2


def threshold_top_k(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int,
                    own: np.ndarray | None = None, least: np.ndarray | None = None
                    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector row, score) of the k best rows of one block for each query.

    ``own`` is each query's row in the block or -1, which is no candidate; ``least`` a score it is
    known to reach k times elsewhere, so that lower ones need not be found.
    """
    n, dims = vectors.shape
    m = len(queries)
    own = np.full(m, -1) if own is None else own
    least = np.full(m, _NONE) if least is None else least
    up = np.argsort(vectors, axis=0, kind="stable")              # (rank, dim): row, smallest first
    value = np.take_along_axis(vectors, up, axis=0)
    # float64 is exact (and fast) while every sum stays below 2**53
    largest = int(np.abs(vectors).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(dims, 1)
    kind = np.float64 if largest < 2 ** 53 else np.int64
    work, asked = vectors.astype(kind), queries.astype(kind)
    rising, falling = np.minimum(queries, 0), np.maximum(queries, 0)
    best = (np.full((m, k), _NONE), np.zeros((m, k), np.int64))
    used = (queries != 0).any(axis=0)
    seen = np.zeros(n, bool)
    walking = np.arange(m)
    depth, step = 0, FIRST_DEPTH
    while depth < n and len(walking):
        end = min(n, depth + step)
        before = seen.copy()
        if (queries[walking] < 0).any():
            seen[up[depth:end][:, used].ravel()] = True
        if (queries[walking] > 0).any():
            seen[up[n - end:n - depth][:, used].ravel()] = True
        if not used.any() or end == n:
            seen[:] = True
        met = np.flatnonzero(seen & ~before)
        tile = max(1, SCORE_BYTES // (8 * max(len(met), 1)))
        for lo in range(0, len(walking) if len(met) else 0, tile):
            w = walking[lo:lo + tile]
            score = (asked[w] @ work[met].T).astype(np.int64)
            score[score < least[w][:, None]] = _NONE
            score[own[w][:, None] == met] = _NONE
            s, r = _merged((best[0][w], best[1][w]), score, met, ids, k)
            best[0][w], best[1][w] = s, r
        if seen.all():
            break
        bound = rising[walking] @ value[end - 1] + falling[walking] @ value[n - end]
        known = np.maximum(best[0][walking, k - 1], least[walking])
        walking = walking[bound >= known]
        depth, step = end, step * 2
    found = best[0] > _NONE
    return np.nonzero(found)[0], best[1][found], best[0][found]


def _meet(k: int):
    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "score"]
        if not len(queries) or not len(block):
            return pa.table({c: pa.array([], pa.int64()) for c in names})

        def matrix(t):
            return np.array(t.column("v").combine_chunks().flatten()).reshape(len(t), -1).astype(np.int64)
        v, row, ids = matrix(block), block.column("row").to_numpy(), block.column("id").to_numpy()
        order = np.argsort(row)
        q, qrow = matrix(queries), queries.column("row").to_numpy()
        at = order[np.minimum(np.searchsorted(row[order], qrow), len(row) - 1)]
        a, b, s = threshold_top_k(v, ids, q, k, np.where(row[at] == qrow, at, -1),
                                  queries.column("least").fill_null(_NONE).to_numpy())
        return pa.table({"query": pa.array(qrow[a]), "query_id": pa.array(queries.column("id").to_numpy()[a]),
                         "vec_id": pa.array(ids[b]), "score": pa.array(s)})
    return run


def top_k(table: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding", block_rows: int | None = None, query_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where the condition ``queries`` holds.

    ``queries`` is a column over ``id``; ids are long integers.  Blocks and
    chunks are sized by ``BLOCK_BYTES`` and ``CHUNK_BYTES`` unless given.
    """
    base = numbered_vectors(table, id_col, vector_col, scale).withColumn("dim", F.size("v"))
    asked = base.where(queries)
    n, width = base.agg(F.count(F.lit(1)), F.max("dim")).first()
    m = asked.count()
    width = max(width or 1, 1)
    # four arrays of eight bytes hold a block, and the sort doubles one of them
    block_rows = block_rows or min(max(1, BLOCK_BYTES // (40 * width)),
                                   max(LEAST_BLOCK, math.ceil(n / C.partitions(table.sparkSession))))
    query_rows = query_rows or max(1, CHUNK_BYTES // (24 * width))
    blocks, chunks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(m / query_rows))
    block, chunk = dealt(blocks), dealt(chunks)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query", "query_id", "vec_id", "score")])
    keys = ["dim", "block", "chunk"]
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")

    def met(asking: DataFrame, numbers: range) -> DataFrame:
        each = F.explode(F.sequence(F.lit(numbers[0]), F.lit(numbers[-1])))
        every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
        left = asking.select("dim", each.alias("block"), chunk.alias("chunk"), "id", "row", "least", "v")
        left = left.toDF(*left.columns)                      # own columns on each side
        right = (base.select("dim", block.alias("block"), "id", "row", "v").where(F.col("block") >= numbers[0])
                 .where(F.col("block") <= numbers[-1]).select("dim", "block", every.alias("chunk"), "id", "row", "v"))
        right = right.toDF(*right.columns)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(k), schema)

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    unknown = F.lit(None).cast("long").alias("least")
    if blocks == 1:
        found = met(asked.select("*", unknown), range(1))
    else:
        first = C.materialize(met(asked.select("*", unknown), range(1)), "first_block")
        known = (ranked(first).where(F.col("rank") == k)
                 .select(F.col("query").alias("row"), F.col("score").alias("least")))
        found = first.unionByName(met(asked.join(known, "row", "left"), range(1, blocks)))
    return ranked(found).select("query_id", "rank", "vec_id", "score")


def q_op4(spark, sf_dir):
    return top_k(C.read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES = {"op4_threshold_topk": q_op4}
ORACLE_SQL = {"op4_threshold_topk": """
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
s as (
  select q.row, q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.row <> c.row and len(q.v) = len(c.v)),
r as (select *, cast(row_number() over (partition by row order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""}
