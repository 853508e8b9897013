"""Corpus BLEU (Papineni et al. 2002) with the defaults of the common
reference scorer (Post 2018): mteval-13a tokenisation, n-gram orders 1-4,
one reference per hypothesis, exponential smoothing of zero-match orders.

Distributed shape: texts are tokenised natively.  Where every id is one row,
Arrow batches of token lists count their n-grams on both sides (clipping = min
of the two counts), so no n-gram becomes a row.  Where ids may repeat, every
(id, order, gram) is counted in one aggregate instead.  A single global
aggregate produces eight numbers plus the two lengths, and the score is a
closed formula over that one row.  Nothing is collected to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ORDER = 4
DIGITS = 6

# Mteval-13a tokenisation rules, applied in this order.
SKIPPED = "<skipped>"
UNESCAPE = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
RULES = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize_13a(col) -> Column:
    """Array of 13a tokens (case kept)."""
    x = F.replace(_c(col), F.lit(SKIPPED), F.lit(""))
    x = F.replace(x, F.lit("-\n"), F.lit(""))
    x = F.replace(x, F.lit("\n"), F.lit(" "))
    for a, b in UNESCAPE:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for pattern, repl in RULES:
        x = F.regexp_replace(x, pattern, repl)
    return F.filter(F.split(x, r"\s+"), lambda t: t != F.lit(""))


def ngrams(tokens, max_order: int = MAX_ORDER) -> Column:
    """array<struct<n, gram>> of all n-grams of orders 1..max_order."""
    t = _c(tokens)

    def gram_at(n):
        # one-argument lambda: transform() treats two-argument lambdas as
        # (element, index)
        return lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(t, i, n), " ").alias("gram"))

    per_order = []
    for n in range(1, max_order + 1):
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), gram_at(n))
        per_order.append(F.when(F.size(t) >= n, grams).otherwise(
            F.array().cast("array<struct<n:int,gram:string>>")))
    return F.concat(*per_order)


# Tokens that are counted at once (a longer row is counted alone).
SLICE_TOKENS = 1 << 20
STATS = [f"{kind}_{k}" for k in range(1, MAX_ORDER + 1) for kind in ("correct", "total")] + ["sys_len", "ref_len"]


def _count_slice(hyp, ref) -> list[int]:
    """The ``STATS`` of two Arrow arrays of token lists, row by row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = [pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (hyp, ref)]
    n = int(sizes[0].sum())
    words = pa.chunked_array([hyp.flatten(), ref.flatten()]).combine_chunks().dictionary_encode()
    code, base = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(words.dictionary))
    row = np.concatenate([np.repeat(np.arange(len(s)), s) for s in sizes])
    ends = np.concatenate([np.cumsum(sizes[0]), n + np.cumsum(sizes[1])])
    room = np.repeat(ends, np.concatenate(sizes)) - np.arange(len(code))    # tokens from here to the row's end
    out, gram, at = [], row, np.arange(len(code))
    for k in range(1, MAX_ORDER + 1):
        on = room[at] >= k
        gram, at = gram[on], at[on]
        # grams of one row that share the first k - 1 tokens have one number
        gram = np.unique(gram * base + code[at + k - 1], return_inverse=True)[1]
        own = int(np.searchsorted(at, n))
        h, r = (np.bincount(x, minlength=int(gram.max(initial=-1)) + 1) for x in (gram[:own], gram[own:]))
        out += [int(np.minimum(h, r).sum()), own]
    return [*out, n, len(code) - n]


def _row_stats(df: DataFrame, hyp_col: str, ref_col: str) -> DataFrame:
    """Rows of ``STATS`` that add up to those of all rows of ``df``."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names, slice_tokens = list(STATS), SLICE_TOKENS

    def run(batches):
        for b in batches:
            hyp, ref = b.column(0), b.column(1)
            upto = sum(np.cumsum(pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                       for x in (hyp, ref))
            lo = 0
            while lo < len(b):
                base = upto[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(upto, base + slice_tokens, "right")))
                found = _count_slice(hyp.slice(lo, hi - lo), ref.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in found], names)
                lo = hi

    tok = df.select(tokenize_13a(hyp_col).alias("_h"), tokenize_13a(ref_col).alias("_r"))
    return tok.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def bleu_stats(df: DataFrame, hyp_col: str, ref_col: str, id_col: str,
               clustered_by: tuple[str, ...] = (), distinct_ids: bool = False) -> DataFrame:
    """One row: ``correct_1..4, total_1..4, sys_len, ref_len``.

    With ``distinct_ids`` no two rows of ``df`` share an id: each row's n-grams
    are counted where the row is, and nothing is exploded or shuffled.  Without
    it the n-grams of rows that share an id count together.

    ``clustered_by`` names columns ``df`` is already hash-partitioned by
    (e.g. the key of the window that paired hypotheses with references).
    They join the per-row grouping keys, so the n-gram counts aggregate in
    the same stage instead of shuffling every distinct n-gram."""
    if distinct_ids:
        rows = _row_stats(df, hyp_col, ref_col)
        return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in STATS])
    keys = [*clustered_by, "_rid"]
    tok = df.select(*clustered_by, F.col(id_col).alias("_rid"), tokenize_13a(hyp_col).alias("_h"),
                    tokenize_13a(ref_col).alias("_r"))
    # one array per row -- lengths, hypothesis grams, reference grams -- and
    # one explode, so the input (and any window above it) is evaluated once
    item = "struct<n:int,gram:string,h:bigint,r:bigint>"

    def tagged(col, h, r):
        return F.transform(ngrams(col), lambda g: F.struct(
            g["n"].alias("n"), g["gram"].alias("gram"), F.lit(h).cast("bigint").alias("h"),
            F.lit(r).cast("bigint").alias("r")))

    lens = F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("gram"),
                            F.size("_h").cast("bigint").alias("h"), F.size("_r").cast("bigint").alias("r")))
    rows = F.concat(lens.cast(f"array<{item}>"), tagged("_h", 1, 0), tagged("_r", 0, 1))
    counts = (tok.select(*keys, F.explode(rows).alias("g"))
                 .select(*keys, "g.n", "g.gram", "g.h", "g.r")
                 .groupBy(*keys, "n", "gram").agg(F.sum("h").alias("h"), F.sum("r").alias("r")))
    n = F.col("n")
    aggs = []
    for k in range(1, MAX_ORDER + 1):
        aggs.append(F.coalesce(F.sum(F.when(n == k, F.least("h", "r"))), F.lit(0)).cast("bigint")
                    .alias(f"correct_{k}"))
        aggs.append(F.coalesce(F.sum(F.when(n == k, F.col("h"))), F.lit(0)).cast("bigint")
                    .alias(f"total_{k}"))
    aggs.append(F.coalesce(F.sum(F.when(n == 0, F.col("h"))), F.lit(0)).cast("bigint").alias("sys_len"))
    aggs.append(F.coalesce(F.sum(F.when(n == 0, F.col("r"))), F.lit(0)).cast("bigint").alias("ref_len"))
    return counts.agg(*aggs)


def bleu_from_stats(stats: DataFrame) -> DataFrame:
    """``score, bp, sys_len, ref_len, p1..p4`` from :func:`bleu_stats`."""
    sys_len, ref_len = F.col("sys_len"), F.col("ref_len")
    bp = F.when(sys_len < ref_len,
                F.when(sys_len > 0, F.exp(1 - ref_len / sys_len)).otherwise(F.lit(0.0))
                ).otherwise(F.lit(1.0))
    any_correct = sum((F.col(f"correct_{k}") for k in range(1, MAX_ORDER + 1)), F.lit(0)) > 0
    precisions, zeros = [], F.lit(0)
    for k in range(1, MAX_ORDER + 1):
        c, t = F.col(f"correct_{k}"), F.col(f"total_{k}")
        zeros = zeros + F.when((t > 0) & (c == 0), 1).otherwise(0)
        p = (F.when(~any_correct | (t == 0), F.lit(0.0))
              .when(c == 0, F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * t))
              .otherwise(F.lit(100.0) * c / t))
        precisions.append(p)
    all_pos = precisions[0] > 0
    for p in precisions[1:]:
        all_pos = all_pos & (p > 0)
    mean_log = sum((F.log(F.when(p > 0, p)) for p in precisions), F.lit(0.0)) / MAX_ORDER
    score = F.when(any_correct & all_pos, bp * F.exp(mean_log)).otherwise(F.lit(0.0))
    return stats.select(F.round(score, DIGITS).alias("score"), F.round(bp, DIGITS).alias("bp"),
                        "sys_len", "ref_len",
                        *[F.round(p, DIGITS).alias(f"p{k}") for k, p in enumerate(precisions, 1)])


def corpus_bleu(df: DataFrame, hyp_col: str, ref_col: str, id_col: str,
                clustered_by: tuple[str, ...] = (), distinct_ids: bool = False) -> DataFrame:
    """Corpus BLEU of hypotheses against single references (one-row result)."""
    return bleu_from_stats(bleu_stats(df, hyp_col, ref_col, id_col, clustered_by, distinct_ids))
