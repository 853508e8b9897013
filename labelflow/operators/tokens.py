"""Token-length profile of texts against model input and target limits.

Re-aimed from a subword tokenizer to whitespace tokens.  The first aggregate is
a histogram, rows per (group, length): partial histograms merge by addition, and
everything else, the exact percentiles too, follows from it by cumulated counts.
A group of any size leaves one row per distinct length.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Input limits 512 and 320, target limit 40.
INPUT_LIMITS = (320, 512)
TARGET_LIMIT = 40
PERCENTILES = ("0.5", "0.95", "0.99")


def token_count(col) -> Column:
    """Number of whitespace tokens; a null text has none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def length_histogram(df: DataFrame, text_col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., tokens, m): rows per token count; histograms of parts add up."""
    return (df.select(*by, token_count(text_col).alias("tokens"))
              .groupBy(*by, "tokens").agg(F.count(F.lit(1)).alias("m")))


def token_profile(df: DataFrame, text_col: str, by: Sequence[str] = (),
                  limits: Sequence[int] = INPUT_LIMITS, percentiles: Sequence[str] = PERCENTILES,
                  cut_at: int | None = None) -> DataFrame:
    """Rows, longest text, percentiles (``p50``: the smallest length that half of
    the rows do not exceed) and how many texts exceed each limit, per group; with
    ``cut_at`` also the tokens kept when texts are cut there, and all tokens."""
    return profile_of(length_histogram(df, text_col, by), by, limits, percentiles, cut_at)


def profile_of(histogram: DataFrame, by: Sequence[str] = (), limits: Sequence[int] = INPUT_LIMITS,
               percentiles: Sequence[str] = PERCENTILES, cut_at: int | None = None) -> DataFrame:
    """:func:`token_profile` from a histogram."""
    t, m = F.col("tokens"), F.col("m")
    group = Window.partitionBy(*by)
    upto = group.orderBy("tokens").rowsBetween(Window.unboundedPreceding, 0)
    cum = (histogram.withColumn("_upto", F.sum("m").over(upto))
                    .withColumn("_all", F.sum("m").over(group.rowsBetween(Window.unboundedPreceding,
                                                                          Window.unboundedFollowing))))
    aggs = [F.sum(m).alias("n"), F.max(t).alias("max_tokens")]
    for p in percentiles:
        least = F.ceil(F.col("_all") * F.lit(Decimal(p)))
        aggs.append(F.min(F.when(F.col("_upto") >= least, t)).alias(f"p{int(Decimal(p) * 100)}"))
    aggs += [F.coalesce(F.sum(F.when(t > lim, m)), F.lit(0)).cast("bigint").alias(f"n_over_{lim}") for lim in limits]
    if cut_at is not None:
        aggs += [F.sum(F.least(t, F.lit(cut_at)) * m).cast("bigint").alias("kept_tokens"),
                 F.sum(t * m).cast("bigint").alias("all_tokens")]
    return cum.groupBy(*by).agg(*aggs)


def truncate_tokens(col, limit: int) -> Column:
    """The first ``limit`` whitespace tokens joined by one space."""
    c = F.col(col) if isinstance(col, str) else col
    toks = F.filter(F.split(c, r"\s+"), lambda x: x != F.lit(""))
    return F.array_join(F.slice(toks, 1, limit), " ")
