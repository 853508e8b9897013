"""Evaluation operators: confusion table, classification report and the
projections the reference reads from it (weighted P/R/F1, accuracy,
leaderboard), plus frequency tables and error rows.

Everything starts from one ``groupBy(y, prediction)`` aggregate.  That
aggregate combines map-side, so the shuffle carries at most one row per
(label, prediction) pair per task, whatever the size of the scored table.
The report itself is then computed on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REPORT_COLUMNS = ("id", "precision", "recall", "f1_score", "support")
SUMMARY_ROWS = ("accuracy", "macro avg", "weighted avg")
DIGITS = 6


def _ratio(num, den):
    """num / den, 0 when the denominator is 0 (the reference's zero_division)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "prediction",
                     by: Sequence[str] = ()) -> DataFrame:
    """(by..., y, prediction, n): one row per observed (label, prediction)."""
    return (df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("prediction"))
              .agg(F.count(F.lit(1)).alias("n")))


def label_stats(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per label of the union of true and predicted labels: tp, support,
    predicted.  One pass over the confusion table: every cell contributes to
    its true label and to its predicted label."""
    n = F.col("n")
    cell = F.explode(F.array(
        F.struct(F.col("y").alias("id"), n.alias("support"),
                 F.when(F.col("y") == F.col("prediction"), n).otherwise(F.lit(0)).alias("tp"),
                 F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("prediction").alias("id"), F.lit(0).cast("bigint").alias("support"),
                 F.lit(0).cast("bigint").alias("tp"), n.alias("predicted")),
    )).alias("c")
    return (confusion.select(*by, cell)
            .groupBy(*by, F.col("c.id").alias("id"))
            .agg(F.sum("c.support").alias("support"), F.sum("c.tp").alias("tp"),
                 F.sum("c.predicted").alias("predicted")))


def report_parts(df: DataFrame, y: str = "y", pred: str = "prediction",
                 by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(per label, summary): the labels' figures and, per ``by`` group, one row
    with n, accuracy (acc), macro (m*) and weighted (w*) averages, unrounded.
    Kept apart, a label may be called ``accuracy`` or ``weighted avg``."""
    stats = label_stats(confusion_matrix(df, y, pred, by), by)
    tp, sup, prd = F.col("tp"), F.col("support"), F.col("predicted")
    per_label = stats.select(
        *by, "id",
        _ratio(tp, prd).alias("precision"),
        _ratio(tp, sup).alias("recall"),
        _ratio(2 * tp, sup + prd).alias("f1_score"),
        sup.alias("support"), tp.alias("tp"))
    total = F.sum("support")
    summary = per_label.groupBy(*by).agg(
        total.alias("n"),
        _ratio(F.sum("tp"), total).alias("acc"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        _ratio(F.sum(F.col("precision") * F.col("support")), total).alias("wp"),
        _ratio(F.sum(F.col("recall") * F.col("support")), total).alias("wr"),
        _ratio(F.sum(F.col("f1_score") * F.col("support")), total).alias("wf"),
    )
    return per_label, summary


def classification_report(df: DataFrame, y: str = "y", pred: str = "prediction",
                          by: Sequence[str] = (), digits: int = DIGITS, kind_col: str | None = None) -> DataFrame:
    """Per-label precision / recall / F1 / support followed by the rows
    ``accuracy``, ``macro avg`` and ``weighted avg``, per ``by`` group.

    Labels are the union of true and predicted values; undefined ratios are 0.
    The accuracy row repeats the accuracy in precision, recall and f1_score and
    carries the row count as support.  ``kind_col`` adds a column that tells
    ``label`` from ``summary`` rows, should a label bear a summary row's name.
    """
    per_label, summary = report_parts(df, y, pred, by)

    def row(name, p, r, f):
        return F.struct(F.lit(name).alias("id"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                        F.col(f).alias("f1_score"), F.col("n").alias("support"))

    rows = F.explode(F.array(row("accuracy", "acc", "acc", "acc"), row("macro avg", "mp", "mr", "mf"),
                             row("weighted avg", "wp", "wr", "wf"))).alias("r")
    summary_rows = summary.select(*by, rows).select(*by, "r.*").withColumn("_kind", F.lit("summary"))
    out = per_label.drop("tp").withColumn("_kind", F.lit("label")).unionByName(summary_rows)
    return out.select(*by, "id",
                      *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1_score")],
                      F.col("support").cast("bigint").alias("support"),
                      *([F.col("_kind").alias(kind_col)] if kind_col else []))


def report_per_dataset(df: DataFrame, y: str = "y", pred: str = "prediction",
                       dataset_col: str = "dataset_name") -> DataFrame:
    """One report per dataset: the dataset is just another grouping key."""
    return classification_report(df, y, pred, by=(dataset_col,))


def weighted_prf(df: DataFrame, y: str = "y", pred: str = "prediction",
                 by: Sequence[str] = ()) -> DataFrame:
    """Weighted precision, recall and F1 (the ``weighted avg`` row)."""
    _, summary = report_parts(df, y, pred, by)
    return summary.select(*by, F.round("wp", DIGITS).alias("precision"), F.round("wr", DIGITS).alias("recall"),
                          F.round("wf", DIGITS).alias("f1"))


def accuracy(df: DataFrame, y: str = "y", pred: str = "prediction",
             by: Sequence[str] = (), digits: int = DIGITS) -> DataFrame:
    """Share of rows whose prediction equals the label (one partial aggregate)."""
    hit = F.col(y).eqNullSafe(F.col(pred)).cast("double")
    return df.groupBy(*by).agg(F.round(F.avg(hit), digits).alias("accuracy"))


def prefix_metrics(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prefix every metric column name (``val_`` in the trainer)."""
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def leaderboard(df: DataFrame, y: str = "y", pred: str = "prediction",
                dataset_col: str = "dataset_name", model_col: str = "model_name") -> DataFrame:
    """Weighted F1 and accuracy per (dataset, model), ranked inside each
    dataset by F1 descending, model name ascending."""
    _, summary = report_parts(df, y, pred, by=(dataset_col, model_col))
    wide = summary.select(dataset_col, model_col, F.round("wf", DIGITS).alias("weighted_f1"),
                          F.round("acc", DIGITS).alias("accuracy"))
    w = Window.partitionBy(dataset_col).orderBy(F.col("weighted_f1").desc(), F.col(model_col).asc())
    return wide.withColumn("rnk", F.rank().over(w).cast("bigint"))


def value_counts(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Frequency of each value, most frequent first (ties: value ascending)."""
    name = name or col
    return (df.groupBy(F.col(col).alias(name)).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col(name).asc()))


def distinct_labels(df: DataFrame, col: str, name: str = "label") -> DataFrame:
    """Sorted distinct labels."""
    return df.select(F.col(col).alias(name)).distinct().orderBy(name)


def error_rows(df: DataFrame, y: str = "y", pred: str = "prediction") -> DataFrame:
    """Rows whose prediction differs from the label (case-sensitive, null-safe)."""
    return df.filter(~F.col(y).eqNullSafe(F.col(pred)))


def parse_failure_count(df: DataFrame, parsed_col: str) -> DataFrame:
    """How many rows parsed and how many were dropped as unparseable."""
    ok = F.col(parsed_col).isNotNull()
    return df.agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"))
