"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents count as labelled; a sample of all training
documents is the unlabelled side, whatever their labels say.  A linear model
on word and word-prefix indicators minimises the non-negative PU risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

by full-batch gradient steps in numpy; where the second term is negative, the
step lifts it instead, which keeps the model from fitting the toxic sample by
heart.  The risk is over distinct texts: copies of one text count once, and the
class prior is the share of toxic texts among the labelled ones, so no weights
are needed.  Features are counted over the drawn texts, and over their copies as
far as distinct texts leave room.

Bounds: ``POSITIVES`` and ``UNLABELLED`` distinct texts and ``FEATURES``
features, drawn in the order of a hash of the text.  Scoring reads every whole
text.  An id labelled more than once, or a text of several ids, is toxic if one
of its labels says so.  Without
a toxic example every score is 0; an empty or null text has no indicator and
gets the model's bias.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm import common as C
from labelflow.llm import features as X

POSITIVES = 2000
UNLABELLED = 4000
FEATURES = 2048
STEPS = 300


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05,
          ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative PU risk with the logistic loss (Adam)."""
    prior = min(max(prior, 1e-3), 0.999)
    w, bias = np.zeros(positive.shape[1] + 1), np.log(prior / (1 - prior))
    w[-1] = bias
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp = positive @ w[:-1].astype(np.float32) + w[-1]
        zu = unlabelled @ w[:-1].astype(np.float32) + w[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        # loss of calling a row negative is log(1 + e^z), its slope sigmoid(z)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gu, gn = su / len(zu), -prior * sp / len(zp)
        if negative < 0:
            gp, gu = -gn, -gu                             # lift the negative part only
        else:
            gp = prior * (sp - 1) / len(zp) + gn
        grad = np.append(gp @ positive + gu @ unlabelled, gp.sum() + gu.sum())
        grad[:-1] += ridge * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w -= rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def _spread(texts: DataFrame, y: int, most: int) -> DataFrame:
    """(i, y, copies) of at most ``most`` rows of ``texts`` (key, n): every text once before any a second time."""
    order = [F.xxhash64("key", F.lit(y)), F.col("key")]
    some = texts.select("key", "n").orderBy(*order).limit(most)
    each = some.select("key", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(most)).cast("int"))).alias("c"))
    return (each.orderBy("c", *order).limit(most).groupBy(F.col("key").alias("i"))
            .agg(F.lit(y).alias("y"), F.count(F.lit(1)).cast("int").alias("copies")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", modulus: int = 5, held_out: int = 0) -> X.Linear:
    """Model learned from ids whose fold is not ``held_out``."""
    known = (labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).dropna()
             .where(C.fold("i", modulus) != held_out).groupBy("i").agg(F.max("y").alias("y")))
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = (docs.select(F.col(id_col).alias("i"), F.unhex(F.md5(body)).alias("key")).dropna()
            .where(C.fold("i", modulus) != held_out))
    # one row a text, whatever the number of its copies
    texts = C.materialize(rows.join(known, "i", "left").groupBy("key")
                          .agg(F.max("y").alias("y"), F.count(F.lit(1)).alias("n")), "toxicity_texts")
    prior = texts.where("y is not null").agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    if not prior:
        return X.constant(0.0)
    chosen = _spread(texts.where("y = 1"), 1, POSITIVES).unionByName(_spread(texts, 0, UNLABELLED))
    sample = X.draw(docs.select(F.unhex(F.md5(body)).alias("key"), body.alias("t")), chosen, "key", "t", "toxicity_sample")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.sum("copies").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return X.constant(0.0)
    repeated = sample.select("y", "t", F.explode(F.sequence(F.lit(1), "copies")))
    counts = X.feature_counts(repeated, X.word_prefixes, least=5)
    selected = X.select(counts, sizes[1], sizes[0], FEATURES)["f"]
    rows = X.indicators(sample, X.word_prefixes, selected).collect()
    matrix = np.zeros((len(rows), len(selected)), np.float32)
    for i, r in enumerate(rows):
        matrix[i, r.at] = 1
    y = np.array([r.y for r in rows])
    w, b = nn_pu(matrix[y == 1], matrix[y == 0], prior)
    return X.Linear(selected, w, b)


def q_op3(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents")
    model = fit(docs, C.read(spark, sf_dir, "labels"))
    return X.score(docs, model, X.word_prefixes).select(
        "doc_id", (C.fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``least``, with all their columns."""
    name = "toxicity score of " + "_".join(docs.columns)     # no column's name
    scored = X.score(docs, fit(docs, labels), X.word_prefixes, columns=tuple(docs.columns), name=name)
    return scored.where(F.col(f"`{name}`") < least).drop(name)


QUERIES = {"op3_pu_toxicity": q_op3}
ORACLE_SQL: dict[str, str] = {}
