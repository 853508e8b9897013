"""Few-shot evaluation plans over an embedded labelled table.

The reference's similarity pipeline (exemplars per class -> embed -> top-n
cosine per test row -> closest option -> category -> report) becomes:
exemplar window -> broadcast-checked exemplar matrix -> per-batch BLAS top-n
-> native report aggregates.  No per-row loop, no driver-side scoring.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from labelflow.functions.hashing import DEFAULT_SEED
from labelflow.operators.joins import bounded_broadcast, shuffled
from labelflow.operators.metrics import classification_report
from labelflow.operators.sampling import top_k_per_group
from labelflow.operators.similarity import similarity_topn
from labelflow.session import cut_lineage, written


def split_exemplars(df: DataFrame, id_col: str, class_col: str, n: int,
                    seed=DEFAULT_SEED) -> tuple[DataFrame, DataFrame]:
    """(exemplars, queries): ``n`` rows per class in hash order are the
    exemplars; every other row is a query.

    The ranking reads only (class, id); the chosen ids (n per class) and then
    the exemplar rows are written into the shared checkpoint folder, so the
    later size check, broadcast and anti join read those small tables instead
    of rescanning the vectors."""
    ids = bounded_broadcast(top_k_per_group(df.select(class_col, id_col), class_col, n, id_col, seed)
                            .select(id_col))
    ex = cut_lineage(df.join(ids, id_col, "left_semi"))
    queries = df.join(ids, id_col, "left_anti")
    return ex, queries


def nearest_exemplar_classify(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                              class_col: str = "label", n_exemplars: int = 5,
                              seed=DEFAULT_SEED) -> DataFrame:
    """Similarity-only classification: the nearest exemplar's class is the
    prediction.  Returns ``(id, y, prediction, sim)`` with string labels."""
    ex, queries = split_exemplars(df, id_col, class_col, n_exemplars, seed)
    ex = ex.select(F.col(id_col).alias("exemplar_id"), F.col(vec_col).alias("embedding"),
                   F.col(class_col).cast("string").alias("category"))
    q = queries.select(id_col, F.col(vec_col).alias("embedding"),
                       F.col(class_col).cast("string").alias("y"))
    top = similarity_topn(q, ex, 1, q_id=id_col, e_payload=("category",), q_payload=("y",))
    return top.select(id_col, "y", F.col("category").alias("prediction"), "sim")


def flagship_report(df: DataFrame, **kw) -> DataFrame:
    """Nearest-exemplar classification followed by the classification report."""
    return classification_report(nearest_exemplar_classify(df, **kw), "y", "prediction")


# --------------------------------------------------------------------------
# retrieval-augmented prompting and few-shot evaluation
# --------------------------------------------------------------------------
from labelflow.functions.prompts import build_prompt  # noqa: E402
from labelflow.functions.text import extract_class_name  # noqa: E402
from labelflow.operators.closest import LabelIndex  # noqa: E402
from labelflow.operators.embed import embed_text  # noqa: E402
from labelflow.operators.matching import closest_label, option_to_category  # noqa: E402
from labelflow.operators.options import prompt_options_topn  # noqa: E402
from labelflow.operators.sampling import label_index  # noqa: E402


def embed_vectors(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, embedding)`` of texts by hashed trigrams; any encoder of the same shape can stand in."""
    return embed_text(df, id_col, text_col)


def class_names(df: DataFrame, class_col: str) -> DataFrame:
    """``(exemplar_id, category)``: the classes numbered from 0 in order."""
    named = df.select(F.col(class_col).cast("string").alias("category"))
    return label_index(named, "category", base=0, name="exemplar_id").withColumnRenamed("label", "category")


def class_exemplars(df: DataFrame, class_col: str, embed=embed_vectors) -> DataFrame:
    """One exemplar per class, whose text and vector are those of the class name itself."""
    names = written(class_names(df, class_col), "classes")
    vectors = embed(names, "exemplar_id", "category")
    vec = next(c for c in vectors.columns if c != "exemplar_id")
    return (names.join(vectors, "exemplar_id")
                 .select("exemplar_id", F.col(vec).alias("embedding"), F.col("category").alias("option_text"), "category"))


def retrieve(df: DataFrame, id_col: str, vec_col: str, class_col: str, text_col: str | None,
             n_shot: int, top_n: int, seed=DEFAULT_SEED,
             test: DataFrame | None = None, embed=embed_vectors) -> tuple[DataFrame, DataFrame]:
    """(ranked options per query, queries).

    The exemplars come from ``df``; the queries are the rows of ``test`` (same
    columns), or without it the rows of ``df`` that are no exemplars.

    ``n_shot`` exemplars per class; with ``n_shot == 0`` one option per class,
    the class name with its own vector (by ``embed``, the encoder of
    ``vec_col``), and every row is a query.  Each query gets its ``top_n`` most
    similar exemplars as options ``(id, rnk, exemplar_id, sim, option_text,
    category)``.  The ranked options are written: scores are computed once,
    whatever reads them.
    """
    if n_shot == 0:
        ex, queries = class_exemplars(df, class_col, embed), df
    else:
        ex, queries = split_exemplars(df, id_col, class_col, n_shot, seed)
        text = F.col(class_col).cast("string") if text_col is None else F.col(text_col)
        ex = ex.select(F.col(id_col).alias("exemplar_id"), F.col(vec_col).alias("embedding"),
                       text.alias("option_text"), F.col(class_col).cast("string").alias("category"))
    queries = queries if test is None else test
    q = queries.select(id_col, F.col(vec_col).alias("embedding"))
    ranked = similarity_topn(q, ex, top_n, q_id=id_col, e_payload=("option_text", "category"))
    return written(ranked, "ranked"), queries


def retrieve_then_prompt(df: DataFrame, id_col: str, vec_col: str, class_col: str,
                         query_text, text_col: str | None = None, n_shot: int = 5,
                         top_n: int = 5, test: DataFrame | None = None, embed=embed_vectors) -> DataFrame:
    """Per query: the ``Options:`` block of its retrieved exemplars and the
    prompt built from it: ``(id, prompt_options, prompt)``."""
    ranked, queries = retrieve(df, id_col, vec_col, class_col, text_col, n_shot, top_n, test=test, embed=embed)
    opts = prompt_options_topn(ranked, id_col, "rnk", "option_text")
    qt = queries.select(id_col, query_text.alias("_qt"))
    return (qt.join(shuffled(opts), id_col)
              .select(id_col, "prompt_options",
                      build_prompt("_qt", "prompt_options", no_company_specific=True).alias("prompt")))


def with_vectors(df: DataFrame, id_col: str, text_col: str, embed=embed_vectors) -> DataFrame:
    """``df`` with the vector of its text as ``embedding``, written (texts are encoded once)."""
    vectors = embed(df.select(id_col, text_col), id_col, text_col)
    vec = next(c for c in vectors.columns if c != id_col)
    return written(df.join(shuffled(vectors.select(id_col, F.col(vec).alias("embedding"))), id_col), "vectors")


def vote_scorer(ranked: DataFrame, id_col: str) -> DataFrame:
    """Offline scorer over retrieved options: the option text chosen by most
    of the retrieved exemplars (ties: the best-ranked one), answered as the
    model would: ``'Class name: <text>'``."""
    votes = ranked.groupBy(id_col, "option_text").agg(F.count(F.lit(1)).alias("_v"),
                                                       F.min("rnk").alias("_r"))
    best = votes.groupBy(id_col).agg(F.min(F.struct((-F.col("_v")).alias("v"), F.col("_r").alias("r"),
                                                    F.col("option_text").alias("t"))).alias("_b"))
    return best.select(id_col, F.concat(F.lit("Class name: "), F.col("_b.t")).alias("raw_prediction"))


def fewshot_evaluate(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                     class_col: str = "label", text_col: str | None = None, n_shot: int = 5,
                     top_n: int = 5, predictions: DataFrame | None = None,
                     seed=DEFAULT_SEED, test: DataFrame | None = None,
                     embed=embed_vectors) -> tuple[DataFrame, DataFrame]:
    """(scored rows, report of the few-shot labels).

    Retrieve ``top_n`` exemplars per query (a row of ``test``, or without it
    a row of ``df`` that is no exemplar), obtain a raw prediction (from
    ``predictions`` = ``(id, raw_prediction)`` produced by any scorer over
    the prompts, or from :func:`vote_scorer`), snap the lower-cased
    prediction onto the row's lower-cased options, map the chosen option to
    its category (first in rank order) and report ``y`` against it.

    The scored rows hold ``y, raw_prediction, prediction,
    original_prediction, v_pred, few_shot, resolved_label``; the other
    reports come from :func:`fewshot_reports`.
    """
    ranked, queries = retrieve(df, id_col, vec_col, class_col, text_col, n_shot, top_n, seed, test, embed)
    raw = predictions if predictions is not None else vote_scorer(ranked, id_col)
    opts = ranked.groupBy(id_col).agg(F.collect_list(F.lower("option_text")).alias("_opts"))
    scored = _with_raw(queries, id_col, class_col, raw).join(shuffled(opts), id_col)
    # exact option hits settle most rows natively; the rest use stdlib difflib.
    # Spark evaluates a Python UDF on every row whatever CASE branch holds it,
    # so hits are handed over as null and skipped inside the batch
    hit = F.array_contains("_opts", F.col("original_prediction"))

    @F.pandas_udf(T.StringType())
    def nearest(words: pd.Series, options: pd.Series) -> pd.Series:
        return pd.Series([LabelIndex(sorted(set(o))).best(w)[1] if w is not None and len(o) else None
                          for w, o in zip(words, options)])

    miss_word = F.when(~hit, F.col("original_prediction"))
    scored = scored.withColumn("v_pred", F.when(hit, F.col("original_prediction"))
                               .otherwise(nearest(miss_word, "_opts"))).drop("_opts")
    resolved = option_to_category(scored, ranked, id_col, "v_pred", "option_text", "category",
                                  out_col="few_shot")
    # a class name stands as it is, the class of an example text in lower case
    label = F.col("few_shot") if n_shot == 0 else F.lower("few_shot")
    resolved = resolved.withColumn("resolved_label", label)
    return resolved, classification_report(resolved, "y", "resolved_label")


def _with_raw(queries: DataFrame, id_col: str, class_col: str, raw: DataFrame) -> DataFrame:
    return _raw_columns(queries.select(id_col, class_col).join(shuffled(raw.select(id_col, "raw_prediction")), id_col),
                        id_col, class_col)


def _raw_columns(answered: DataFrame, id_col: str, class_col: str, *more: str) -> DataFrame:
    return answered.select(id_col, *more, F.lower(F.col(class_col).cast("string")).alias("y"), "raw_prediction",
                           F.lower("raw_prediction").alias("prediction"),
                           extract_class_name("raw_prediction").alias("original_prediction"))


def categories_evaluate(df: DataFrame, id_col: str, class_col: str, text_col: str,
                        predict, test: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Few-shot evaluation without retrieval: (scored rows, report of the few-shot labels).

    Every class is an option of every prompt, by its name, in order.  The option
    block is one row.  ``predict`` gets the rows of ``test`` (or ``df``) with
    their ``prompt`` and adds ``raw_prediction``; predictions are snapped onto
    the class names by :func:`closest_label`, and a name gives back the first
    class that is written so.
    """
    names = written(class_names(df, class_col), "classes")
    block = prompt_options_topn(names.withColumn("_g", F.lit(1)), "_g", "exemplar_id", "category")
    rows = df if test is None else test
    prompted = (rows.withColumn("_g", F.lit(1)).join(F.broadcast(block), "_g").drop("_g")        # one row
                    .withColumn("prompt", build_prompt(text_col, "prompt_options", no_company_specific=True)))
    # the answers are written: the model runs once, whatever reads them
    scored = written(_raw_columns(predict(prompted), id_col, class_col, "prompt"), "answers")
    snapped = closest_label(scored, "original_prediction", names, "category", out_col="v_pred")
    first = names.groupBy(F.lower("category").alias("_low")).agg(F.min("category").alias("few_shot"))
    resolved = (snapped.join(bounded_broadcast(first), F.col("v_pred") == F.col("_low"), "left").drop("_low")
                       .withColumn("resolved_label", F.col("few_shot")))
    return resolved, classification_report(resolved, "y", "resolved_label")


def fewshot_reports(scored: DataFrame) -> DataFrame:
    """The three reports of one evaluation, told apart by ``prediction_kind``: the raw
    predictions, those snapped onto an option, and the options' classes.

    One aggregate counts the (y, prediction) pairs of all three kinds."""
    kinds = (("prediction", "prediction"), ("v_pred", "v_pred"), ("few_shot", "resolved_label"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("label")) for k, c in kinds]))
    rows = scored.select("y", each.alias("_e")).select("y", F.col("_e.kind").alias("prediction_kind"),
                                                       F.col("_e.label").alias("label"))
    return classification_report(rows, "y", "label", by=("prediction_kind",))
