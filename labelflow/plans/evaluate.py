"""Taxonomy evaluation: dedup -> map -> option list -> (extract) -> prompt ->
predict -> clean -> (relabel) -> report, errors and prediction counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.functions.prompts import build_prompt, entity_prompt
from labelflow.functions.text import strip_class_prefix
from labelflow.operators.joins import bounded_broadcast
from labelflow.operators.metrics import classification_report, error_rows, value_counts
from labelflow.operators.options import prompt_options_expanded, prompt_options_taxonomy
from labelflow.operators.sampling import dedup_first
from labelflow.session import written
from labelflow.sources.taxonomy import map_labels


def taxonomy_evaluate(df: DataFrame, id_col: str, text_col: str, label_col: str,
                      taxonomy: DataFrame, predict: Callable[[DataFrame], DataFrame],
                      use_default_labels: bool = False, lower: bool = False,
                      no_number_prompt: bool = False, expansion: DataFrame | None = None,
                      extract: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Evaluate a model over a labelled table against a taxonomy.

    Rows whose label is not in the taxonomy are skipped; among the rest the
    first row of each exact text is kept.  The option block lists the mapped
    labels present (sorted by key), every row gets the no-company prompt,
    ``predict`` adds ``raw_prediction``; the ``Class name: `` prefix is
    removed; ``y`` is the mapped name (or the raw key with
    ``use_default_labels``); ``lower`` lower-cases both sides.

    ``expansion`` (``key, names``) lists more accepted names of a label: the
    option block shows them in place of the label, both sides are lower-cased,
    and a prediction that equals one of its label's names becomes ``y``.

    ``extract`` gets the rows with their extraction prompt in ``prompt`` and adds
    ``extracted``; that text goes into the classification prompt and stays as
    ``text_col``, the text itself stays as ``original``.  Duplicates are told by
    the original text.

    Returns ``{"predictions", "report", "errors", "counts"}``.  The predictions
    are written once; the other three read them.
    """
    mapped = map_labels(df, label_col, taxonomy, out_col="_label", keep_original=None)
    rows = dedup_first(mapped, text_col, id_col)
    present = mapped.select(F.col(label_col).cast("string").alias("key"))
    bullet = "#" if no_number_prompt else None
    if expansion is None:
        opts = prompt_options_taxonomy(present, taxonomy, bullet=bullet, use_default_labels=use_default_labels)
    else:
        opts = prompt_options_expanded(present, taxonomy, expansion, bullet=bullet,
                                       use_default_labels=use_default_labels)
        lower = True
    if extract is not None:
        rows = (extract(rows.withColumn("original", F.col(text_col)).withColumn("prompt", entity_prompt(text_col)))
                .withColumn(text_col, F.col("extracted")).drop("extracted", "prompt"))
    # one option block for all rows: equi-join on a constant key (1-row side)
    rows = (rows.withColumn("_g", F.lit(1))
                .join(F.broadcast(opts.withColumn("_g", F.lit(1))), "_g").drop("_g")
                .withColumn("prompt", build_prompt(text_col, "prompt_options",
                                                   no_company_specific=True)))
    scored = predict(rows)
    y = F.col(label_col).cast("string") if use_default_labels else F.col("_label")
    pred = strip_class_prefix("raw_prediction")
    if lower:
        y, pred = F.lower(y), F.lower(pred)
    out = scored.withColumn("prediction", pred)
    if expansion is not None:
        names = expansion.select(F.col("key").cast("string").alias("_key"),
                                 F.transform("names", F.lower).alias("_names"))
        out = out.join(bounded_broadcast(names), F.col(label_col).cast("string") == F.col("_key"), "left")
        accepted = F.coalesce(F.array_contains("_names", F.col("prediction")), F.lit(False))
        y = F.when(accepted, F.col("prediction")).otherwise(y)
    out = written(out.withColumn("y", y).drop("_label", "_key", "_names"), "predictions")
    return {"predictions": out,
            "report": classification_report(out, "y", "prediction"),
            "errors": error_rows(out),
            "counts": value_counts(out, "prediction")}


class PromptDigestScorer:
    """Offline stand-in for a model that reads its prompt: it answers with one of the
    options listed there, picked by the prompt's digest.  With ``cut`` the
    answers to prompts of an odd digest lack their first character."""

    def __init__(self, cut: bool = False):
        self.cut = cut

    def predict(self, prompts: list[str | None]) -> list[str | None]:
        from hashlib import md5

        out = []
        for p in prompts:
            if p is None:
                out.append(None)
                continue
            block = p.rpartition("customer's issue.\n")[2].removesuffix("\nClass name: ")
            options = []
            for x in block.split("\n")[1:]:
                if "#" in x[:2]:                              # bullets, or the closing line of several
                    options += [o.strip() for o in x.split("#") if o.strip()]
                elif x.strip():                               # " 1. name "
                    options.append(x.split(" ", 2)[-1].strip())
            pick = int(md5(p.encode()).hexdigest()[:8], 16)
            name = options[pick % len(options)] if options else ""
            out.append("Class name: " + (name[1:] if self.cut and pick % 2 else name))
        return out
