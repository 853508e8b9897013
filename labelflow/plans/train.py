"""Supervised text classifier baseline with Spark ML.

Re-aimed from fine-tuning a sequence model: ``RegexTokenizer -> HashingTF ->
IDF -> LogisticRegression`` trained on the train split, evaluated on the
test split with the package's own weighted P/R/F1 and accuracy.  Training is
distributed (treeAggregate per iteration); nothing is collected.

Every stage that is fitted scans its input, so texts are tokenised once: the
split rows' term counts are written into the shared scratch folder, and the
fits, their iterations' cache and the predictions read those vectors.  The
predictions are written too; both metrics read the small table.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.functions.text import string_array_literal
from labelflow.operators.metrics import accuracy, weighted_prf
from labelflow.operators.sampling import exact_split
from labelflow.session import written


def train_text_classifier(df: DataFrame, id_col: str, text_col: str, label_col: str,
                          num_features: int = 1 << 18, max_iter: int = 30,
                          reg_param: float = 0.01, test_fraction: float = 0.2) -> dict:
    """Fit on the train split, score the test split.

    Returns ``{"model", "predictions", "metrics"}``; ``metrics`` is one row
    ``(accuracy, f1, precision, recall)``.
    """
    tokens = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"\s+", toLowercase=True)
    terms = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    split = exact_split(df.select(id_col, text_col, label_col), id_col, test_fraction)
    split = written(terms.transform(tokens.transform(split)).select(id_col, label_col, "split", "_tf"), "terms")
    train = split.filter(F.col("split") == "train")
    test = split.filter(F.col("split") == "test")
    # "keep" lets test rows with labels unseen in training through; the cast
    # drops the indexer's metadata (which counts an extra "unseen" class) so
    # the classifier learns exactly the classes present in training
    indexer = StringIndexer(inputCol=label_col, outputCol="_yi", handleInvalid="keep").fit(train.select(label_col))
    cast = SQLTransformer(statement="SELECT *, CAST(_yi AS DOUBLE) AS _y FROM __THIS__")
    idf = IDF(inputCol="_tf", outputCol="_features").fit(train.select("_tf"))
    learn = LogisticRegression(featuresCol="_features", labelCol="_y", predictionCol="_pred",
                               maxIter=max_iter, regParam=reg_param)
    fitted = learn.fit(idf.transform(cast.transform(indexer.transform(train.select(label_col, "_tf")))))
    model = PipelineModel([indexer, cast, tokens, terms, idf, fitted])
    # class index -> label (the label list is the fitted vocabulary: bounded)
    names = string_array_literal(indexer.labels)
    scored = fitted.transform(idf.transform(test)).withColumn(
        "prediction", F.try_element_at(names, F.col("_pred").cast("int") + 1))
    preds = written(scored.select(id_col, F.col(label_col).alias("y"), "prediction"), "predictions")
    prf = weighted_prf(preds)
    acc = accuracy(preds)
    metrics = prf.withColumn("_g", F.lit(1)).join(acc.withColumn("_g", F.lit(1)), "_g").select(
        "accuracy", "f1", "precision", "recall")
    return {"model": model, "predictions": preds, "metrics": metrics}
