"""Spark ML baseline: fits, predicts only trained labels, metrics in range."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.plans.train import train_text_classifier


def test_classifier_on_separable_texts(spark):
    words = {"sports": "ball goal team match", "food": "bread soup cheese salad",
             "tech": "chip code cloud data"}
    rows = [(i * 3 + k, f"{w} {i}", lab) for i in range(40) for k, (lab, w) in enumerate(words.items())]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    out = train_text_classifier(df, "id", "text", "label", num_features=1 << 10, max_iter=20)
    m = out["metrics"].first()
    assert 0.9 <= m.accuracy <= 1.0 and 0.0 <= m.f1 <= 1.0
    preds = out["predictions"]
    assert preds.count() == 24  # ceil(0.2 * 120)
    assert preds.filter(~F.col("prediction").isin(list(words))).count() == 0


def test_texts_are_tokenised_once(spark):
    rows = [(i, f"{w} word{i % 7}  {i}", w) for i in range(60) for w in ("red", "blue", "green")]
    df = spark.createDataFrame(rows, "id long, text string, label string").withColumn("id", F.monotonically_increasing_id())
    out = train_text_classifier(df, "id", "text", "label", num_features=1 << 8, max_iter=5)
    # predictions and metrics read written rows, no text passes the tokeniser again
    for part in ("predictions", "metrics"):
        plan = out[part]._jdf.queryExecution().optimizedPlan().toString()
        assert "UDF" not in plan and "parquet" in plan
    # the model itself still takes raw texts
    names = out["model"].stages[0].labels
    again = {r.id: names[int(r._pred)] for r in out["model"].transform(df).select("id", "_pred").collect()}
    got = {r.id: r.prediction for r in out["predictions"].collect()}
    assert len(got) == 36 and all(again[k] == v for k, v in got.items())
