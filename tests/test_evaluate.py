"""Modes of the few-shot and taxonomy evaluations on small literal tables."""

from __future__ import annotations

import difflib
import hashlib
import os

from pyspark.sql import functions as F

from labelflow.functions.prompts import TOPIC_NO_COMPANY
from labelflow.operators.scoring import score_prompts
from labelflow.plans import fewshot as FS
from labelflow.plans.evaluate import PromptDigestScorer, taxonomy_evaluate
from labelflow.sources.taxonomy import expansion_dim, taxonomy_dim

ROWS = [(1, "please cancel the order", "Cancel Order"), (2, "cancel my order now", "Cancel Order"),
        (3, "where is my refund", "Refund"), (4, "refund the money", "Refund"), (5, "book a table", "Booking"),
        (6, "i want to book", "Booking"), (7, "refund the money", "Refund")]


def _rows(spark):
    return spark.createDataFrame(ROWS, "id long, text string, cls string")


def test_zero_shot_uses_the_vector_of_the_class_name(spark):
    df = FS.with_vectors(_rows(spark), "id", "text")
    ranked, queries = FS.retrieve(df, "id", "embedding", "cls", "text", 0, 2)
    assert queries.count() == len(ROWS)                      # no row is taken away as an exemplar
    assert {r.option_text for r in ranked.collect()} <= {"Cancel Order", "Refund", "Booking"}
    assert ranked.groupBy("id").count().where("count = 2").count() == len(ROWS)
    scored, report = FS.fewshot_evaluate(df, "id", "embedding", "cls", n_shot=0, top_n=2)
    got = {r.id: r for r in scored.collect()}
    assert got[2].few_shot == "Cancel Order" and got[2].v_pred == "cancel order" and got[2].y == "cancel order"
    # a class name stands as written, labels are compared in lower case: the raw names miss them
    assert got[2].resolved_label == "Cancel Order"
    assert report.where("id = 'accuracy'").first().precision == 0.0
    kinds = {(r.prediction_kind, r.id): r.precision for r in FS.fewshot_reports(scored).collect()}
    assert kinds[("v_pred", "accuracy")] > 0.5 and kinds[("few_shot", "accuracy")] == 0.0


def test_options_without_retrieval_are_all_classes_and_the_model_runs_once(spark, tmp_path):
    folder = str(tmp_path)

    class Model:
        def predict(self, prompts):
            for p in prompts:
                with open(os.path.join(folder, hashlib.md5(p.encode()).hexdigest()), "a") as f:
                    f.write("x")
            return ["Class name: refnd" if "refund" in p else "bookin" if "book" in p else None for p in prompts]

    scored, report = FS.categories_evaluate(_rows(spark), "id", "cls", "text",
                                            lambda rows: score_prompts(rows, "prompt", Model, "raw_prediction"))
    got = {r.id: r for r in scored.collect()}
    report.collect()
    FS.fewshot_reports(scored).collect()
    assert len(os.listdir(folder)) == 6                      # distinct prompts, each asked once
    assert {len(open(os.path.join(folder, f)).read()) for f in os.listdir(folder)} == {1}
    block = "Options:\n# Booking \n# Cancel Order \n# Refund \n"
    assert got[3].prompt == TOPIC_NO_COMPANY.format(text="where is my refund", prompt=block)
    names = ["booking", "cancel order", "refund"]
    for r in got.values():
        want = difflib.get_close_matches(r.original_prediction, names, n=1, cutoff=0.0)[0]
        assert r.v_pred == want
    assert got[3].few_shot == "Refund" and got[5].few_shot == "Booking" and got[1].original_prediction == ""


def _evaluate(spark, **kw):
    tax = taxonomy_dim(spark, {"a": "Alpha", "b": "Beta"}, "t")
    rows = [(1, "one", "a"), (2, "two", "b"), (3, "two", "a"), (4, "three", "zz"), (5, "four", "a")]
    df = spark.createDataFrame(rows, "id long, text string, cls string")
    return taxonomy_evaluate(df, "id", "text", "cls", tax, **kw)


def test_taxonomy_extraction_keeps_the_original_and_dedups_on_it(spark):
    seen = {}

    def extract(rows):
        seen["prompts"] = sorted(r.prompt for r in rows.collect())
        return rows.withColumn("extracted", F.lit("same"))

    out = _evaluate(spark, extract=extract, predict=lambda rows: rows.withColumn("raw_prediction", F.lit("Class name: Alpha")))
    got = {r.id: r for r in out["predictions"].collect()}
    assert set(got) == {1, 2, 5} and {r.original for r in got.values()} == {"one", "two", "four"}
    assert {r.text for r in got.values()} == {"same"} and "Customer: same." in got[1].prompt
    assert seen["prompts"] == sorted(f"Extraction %% Customer: {t}" for t in ("one", "two", "four"))
    assert {r.id for r in out["errors"].collect()} == {2}
    assert [(r.prediction, r.n) for r in out["counts"].collect()] == [("Alpha", 3)]


def test_taxonomy_expansion_accepts_further_names(spark):
    exp = expansion_dim(spark, {"a": ["First", "Primus"]})
    answers = F.when(F.col("id") == 1, "Class name: PRIMUS").when(F.col("id") == 2, "first").otherwise("Alpha")
    out = _evaluate(spark, expansion=exp, predict=lambda rows: rows.withColumn("raw_prediction", answers))
    got = {r.id: (r.y, r.prediction) for r in out["predictions"].collect()}
    # the names belong to label a alone
    assert got == {1: ("primus", "primus"), 2: ("beta", "first"), 5: ("alpha", "alpha")}
    prompt = out["predictions"].where("id = 1").first().prompt
    assert "OPTIONS\n# First\n# Primus\n 1. Beta \n # other # general # unknown \nClass name: " in prompt


def test_digest_scorer_reads_the_options_of_its_prompt():
    block = "OPTIONS\n 1. Alpha One \n# Extra\n # other # general "
    p = TOPIC_NO_COMPANY.format(text="x customer's issue.\n 9. no option", prompt=block)
    options = ["Alpha One", "Extra", "other", "general"]
    pick = int(hashlib.md5(p.encode()).hexdigest()[:8], 16)
    assert PromptDigestScorer().predict([p, None]) == ["Class name: " + options[pick % 4], None]


def test_rows_of_queries_are_not_broadcast(spark):
    # few texts that many rows repeat: their files are small, the rows are not
    df = FS.with_vectors(_rows(spark), "id", "text")
    test = df.where("id > 2").withColumn("id", F.col("id") + 100)
    scored, _ = FS.fewshot_evaluate(df, "id", "embedding", "cls", "text", n_shot=1, top_n=2, test=test)
    prompts = FS.retrieve_then_prompt(df, "id", "embedding", "cls", F.col("text"), "text", 1, 2, test=test)
    for out, joins in ((scored, 3), (prompts, 1)):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") == joins and "BroadcastHashJoin" not in plan
        assert out.count() == 5
