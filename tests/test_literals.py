
from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from labelflow.functions.text import clean_prediction, extract_class_name, is_label_in_options
from labelflow.operators import sampling as S
from labelflow.operators.bleu import corpus_bleu
from labelflow.operators.embed import embed_text
from labelflow.operators.matching import closest_label
from labelflow.operators.metrics import accuracy, classification_report, weighted_prf
from labelflow.operators.options import prompt_options_company
from labelflow.operators.scoring import top1_label
from labelflow.operators.similarity import similarity_topn


def _closest(spark, preds, labels):
    p = spark.createDataFrame([(i, x) for i, x in enumerate(preds)], "i long, p string")
    lab = spark.createDataFrame([(x,) for x in labels], "l string")
    return [r.c for r in closest_label(p, "p", lab, "l", out_col="c").orderBy("i").collect()]


@pytest.mark.parametrize("preds, labels, want", [
    (["cancel sub", "refund me"], ["cancel subscription", "refund request"],
     ["cancel subscription", "refund request"]),
    (["ab"], ["ax", "ay", "xb"], ["xb"]),
    ([""], ["b", "c"], ["c"]),
    (["a"], [], ["a"]),
])
def test_closest_label_literals(spark, preds, labels, want):
    assert _closest(spark, preds, labels) == want


def test_embedder_top_n_counts(spark):
    ex = spark.createDataFrame([(i, t) for i, t in enumerate(["asdasd", "xzczxczx", "xzczxcwewe"])],
                               "exemplar_id long, text string")
    q = spark.createDataFrame([(100, "xzczxc")], "vec_id long, text string")
    ev = embed_text(ex, "exemplar_id", "text")
    qv = embed_text(q, "vec_id", "text")
    for n in (1, 2):
        assert similarity_topn(qv, ev, n).count() == n


def test_scalar_literals(spark):
    df = spark.createDataFrame([("Class name: Refund ", "3. Refund"), ("a:b:c", None), ("Refund", None)],
                               "raw string, pred string")
    got = df.select(extract_class_name("raw").alias("x"), clean_prediction("pred").alias("c")).collect()
    assert [r.x for r in got] == ["refund", "b", "refund"]
    assert [r.c for r in got] == [". Refund", "", ""]
    opts = "OPTIONS:\n1.Refund \n2.Cancel order"
    o = spark.createDataFrame([(opts, "refund"), (opts, "return")], "o string, p string")
    assert [r.v for r in o.select(is_label_in_options("o", "p").alias("v")).collect()] == [True, False]


def test_top1_label_literal(spark):
    df = spark.createDataFrame([([0.9938, 0.0032, 0.0028], ["travel", "dancing", "cooking"])],
                               "s array<double>, l array<string>")
    assert df.select(*top1_label("s", "l")).first().top_label == "travel"


def test_report_literal(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "y string, prediction string")
    rep = {r.id: r for r in classification_report(df).collect()}
    assert (rep["a"].precision, rep["a"].recall, rep["a"].f1_score, rep["a"].support) == (1.0, 0.5, 0.666667, 2)
    assert (rep["b"].precision, rep["b"].recall, rep["b"].f1_score, rep["b"].support) == (0.0, 0.0, 0.0, 1)
    assert (rep["c"].precision, rep["c"].recall, rep["c"].f1_score, rep["c"].support) == (0.0, 0.0, 0.0, 0)
    assert rep["accuracy"].f1_score == pytest.approx(1 / 3, abs=1e-6)
    assert rep["macro avg"].f1_score == pytest.approx(2 / 9, abs=1e-6)
    assert rep["weighted avg"].f1_score == pytest.approx(4 / 9, abs=1e-6)


def test_split_of_eleven_rows(spark):
    df = spark.range(11).withColumnRenamed("id", "rid")
    train, test = S.train_test_split(df, "rid")
    assert (train.count(), test.count()) == (8, 3)


def test_option_order_is_first_appearance(spark):
    classes = [2, 1, 3, 6, 5, 4, 6, 7, 8, 9, 9]
    flat = spark.createDataFrame([("acme", i, f"c{c}", c) for i, c in enumerate(classes)],
                                 "company_name string, pos long, class_name string, class_number int")
    block = prompt_options_company(flat, "company_name", "class_name", "class_number", "pos").first()[1]
    lines = [ln.strip() for ln in block.split("\n") if "." in ln]
    assert lines == [f"{c}.c{c}" for c in [2, 1, 3, 6, 5, 4, 7, 8, 9]]


# ------------------------------------------------------------- properties (§5)

def test_split_disjoint_complete_exact(spark):
    df = spark.range(997).withColumnRenamed("id", "rid")
    train, test = S.train_test_split(df, "rid")
    tr, te = {r.rid for r in train.collect()}, {r.rid for r in test.collect()}
    assert not tr & te and tr | te == set(range(997)) and len(te) == math.ceil(0.2 * 997)


def test_exemplars_at_most_n_per_class(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ex = S.exemplars_per_class(d, "lang", "text", 5, "doc_id")
    assert ex.groupBy("category").count().agg(F.max("count")).first()[0] <= 5


def test_report_invariants(spark, sf_dir):
    from labelflow.plans.inputs import rule_p
    p = rule_p(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = p.count()
    rep = classification_report(p).collect()
    per_label = [r for r in rep if r.id not in ("accuracy", "macro avg", "weighted avg")]
    assert sum(r.support for r in per_label) == n
    tp = p.filter(F.col("y") == F.col("prediction")).count()
    acc = accuracy(p).first().accuracy
    assert acc == pytest.approx(tp / n, abs=1e-6)
    assert weighted_prf(p).first().recall == pytest.approx(acc, abs=1e-6)


def test_topn_ordered_and_capped(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ex = e.filter(F.col("vec_id") % 10 == 0).withColumnRenamed("vec_id", "exemplar_id")
    top = similarity_topn(e.filter(F.col("vec_id") % 10 != 0), ex, 4).collect()
    by_q = {}
    for r in top:
        by_q.setdefault(r.vec_id, []).append((r.rnk, r.sim))
    for rows in by_q.values():
        rows.sort()
        assert len(rows) <= 4 and [k for k, _ in rows] == list(range(1, len(rows) + 1))
        assert all(a[1] >= b[1] for a, b in zip(rows, rows[1:]))


def test_dedup_idempotent(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    once = S.dedup_first(d, "text", "doc_id")
    twice = S.dedup_first(once, "text", "doc_id")
    assert sorted(once.select("doc_id").collect()) == sorted(twice.select("doc_id").collect())


def test_bleu_self_is_100(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter(F.size(F.split("text", " ")) >= 6)
    r = corpus_bleu(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("rid"), F.col("text").alias("h"),
                             F.col("text").alias("r")), "h", "r", "rid").first()
    assert r.score == pytest.approx(100.0)
