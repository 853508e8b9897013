"""Rows in = rows out: null ids, classes and vectors, large label sets; reports by kind; strict parsing."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelflow.functions import text as X
from labelflow.operators import embed, metrics, sampling, scoring, similarity


@pytest.fixture(scope="module")
def rows(spark):
    data = [(None if i % 9 == 0 else i, None if i % 4 == 0 else "ab"[i % 2], f"t{i}") for i in range(45)]
    return spark.createDataFrame(data, "id long, cls string, text string")


def test_splits_keep_null_ids_and_classes(rows):
    whole = sampling.exact_split(rows, "id", 0.2).collect()
    assert len(whole) == 45 and sum(r.split == "test" for r in whole) == 9
    per = Counter((r.cls, r.split) for r in sampling.stratified_split(rows, "id", "cls").collect())
    for c, n in Counter(r.cls for r in rows.collect()).items():
        assert per[c, "test"] == math.ceil(0.2 * n) and per[c, "test"] + per[c, "train"] == n


def test_shuffle_and_strict_sample_keep_nulls(rows):
    assert sorted(r.pos for r in sampling.seeded_shuffle(rows, "id").collect()) == list(range(1, 46))
    got = Counter(r.cls for r in sampling.stratified_sample(rows, "cls", 3, "id", strict=True).collect())
    assert got == {None: 3, "a": 3, "b": 3}


@pytest.mark.parametrize("limit", [10_000, 0])
def test_queries_without_a_vector_stay(spark, limit):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.6, 0.8])], "vec_id long, embedding array<double>")
    e = spark.createDataFrame([(7, [1.0, 0.1], "x"), (8, [0.0, 1.0], "y")],
                              "exemplar_id long, embedding array<double>, category string")
    got = similarity.similarity_topn(q, e, 1, e_payload=("category",), max_broadcast_rows=limit).collect()
    assert sorted((r.vec_id, r.exemplar_id, r.category) for r in got if r.vec_id != 2) == [(1, 7, "x"), (3, 8, "y")]
    assert [(r.rnk, r.exemplar_id, r.sim, r.category) for r in got if r.vec_id == 2] == [(1, None, None, None)]


@pytest.mark.parametrize("inline", [2, 100])
def test_no_label_is_left_out(spark, inline):
    labels = spark.createDataFrame([(x,) for x in ("red car", "blue", "green", "aaa")], "label string")
    texts = spark.createDataFrame([(1, "green"), (2, "red car"), (3, "blue sky"), (4, "zzz")], "id long, t string")
    got = scoring.lexical_predict(texts, "t", labels, "label", max_inline_labels=inline).collect()
    assert {r.id: r.prediction for r in got} == {1: "green", 2: "red car", 3: "blue", 4: "aaa"}


def test_reports_with_labels_named_like_summary_rows(spark):
    data = [("accuracy", "accuracy")] * 2 + [("weighted avg", "accuracy")] * 6 + [("macro avg", "x")] * 2
    df = spark.createDataFrame(data, "y string, prediction string").withColumn("dataset_name", F.lit("d")).withColumn(
        "model_name", F.lit("m"))
    assert metrics.leaderboard(df).first().accuracy == pytest.approx(0.2)
    assert metrics.weighted_prf(df).first().recall == pytest.approx(0.2)
    kinds = Counter((r.id, r.kind) for r in metrics.classification_report(df, kind_col="kind").collect())
    assert kinds["accuracy", "label"] == kinds["accuracy", "summary"] == 1


def test_json_must_be_one_whole_document(spark):
    cases = {'{"class_name":"x"}': "x", '{"class_name":"x"} trailing': None, ' {"class_name": "x"} ': "x", "": None,
             '{"class_name":"x"}, 1': None, '{"class_name":"x"}}': None, "[1]": None, '{"other":1}': None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.v for r in df.select("t", X.parse_json_field("t").alias("v")).collect()}
    assert got == cases


def test_strip_knows_unicode_blanks(spark):
    for t in (" a b　", "\x1ca\x85", " x\n", "y", "", " \n"):
        assert spark.range(1).select(X.strip(F.lit(t)).alias("s")).first().s == t.strip()
        assert spark.range(1).select(X.whitespace_tokens(F.lit(t)).alias("s")).first().s == t.split()


def test_dense_and_sparse_embeddings_agree(spark):
    df = spark.createDataFrame([(1, "Abcabc"), (2, "ab"), (3, None), (4, "é😀x yz")], "id long, t string")
    dense = {r.id: r.embedding for r in embed.embed_text(df, "id", "t", 16).collect()}
    sparse = {(r.id, r.bucket): r.n for r in embed.embed_counts(df, "id", "t", 16).collect()}
    assert [sum(dense[i]) for i in (1, 2, 3, 4)] == [4, 0, 0, 4]
    assert sparse == {(i, b): int(n) for i, v in dense.items() for b, n in enumerate(v) if n}
