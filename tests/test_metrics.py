"""Classification report on a hand-computed case."""

from __future__ import annotations

import pytest

from labelflow.operators.metrics import accuracy, classification_report, confusion_matrix, weighted_prf


def _df(spark):
    rows = [("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("b", "c"), ("c", "c")]
    return spark.createDataFrame(rows, "y string, prediction string")


def test_report_hand_computed(spark):
    rep = {r.id: r for r in classification_report(_df(spark)).collect()}
    # a: tp 2, support 3, predicted 2; b: tp 1, support 2, predicted 2; c: tp 1, support 1, predicted 2
    assert rep["a"].precision == 1.0 and rep["a"].recall == pytest.approx(0.666667)
    assert rep["b"].f1_score == pytest.approx(0.5)
    assert rep["c"].precision == 0.5 and rep["c"].recall == 1.0
    assert rep["accuracy"].precision == pytest.approx(0.666667) and rep["accuracy"].support == 6
    f1 = {"a": 0.8, "b": 0.5, "c": 2 / 3}
    assert rep["macro avg"].f1_score == pytest.approx(sum(f1.values()) / 3, abs=1e-6)
    assert rep["weighted avg"].f1_score == pytest.approx((3 * 0.8 + 2 * 0.5 + 2 / 3) / 6, abs=1e-6)


def test_weighted_and_accuracy_agree_with_report(spark):
    df = _df(spark)
    w = weighted_prf(df).first()
    a = accuracy(df).first()
    assert a.accuracy == pytest.approx(4 / 6, abs=1e-6)
    assert w.f1 == pytest.approx((3 * 0.8 + 2 * 0.5 + 2 / 3) / 6, abs=1e-6)


def test_confusion_counts(spark):
    got = {(r.y, r.prediction): r.n for r in confusion_matrix(_df(spark)).collect()}
    assert got == {("a", "a"): 2, ("a", "b"): 1, ("b", "b"): 1, ("b", "c"): 1, ("c", "c"): 1}
