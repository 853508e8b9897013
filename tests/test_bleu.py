"""Corpus BLEU on hand-computed cases."""

from __future__ import annotations

import math

import pytest

from labelflow.operators.bleu import corpus_bleu, tokenize_13a


def _bleu(spark, pairs):
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "id long, hyp string, ref string")
    return corpus_bleu(df, "hyp", "ref", "id").first().asDict()


def test_identical_is_100(spark):
    r = _bleu(spark, [("the cat sat on the mat", "the cat sat on the mat")])
    assert r["score"] == pytest.approx(100.0)
    assert r["bp"] == 1.0 and r["sys_len"] == 6 == r["ref_len"]


def test_nothing_matches_is_zero(spark):
    r = _bleu(spark, [("a b c d", "w x y z")])
    assert r["score"] == 0.0


def test_hand_computed_with_smoothing_and_brevity(spark):
    # hyp 5 tokens, ref 6 tokens; matches: 1-grams 4/5, 2-grams 2/4, 3-grams 1/3, 4-grams 0/2
    r = _bleu(spark, [("the cat sat on mat", "the cat sat on the mat")])
    p = [100 * 5 / 5, 100 * 3 / 4, 100 * 2 / 3, 100 * 1 / 2]
    # recount exactly: hyp 1-grams all present in ref -> 5/5; 2-grams: the cat, cat sat, sat on -> 3/4
    # 3-grams: the cat sat, cat sat on -> 2/3; 4-grams: the cat sat on -> 1/2
    bp = math.exp(1 - 6 / 5)
    want = bp * math.exp(sum(math.log(x) for x in p) / 4)
    assert r["p1"] == pytest.approx(p[0]) and r["p4"] == pytest.approx(p[3])
    assert r["bp"] == pytest.approx(bp, abs=1e-6)
    assert r["score"] == pytest.approx(want, abs=1e-5)


def test_exp_smoothing_of_zero_order(spark):
    # 3 tokens each, 1-grams 2/3, 2-grams 1/2, 3-grams 0/1 -> 100/(2*1), 4-grams no n-grams -> score 0
    r = _bleu(spark, [("a b c", "a b d")])
    assert r["p3"] == pytest.approx(50.0)
    assert r["score"] == 0.0


def test_tokenizer_13a(spark):
    df = spark.createDataFrame([("Hello, world. It's 3.5-4 &amp; (done)!",)], "t string")
    toks = df.select(tokenize_13a("t").alias("x")).first()["x"]
    # the apostrophe (0x27) is outside the 13a punctuation ranges; '-' splits after a digit
    assert toks == ["Hello", ",", "world", ".", "It's", "3.5", "-", "4", "&", "(", "done", ")", "!"]


def test_distinct_ids_count_in_their_rows(spark, monkeypatch):
    import random

    from labelflow.operators import bleu

    r = random.Random(3)
    text = lambda: None if r.random() < 0.1 else " ".join(r.choice("a b c d. e,f 1-2 \u00a0g".split(" ")) for _ in range(r.randint(0, 30)))
    df = spark.createDataFrame([(i, text(), text()) for i in range(300)] + [(900, "a b " * 400, "b a " * 300)],
                               "id long, hyp string, ref string")
    want = bleu.bleu_stats(df, "hyp", "ref", "id").first()
    monkeypatch.setattr(bleu, "SLICE_TOKENS", 200)               # many slices, one row longer than a slice
    got = bleu.bleu_stats(df, "hyp", "ref", "id", distinct_ids=True)
    assert got.first().asDict() == want.asDict() and want.correct_4 > 0
    assert set(bleu.bleu_stats(df.limit(0), "hyp", "ref", "id", distinct_ids=True).first()) == {0}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan                               # no row for each n-gram


def test_query_makes_no_row_for_each_ngram(spark, tmp_path):
    from labelflow.plans.catalog_text import q_corpus_bleu

    turns = [(1, 0, "user", "a b c d"), (1, 1, "assistant", "a b c d"), (1, 1, "assistant", "a b c d"),
             (None, None, "user", "x"), (None, None, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    out = q_corpus_bleu(spark, str(tmp_path))
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    x = out.first()
    assert (x.sys_len, x.ref_len, x.p4) == (4, 5, 100.0)
