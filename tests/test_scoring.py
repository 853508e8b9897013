"""Pluggable batch scoring: the native lexical scorer and its Python twin
agree; two-stage prediction keeps the original text."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.operators.scoring import (LexicalScorer, LongestTokensExtractor, lexical_predict, lexical_zero_shot,
                                         longest_tokens, score_prompts, two_stage_predict)

LABELS = ["red apple", "green pear", "blue berry", "apple pie"]
TEXTS = ["a red apple today", "pear green", "nothing here", "apple pie and blue berry", None]


def test_native_and_python_lexical_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    labels = spark.createDataFrame([(x,) for x in LABELS], "label string")
    native = {r.id: r.prediction for r in lexical_zero_shot(df, "text", labels, "label").collect()}
    py = {r.id: r.prediction for r in score_prompts(df, "text", lambda: LexicalScorer(LABELS)).collect()}
    assert native == py


def test_longest_tokens_native_twin(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:4])], "id long, text string")
    native = {r.id: r.k for r in df.select("id", longest_tokens("text", 2).alias("k")).collect()}
    py = dict(zip(range(4), LongestTokensExtractor(2).predict(TEXTS[:4])))
    assert native == py


def test_two_stage_keeps_original(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:4])], "id long, text string")
    out = two_stage_predict(df, "text", lambda: LongestTokensExtractor(1), lambda: LexicalScorer(LABELS))
    rows = out.orderBy("id").collect()
    assert [r.original for r in rows] == TEXTS[:4]
    assert all(r.prediction in LABELS for r in rows)
    assert out.filter(F.col("extracted").isNull()).count() == 0


def _plain_lexical(texts, labels):
    out = []
    for t in texts:
        ts = set((t or "").lower().split())
        scored = []
        for x in labels:
            xs = set(x.lower().split())
            scored.append((-(len(ts & xs) / len(ts | xs) if ts | xs else 0.0), x))
        out.append(min(scored)[1])
    return out


def test_index_equals_all_pairs(spark):
    import random

    r = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    labels = sorted({" ".join(r.choices(vocab, k=r.randint(1, 6))) for _ in range(400)} | {" ", "The", "the the x"})
    texts = [" ".join(r.choices(vocab + ["the", "zz", "yy"], k=r.randint(0, 25))) for _ in range(300)]
    texts += [None, "", "   ", "THE", texts[4], "unknown words only", "w1\u00a0w2"]
    want = _plain_lexical(texts, labels)
    assert LexicalScorer(labels).predict(texts) == want
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    ldf = spark.createDataFrame([(x,) for x in labels + labels[:5]] + [(None,)], "label string")
    got = {x.id: x.prediction for x in lexical_zero_shot(df, "text", ldf, "label").collect()}
    assert got == dict(enumerate(want))
    small = {x.id: x.prediction for x in lexical_predict(df, "text", ldf, "label", max_inline_labels=3).collect()}
    assert small == got
    assert {x.prediction for x in lexical_zero_shot(df, "text", ldf.limit(0), "label").collect()} == {None}


def test_prompts_are_scored_once_in_batches_of_like_lengths(spark, tmp_path):
    import random

    class Counting:
        """Answers with the prompt's length; writes each batch's lengths to a folder."""

        def __init__(self, folder):
            self.folder = folder

        def predict(self, texts):
            import os
            import uuid

            with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
                f.write(" ".join(str(len(t or "")) for t in texts))
            return [None if t is None else str(len(t)) for t in texts]

    r = random.Random(10)
    distinct = ["x" * n + str(i) for i, n in enumerate(r.choices(range(1, 2000), k=900))]
    prompts = distinct + r.choices(distinct, k=2000) + [None, None, ""]
    df = spark.createDataFrame(list(enumerate(prompts)), "id long, p string").repartition(5)
    folder = str(tmp_path)
    got = {x.id: x.prediction for x in score_prompts(df, "p", lambda: Counting(folder), batch_size=32).collect()}
    assert got == {i: None if t is None else str(len(t)) for i, t in enumerate(prompts)}
    batches = [[int(n) for n in f.read_text().split()] for f in tmp_path.iterdir()]
    assert sum(map(len, batches)) == len(distinct) + 2 and max(map(len, batches)) == 32
    padded = sum(max(b) * len(b) for b in batches)
    assert padded < 1.35 * sum(map(sum, batches))
