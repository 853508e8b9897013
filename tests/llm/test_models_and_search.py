"""Language, toxicity, quality, top-k and the pipeline."""

from __future__ import annotations

import math
import random
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.llm import cross_parse as X
from labelflow.llm import fagin
from labelflow.llm import features as W
from labelflow.llm import nbsvm, pu_toxicity
from labelflow.llm.common import read
from labelflow.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- language

def greedy_phrases(sample: bytes, text: bytes) -> int:
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample and text[at:at + 1] in sample:
            size += 1
        at += size
        n += 1
    return n


def test_phrases_equal_greedy_parsing():
    r = random.Random(2)
    samples = {k: "".join(r.choice(a) for _ in range(300)).encode() for k, a in (("x", "abc d"), ("y", "bcde "))}
    model = X.fit(samples)
    texts = [b"", b"a", b"zzz", b"abcabc d", "".join(r.choice("abcde z") for _ in range(900)).encode()]
    off = np.cumsum([0, *map(len, texts)])
    got = X.phrases(model, np.frombuffer(b"".join(texts), np.uint8), off)
    for i, t in enumerate(texts):
        assert got[i].tolist() == [greedy_phrases(samples[k], t) for k in ("x", "y")]


def test_language_accuracy_and_awkward_texts(spark):
    rows = QUERIES["op2_cross_parsing"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in read(spark, SF, "documents").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (cases.fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    assert len(rows) == len(truth) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    docs = cases.frame(spark)
    model = X.fit(X.sample_texts(docs, F.col("doc_id") >= 0, "doc_id", "text", "lang"))
    got = {r.doc_id: r for r in X.predict(docs, model).collect()}
    for i, t in enumerate(cases.texts()):
        known = any(c.isalpha() for c in t or "")
        assert (got[i].lang_pred in ("en", "fr")) == known and (known or (got[i].lang_pred, got[i].score) == ("und", 0.0))
    blank = cases.empty(spark)
    nothing = X.fit(X.sample_texts(blank, F.lit(True), "doc_id", "text", "lang"))
    assert {r.lang_pred for r in X.predict(docs, nothing).collect()} == {"und"} and X.predict(blank, model).count() == 0


def test_language_sample_holds_many_texts(spark):
    """Copies, a very long text and a repeated id leave room for the other texts."""
    words = [f"word{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]} " for i in range(60)]
    rows = [(i, "copy " * 400, "en") for i in range(600)] + [(1000 + i, w * 300, "en") for i, w in enumerate(words)]
    rows += [(i, "y" * 50 + " long" * 40_000 if i == 5 else w * 9, "fr") for i, w in enumerate(words)]
    rows += [(7, "again " * 3000, "de")] * 300 + [(8, None, "de"), (9, "", "de"), (None, "no id", "de"), (10, "no lang", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    pieces, most = X.sample_pieces(docs, F.lit(True), "doc_id", "text", "lang")
    got = pieces.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("size")).collect()
    assert {r.lang: r.n for r in got} == {"en": 61, "fr": 60, "de": 1} and all(r.size <= 2 * most for r in got)
    samples = X.sample_texts(docs, F.lit(True), "doc_id", "text", "lang")
    assert set(samples) == {"en", "fr", "de"} and all(len(v) <= X.SAMPLE_BYTES for v in samples.values())
    assert len(samples["en"]) > 0.98 * X.SAMPLE_BYTES and samples["en"].count(b"copy") < 100
    for k in ("en", "fr"):
        assert sum(w.strip().encode() in samples[k] for w in words) >= 59      # the long French text has one's place
    assert b"long" in samples["fr"] and b"no " not in samples["de"]


def test_very_many_languages_share_the_sample(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat(concat('text', id, ' '), 40) AS text",
                                        "concat('l', id % 2000) AS lang")
    pieces, most = X.sample_pieces(docs, F.lit(True), "doc_id", "text", "lang")
    total = pieces.agg(F.sum(F.octet_length("t")), F.countDistinct("lang")).first()
    assert most == X.SAMPLE_TOTAL // 2000 and total[0] <= 2 * X.SAMPLE_TOTAL and total[1] == 2000


# ---------------------------------------------------------------- classifiers

def rates(rows, truth, held_only=True):
    c = Counter((truth[r.doc_id], r.predicted) for r in rows if r.doc_id in truth and (r.held_out or not held_only))
    return c


def test_toxicity_finds_held_out_documents(spark):
    rows = QUERIES["op3_pu_toxicity"](spark, "/root/testdata/sf0.1").collect()
    truth = {r.doc_id: r.toxic for r in read(spark, "/root/testdata/sf0.1", "labels").collect()}
    c = rates(rows, truth)
    assert c[1, 1] >= 0.9 * (c[1, 0] + c[1, 1]) and c[0, 1] <= 0.05 * (c[0, 0] + c[0, 1])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len(rows) == read(spark, "/root/testdata/sf0.1", "documents").count()


def test_quality_finds_held_out_documents(spark):
    rows = QUERIES["op8_nbsvm_quality"](spark, "/root/testdata/sf0.1").collect()
    truth = {r.doc_id: r.quality for r in read(spark, "/root/testdata/sf0.1", "labels").collect()}
    c = rates(rows, truth)
    assert c[1, 1] >= 0.9 * (c[1, 0] + c[1, 1]) and c[0, 1] <= 0.15 * (c[0, 0] + c[0, 1])
    assert all(r.held_out == (cases.fold(r.doc_id, 4) == 2) and r.predicted == (r.score >= 0.7) for r in rows)


def labelled(spark):
    rows = [f"good word{i % 5} text" if i % 2 else f"nasty{i % 3} vile text" for i in range(200)] + [None, "", "é" * 9000]
    docs = cases.frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2, "x") for i in range(200)] + [(None, 1, 1, "x"), (3, None, None, "x"), (900, 0, 1, "x")],
                                   "doc_id long, quality int, toxic int, score string")
    return docs, labels


def test_classifiers_on_planted_words_and_without_labels(spark):
    docs, labels = labelled(spark)
    for fit, extract, sign in ((pu_toxicity.fit, W.word_prefixes, 0), (nbsvm.fit, W.word_ngrams, 1)):
        got = {r.doc_id: r.score for r in W.score(docs, fit(docs, labels), extract).collect()}
        assert len(got) == 203 and all(0 <= s <= 1 for s in got.values())
        if sign:
            assert all((got[i] > 0.5) == (i % 2 == 1) for i in range(200))
        else:
            assert min(got[i] for i in range(0, 200, 2)) > max(got[i] for i in range(1, 200, 2))
        for none in (labels.limit(0), labels.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(0))):
            assert len({r.score for r in W.score(docs, fit(docs, none), extract).collect()}) == 1
        assert W.score(cases.empty(spark), fit(docs, labels), extract).count() == 0
        assert len({r.score for r in W.score(docs, fit(cases.empty(spark), labels), extract).collect()}) == 1
    clean = pu_toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} >= set(range(1, 200, 2))


def test_a_repeated_id_is_drawn_once(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(500)] + [(2, None), (3, "c"), (4, "no")],
                                 "doc_id long, text string").repartition(4)
    chosen = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "i long, y int")
    got = sorted((r.y, r.t) for r in W.draw(docs, chosen, "doc_id", "text", "drawn").collect())
    assert got == [(0, ""), (0, "text 0"), (1, "c"), (1, "text 0")]


def test_rare_toxic_wording_beside_a_hot_copy(spark):
    """Copies of one toxic text hold most toxic rows, more than are drawn; the other toxic texts are learned all the same."""
    rare = spark.range(1000).selectExpr("id AS doc_id", "concat('talk of ', substr(md5(cast(id % 40 as string)), 1, 8), ' item', id) AS text", "1 AS toxic")
    hot = spark.range(40_000).selectExpr("id + 1000 AS doc_id", "'nasty copied words' AS text", "1 AS toxic")
    good = spark.range(20_000).selectExpr("id + 900000 AS doc_id", "concat('talk of nice', chr(97 + id % 20), ' item', id) AS text", "0 AS toxic")
    both = rare.union(hot).union(good).repartition(4)
    docs, labels = both.select("doc_id", "text"), both.select("doc_id", "toxic")
    score = {r.doc_id: r.score for r in W.score(docs.where("doc_id < 1001 or doc_id >= 900000"),
                                                pu_toxicity.fit(docs, labels), W.word_prefixes).collect()}
    assert sum(score[i] >= 0.5 for i in range(1001)) >= 950
    assert sum(score[900000 + i] < 0.5 for i in range(20_000)) >= 19_000


def test_nn_pu_separates_with_toxic_rows_in_the_unlabelled_side():
    r = np.random.default_rng(1)
    positive = np.column_stack([np.ones(200), r.integers(0, 2, (200, 20))]).astype(np.float32)
    clean = np.column_stack([np.zeros(900), r.integers(0, 2, (900, 20))]).astype(np.float32)
    w, b = pu_toxicity.nn_pu(positive, np.concatenate([clean, positive[:100]]), 0.1)
    assert (positive @ w + b > 0).mean() > 0.95 and (clean @ w + b > 0).mean() < 0.05


# ---------------------------------------------------------------- top-k

def brute_top_k(rows, k, step, scale=256):
    """Answers of every query row, as (query id, [(id, score), ...])."""
    vectors = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
               if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, own) in enumerate(vectors):
        if q % step == 0:
            found = [(-sum(a * b for a, b in zip(own, v)), i) for m, (i, v) in enumerate(vectors)
                     if m != n and len(v) == len(own)]
            out.append((q, [(i, -s) for s, i in sorted(found)[:k]]))
    return sorted(x for x in out if x[1])


def answers(df):
    """Rows of one query id, split into answers by their ranks."""
    by_id = {}
    for x in df.collect():
        by_id.setdefault(x.query_id, {}).setdefault(x["rank"], []).append((x.vec_id, x.score))
    return by_id


@pytest.mark.parametrize("block, chunk", [(4096, 1024), (16, 3)])
def test_top_k_equals_brute_force(spark, block, chunk):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, 0.0, 0.25, r.gauss(0, 1)]) for _ in range(6)]) for i in range(150)]
    rows += [(150 + i, [0.5] * 6) for i in range(20)] + [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6),
             (202, [math.nan] * 6), (203, [math.inf] + [0.0] * 5), (204, [1.0, 2.0]), (205, []), (210, [1.0, 3.0]), (220, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = answers(fagin.top_k(df, F.col("id") % 10 == 0, block_rows=block, query_rows=chunk))
    assert sorted((q, [x[0] for _, x in sorted(ranks.items())]) for q, ranks in got.items()) == brute_top_k(rows, 5, 10)
    assert fagin.top_k(df.limit(0), F.col("id") % 10 == 0).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k_of_repeated_queries_and_candidates(spark, block):
    rows = [(10, [1.0, 0.0]), (10, [0.0, 1.0]), (10, [1.0, 0.0]), (20, [-1.0, 0.0]), (20, [-1.0, 0.0])]
    rows += [(i, [i / 40, 1 - i / 40]) for i in range(21, 60) if i % 10] + [(33, [0.5, 0.5])] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = answers(fagin.top_k(df, F.col("id") % 10 == 0, block_rows=block, query_rows=2))
    want = {}
    for q, best in brute_top_k(rows, 5, 10):
        for rank, x in enumerate(best, 1):
            want.setdefault(q, {}).setdefault(rank, []).append(x)
    assert {q: {r: sorted(x) for r, x in ranks.items()} for q, ranks in got.items()} == {
        q: {r: sorted(x) for r, x in ranks.items()} for q, ranks in want.items()}


def test_repeated_rows_are_dealt_apart(spark):
    df = spark.range(4000).selectExpr("7L AS vec_id", "array(1.0D, 2.0D) AS embedding")
    base = fagin.numbered_vectors(df, "vec_id", "embedding", 256)
    sizes = [r["count"] for r in base.groupBy(fagin.dealt(16)).count().collect()]
    assert len(sizes) == 16 and sum(sizes) == 4000 and max(sizes) < 500


def test_walk_stops_before_the_end_of_the_lists():
    """A few strong rows end the walk early and are still the right ones."""
    r = np.random.default_rng(3)
    v = r.integers(-3, 4, (4000, 4))
    v[:10] = 100
    q, at, s = fagin.threshold_top_k(v, np.arange(4000), np.full((1, 4), 5), 5)
    assert at.tolist() == [0, 1, 2, 3, 4] and s.tolist() == [2000] * 5


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline as P
    from labelflow.llm import features

    docs = read(spark, SF, "documents")
    start = {r.doc_id: r.text for r in docs.collect()}
    clean = P.toxicity(spark, docs, SF).cache()
    model = pu_toxicity.fit(docs, read(spark, SF, "labels"))
    bad = {r.doc_id for r in features.score(docs, model, W.word_prefixes).collect() if r.score >= 0.5}
    assert {r.doc_id for r in clean.collect()} == set(start) - bad
    exact = P.exact(spark, clean, SF).cache()
    last = {}
    for i in sorted(set(start) - bad):
        last[cases.lower(start[i])] = i
    assert {r.doc_id for r in exact.collect()} == set(last.values())
    near = P.near(spark, exact, SF).cache()
    small = {i: start[i] for i in last.values()}
    sets = {i: cases.shingles(t, 5) for i, t in small.items()}
    links, seen = [], {}
    for i, s in sets.items():                        # pairs that share a shingle
        for x in s:
            seen.setdefault(x, []).append(i)
    for a, b in {(a, b) for v in seen.values() if len(v) < 200 for a in v for b in v if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    stay = set(cases.components(list(sets), links).values())
    assert {r.doc_id for r in near.collect()} == stay
    safe = P.secrets(spark, near, SF).cache()
    assert safe.count() == len(stay) and safe.columns == docs.columns
    from test_text_operators import base_spans
    for r in safe.collect():
        listed, _ = base_spans(start[r.doc_id])
        assert (r.text == start[r.doc_id]) == (not listed)
        assert not base_spans(r.text)[0]
    assert {r.doc_id for r in P.packing(spark, safe, SF).select("doc_id").distinct().collect()} == stay


def test_near_stage_on_a_hot_group_against_all_pairs(spark):
    """Near copies share shingles with 200 documents and more; the plain version leaves none of them out."""
    import corpus_pipeline as P

    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    hot = [r.choice(vocab) for _ in range(120)]
    texts = []
    for _ in range(300):
        w = list(hot)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [" ".join(r.choice(vocab) for _ in range(60)) for _ in range(40)]
    docs = cases.frame(spark, texts)
    shared = Counter(x for t in texts for x in cases.shingles(t, 5))
    assert max(shared.values()) >= 200
    classes = cases.jaccard_classes(dict(enumerate(texts)), 5, 80)
    assert 41 < len(set(classes.values())) < 340
    assert {x.doc_id for x in P.near(spark, docs, SF).collect()} == set(classes.values())


def test_stages_hand_small_batches_to_python(spark, monkeypatch):
    """100 rows of 400 kB: by Spark's bound of 64 MB the first batch of a stage's operator held all of them."""
    import corpus_pipeline as P
    import pyarrow as pa
    from labelflow.llm import common as C

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([len(b)])], ["bytes", "rows"])

    def operator(docs, *_, **__):
        return docs.mapInArrow(sizes, "bytes bigint, rows bigint")

    docs = spark.range(0, 100, 1, 1).selectExpr("id AS doc_id", "repeat('words ', 66000) AS text")
    for module, name in ((P.pu_toxicity, "keep_clean"), (P.exact_dedup, "drop_copies"), (P.jaccard_join, "keep_one"),
                         (P.secret_scan, "redact"), (P.harmonic, "pack_documents")):
        monkeypatch.setattr(module, name, operator)
    before = spark.conf.get(C.BATCH_BOUND, None)
    try:
        for _, stage in P.STAGES:
            spark.conf.unset(C.BATCH_BOUND)
            got = stage(spark, docs, SF).collect()
            assert sum(r.rows for r in got) == 100
            assert max(r.bytes for r in got) <= 2 * C.BATCH_BYTES
        spark.conf.set(C.BATCH_BOUND, "1m")              # a bound the session has set stays
        got = P.near(spark, docs, SF).collect()
        assert sum(r.rows for r in got) == 100 and max(r.bytes for r in got) <= 2 << 20
    finally:
        spark.conf.unset(C.BATCH_BOUND)
        if before is not None:
            spark.conf.set(C.BATCH_BOUND, before)


def test_meetings_do_not_depend_on_the_number_of_groups(spark):
    """What a slice ships is cut by signature range: with 1, 7 or 3000 groups all meetings come, each once a signature."""
    from labelflow.llm import jaccard_join as J

    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts = []
    for _ in range(30):
        w = [r.choice(vocab) for _ in range(80)]
        texts += [" ".join(w), " ".join([*w[:-1], r.choice(vocab)])]
    docs = cases.frame(spark, texts).repartition(3)
    none = np.zeros(0, np.uint64)
    got = []
    for groups in (1, 7, 3000):
        met = J.meetings(docs, groups, 5, 80, "text", 64, none)
        pairs = [(x.sig, frozenset((x.node, x.head))) for x in met.collect()]
        assert len(pairs) == len(set(pairs))
        got.append(set(pairs))
    assert got[0] and got[0] == got[1] == got[2]
