"""Both classifiers recomputed plainly; repeated rows, null ids and empty tables through queries and the pipeline."""

from __future__ import annotations

import itertools
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.llm import bpe_codec as B
from labelflow.llm import cross_parse as X
from labelflow.llm import features as W
from labelflow.llm import harmonic as H
from labelflow.llm import jaccard_join as J
from labelflow.llm import nbsvm, pu_toxicity
from labelflow.llm import secret_scan as S

BLANKS = " \t\n\x0b\x0c\r"


def words(t):
    out, cur = [], b""
    for c in t.encode():
        if chr(c) in BLANKS:
            out += [cur] if cur else []
            cur = b""
        else:
            cur += bytes([c])
    return out + ([cur] if cur else [])


def low(w):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in w)


def plain_prefixes(t):
    out = set()
    for w in map(low, words(t)):
        out.add(("word", w))
        out |= {(n, w[:n]) for n in (4, 5, 6) if len(w) >= n}
    return out


def plain_ngrams(t):
    ws, out = words(t), set()
    lows = [low(w) for w in ws]
    for i, w in enumerate(lows):
        out.add(("word", w))
        out |= {("end", n, w[-n:]) for n in (2, 3) if len(w) > n}
        if i:
            out.add(("pair", lows[i - 1], w))
            if lows[i - 1] == w:
                out.add(("again",))
    for w in ws:
        kinds = set()
        for i, c in enumerate(w):
            if 65 <= c <= 90:
                kinds |= {"upper"} if i else set()
            elif 97 <= c <= 122:
                kinds.add("lower")
            elif 48 <= c <= 57:
                kinds.add("digit")
            elif 33 <= c < 127:
                kinds.add("sign")
            elif c >= 128:
                kinds.add("other")
        out.add(("shape", frozenset(kinds)))
    return out


def documents(seed, n, marks):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeXé") for _ in range(r.randint(2, 8))) for _ in range(120)]
    return [" ".join([r.choice(vocab) for _ in range(r.randint(3, 40))] + r.sample(marks[i % 2], 2)) for i in range(n)]


@pytest.mark.parametrize("extract, plain", [(W.word_prefixes, plain_prefixes), (W.word_ngrams, plain_ngrams)])
def test_features_are_those_of_the_definition(extract, plain):
    """Same features, same documents: hashed and plain features group the texts alike."""
    texts = documents(1, 60, (["Tell-tale", "mark9"], ["fine", "fine fine"])) + ["", " \n", "a", "A a", "ß ß", "word9! word9!"]
    raw = [t.encode() for t in texts]
    row, f = extract(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    hashed, named = defaultdict(set), defaultdict(set)
    for i, x in zip(row.tolist(), f.tolist()):
        hashed[x].add(i)
    for i, t in enumerate(texts):
        for x in plain(t):
            named[x].add(i)
    assert Counter(map(frozenset, hashed.values())) == Counter(map(frozenset, named.values()))


def plain_selection(texts, y, plain, most):
    """Features that five documents hold and whose shares differ by four standard errors, half a document off."""
    n1, n0 = defaultdict(int), defaultdict(int)
    for t, k in zip(texts, y):
        for x in plain(t):
            (n1 if k else n0)[x] += 1
    a, b = sum(y), len(y) - sum(y)
    out = {}
    for x in set(n1) | set(n0):
        if n1[x] + n0[x] >= 5:
            p = (n1[x] + n0[x]) / (a + b)
            gap = abs(n1[x] / a - n0[x] / b) - (0.5 / a + 0.5 / b)
            if gap / math.sqrt(max(p * (1 - p), 1e-9) * (1 / a + 1 / b)) >= 4:
                out[x] = (n1[x], n0[x])
    assert len(out) <= most
    return out


def tables(spark, texts, y, label):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(y)], f"doc_id long, {label} int")
    return docs, labels


def test_quality_model_is_the_hinge_loss_optimum_over_scaled_ratios(spark):
    texts = documents(2, 240, (["good", "nice", "fair", "kind"], ["Spam", "spam", "buy", "now!"]))
    y = [(1 - i % 2) if i % 11 else i % 2 for i in range(240)]          # some labels are wrong
    docs, labels = tables(spark, texts, y, "quality")
    model = nbsvm.fit(docs, labels)
    learned = [i for i in range(240) if cases.fold(i, 4) != 2]
    chosen = plain_selection([texts[i] for i in learned], [y[i] for i in learned], plain_ngrams, nbsvm.FEATURES)
    assert len(chosen) == len(model.features) > 5
    a = sum(y[i] for i in learned)
    b = len(learned) - a
    ratio = {x: math.log((n1 + 1) / (a + 2)) - math.log((n0 + 1) / (b + 2)) for x, (n1, n0) in chosen.items()}
    # the primal optimum of 1/2 |w|^2 + 1/2 bias^2 + sum of hinge losses, by subgradient steps
    names = list(chosen)
    rows = np.array([[ratio[x] if x in plain_ngrams(texts[i]) else 0.0 for x in names] + [1.0] for i in learned])
    sign = np.array([1.0 if y[i] else -1.0 for i in learned])

    def objective(w):
        return 0.5 * w @ w + nbsvm.COST * np.maximum(0, 1 - sign * (rows @ w)).sum()

    w, best = np.zeros(rows.shape[1]), None
    for t in range(1, 20_000):
        open_ = sign * (rows @ w) < 1
        w -= (w - nbsvm.COST * (sign[open_, None] * rows[open_]).sum(axis=0)) / (t + 10)
        if best is None or objective(w) < objective(best):
            best = w.copy()
    at = [np.array([j for j, x in enumerate(names) if x in plain_ngrams(texts[i])], np.int64) for i in learned]
    scale = np.array([ratio[x] for x in names])
    u, bias = nbsvm.dual_descent(at, scale, sign, epochs=200)
    mine = np.append(u, bias)
    assert objective(mine) <= objective(best) * 1.01 + 1e-6
    # the served scores are a monotone curve over the plain margins of the model's own weights
    scores = {r.doc_id: r.score for r in W.score(docs, model, W.word_ngrams).collect()}
    margin = {}
    for i, t in enumerate(texts):
        raw = t.encode()
        row, f = W.word_ngrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        margin[i] = sum(model.weights[k] for k, x in enumerate(model.features) if x in set(f.tolist())) + model.bias
    for i in range(240):
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * margin[i] + model.shift))), abs=1e-9)


def test_toxicity_model_minimises_the_non_negative_risk(spark):
    r = np.random.default_rng(4)
    positive = np.column_stack([r.random((80, 3)) < 0.8, r.random((80, 4)) < 0.3]).astype(np.float32)
    unlabelled = np.column_stack([r.random((300, 3)) < 0.2, r.random((300, 4)) < 0.3]).astype(np.float32)
    prior = 0.2

    def risk(w):
        zp, zu = positive @ w[:-1] + w[-1], unlabelled @ w[:-1] + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, negative) + 0.5e-4 * (w[:-1] ** 2).sum()

    w, bias = pu_toxicity.nn_pu(positive, unlabelled, prior, steps=3000, rate=0.02)
    mine = np.append(w, bias)
    # plain descent on the same risk with numeric gradients finds nothing lower
    x, step = mine.copy(), 0.05
    for _ in range(300):
        g = np.array([(risk(x + e) - risk(x - e)) / 2e-5 for e in np.eye(len(x)) * 1e-5])
        y = x - step * g
        x, step = (y, step * 1.1) if risk(y) < risk(x) else (x, step / 2)
    assert risk(mine) <= risk(x) + 2e-3


def test_toxicity_features_and_scores_by_the_definition(spark):
    texts = documents(3, 300, (["calm", "quiet", "mild", "soft"], ["vileword", "nastyword", "uglyword", "badword"]))
    y = [i % 2 for i in range(300)]
    docs, labels = tables(spark, texts, y, "toxic")
    model = pu_toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in W.score(docs, model, W.word_prefixes).collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        _, f = W.word_prefixes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        z = sum(model.weights[k] for k, x in enumerate(model.features) if x in set(f.tolist())) + model.bias
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    # the unlabelled side holds every learned text, toxic ones too
    learned = [i for i in range(300) if cases.fold(i, 5) != 0]
    toxic = [texts[i] for i in learned if y[i]]
    everything = [texts[i] for i in learned]
    chosen = plain_selection(toxic + everything, [1] * len(toxic) + [0] * len(everything), plain_prefixes, 2048)
    assert len(chosen) == len(model.features) > 5


# ---------------------------------------------------------------- rows that look alike, rows without an id

def awkward(spark):
    docs = cases.frame(spark)
    again = docs.where("doc_id in (6, 10, 15, 15, 40)")
    return docs.unionByName(again).unionByName(again).unionByName(
        docs.where("doc_id in (2, 9, 12, 30)").withColumn("doc_id", F.lit(None).cast("long")))


def test_codec_and_packing_of_repeated_rows_and_null_ids(spark):
    docs = awkward(spark)
    rows = docs.select("doc_id", "text").collect()
    codec = B.Codec(open(B.default_path(), encoding="utf-8").read())

    def ids(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return codec.encode(raw, np.array([0, len(raw)]))[0].tolist()
    want = Counter((r.doc_id, len(ids(r.text))) for r in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in B.encode_digests(docs, B.default_path()).collect()) == want
    pieces = H.pack_documents(docs, B.default_path()).collect()
    seen = Counter()
    for r in rows:
        own, at = [*ids(r.text), 0], 0
        for m in [1024] * (len(own) // 1024) + H.cut_lengths(len(own) % 1024, 1024):
            seen[(r.doc_id, at, m, zlib.crc32(np.array(own[at:at + m], "<u4").tobytes()), len(own))] += 1
            at += m
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == seen
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_equal_pieces_are_dealt_to_all_buckets(spark):
    docs = spark.range(4000).selectExpr("5L AS doc_id", "'one short text' AS text")
    packed = H.pack_documents(docs, B.default_path())
    assert packed.count() == 4000 * len(H.cut_lengths(4, 1024))
    base = H.pieces(docs, B.default_path()).withColumn("row", F.monotonically_increasing_id())
    sizes = [r["count"] for r in base.groupBy(F.pmod(F.xxhash64("row"), F.lit(16)).alias("b")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16


def test_other_vocabularies_are_encoded_as_described_or_refused():
    text = open(B.default_path(), encoding="utf-8").read()
    spec = json.loads(text)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    codec = B.Codec(json.dumps(spec))
    from tokenizers import Tokenizer
    model = Tokenizer.from_str(json.dumps(spec))
    samples = ["Hello there, 12 times", "don't", "", "a<|endoftext|>b"]
    raw = [t.encode() for t in samples]
    ids, at = codec.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert not codec.cuttable
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [
        model.encode(t, add_special_tokens=False).ids for t in samples]
    spec["model"]["merges"] = spec["model"]["merges"][:-1]
    with pytest.raises(ValueError):
        B.Codec(json.dumps(spec))


def test_language_and_secrets_of_repeated_rows_and_null_ids(spark):
    docs = awkward(spark)
    model = X.fit(X.sample_texts(docs, F.lit(True), "doc_id", "text", "lang"))
    got = Counter((r.doc_id, r.lang_pred) for r in X.predict(docs, model).collect())
    once = {r.doc_id: r.lang_pred for r in X.predict(cases.frame(spark), model).collect()}
    assert sum(got.values()) == docs.count()
    for (i, lang), n in got.items():
        if i is not None:
            assert lang == once[i] and n == docs.where(F.col("doc_id") == i).count()
    secret = spark.createDataFrame([(None, "token=abcdefgh1"), (None, "x"), (4, "token=abcdefgh1"), (4, "token=abcdefgh1")],
                                   "doc_id long, text string")
    assert Counter((r.doc_id, r.n_assign, r.spans) for r in S.scan_digests(secret).collect()) == Counter(
        {(None, 1, "assign:0:15"): 1, (None, 0, ""): 1, (4, 1, "assign:0:15"): 2})


def test_classes_of_several_texts_under_one_id(spark):
    r = random.Random(6)
    text = " ".join(f"w{r.randrange(40)}" for _ in range(60))
    other = " ".join(f"v{r.randrange(40)}" for _ in range(60))
    rows = [(1, text), (1, other), (2, text + " end"), (3, other + " end"), (3, other + " end"), (4, "alone here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((x.id, x.component) for x in J.classes(docs, 3, 90).collect())
    assert got == Counter({(1, 1): 2, (2, 1): 1, (3, 1): 2, (4, 4): 1})


def test_pipeline_on_empty_null_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline as P

    def write(name, docs):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        (docs.select("doc_id", F.lit(0).alias("toxic"), F.lit(1).alias("quality"))
             .write.parquet(f"{folder}/labels.parquet"))
        return folder
    assert P.run(spark, write("empty", cases.empty(spark))).count() == 0
    docs = awkward(spark)
    out = P.run(spark, write("awkward", docs)).collect()
    # of equal texts the largest id stays (a null id only where no other bears the text), of similar ones the smallest
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    last = {}
    for i, t in rows:
        k = cases.lower(t)
        last[k] = i if k not in last or last[k] is None else max(last[k], i if i is not None else -1)
    classes = cases.jaccard_classes({i: t for t, i in last.items() if i is not None}, 5, 80)
    stay = {i for i, c in classes.items() if i == c}
    assert {p.doc_id for p in out} == stay | ({None} if None in last.values() else set())
    assert Counter((p.doc_id, p.start) for p in out if p.doc_id is not None).most_common(1)[0][1] == 1
