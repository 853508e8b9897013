"""Property-based checks (few examples each: every example is a Spark job)."""

from __future__ import annotations

import difflib
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelflow.operators import sampling as S
from labelflow.operators.matching import closest_label

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(n=st.integers(0, 400), classes=st.integers(1, 5), frac=st.sampled_from([0.1, 0.2, 0.25, 0.5, 0.9]),
       bits=st.integers(1, 8))
def test_stratified_split_exact_per_class(spark, n, classes, frac, bits):
    df = spark.range(n).select(F.col("id").alias("rid"), (F.col("id") % classes).alias("cls"))
    out = S.exact_split(df, "rid", frac, by=("cls",), bits=bits)
    got = {r.cls: (r.n, r.t) for r in out.groupBy("cls").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()}
    assert sum(v[0] for v in got.values()) == n
    for size, test in got.values():
        assert test == math.ceil(frac * size)


WORDS = st.text(alphabet="abcde ", min_size=0, max_size=8)


@SETTINGS
@given(preds=st.lists(WORDS, min_size=1, max_size=6), labels=st.lists(WORDS, min_size=1, max_size=6))
def test_closest_label_equals_difflib(spark, preds, labels):
    p = spark.createDataFrame([(i, x) for i, x in enumerate(preds)], "i long, p string")
    lab = spark.createDataFrame([(x,) for x in labels], "l string")
    got = {r.i: r.c for r in closest_label(p, "p", lab, "l", out_col="c").collect()}
    labs = sorted(set(labels))
    want = {i: (x if x in labs else difflib.get_close_matches(x, labs, n=1, cutoff=0.0)[0])
            for i, x in enumerate(preds)}
    assert got == want


def _tok13a(s: str) -> list[str]:
    import re

    x = s.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = x.replace(a, b)
    x = f" {x} "
    x = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", x)
    x = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", x)
    x = re.sub(r"([\.,])([^0-9])", r" \1 \2", x)
    x = re.sub(r"([0-9])(-)", r"\1 \2 ", x)
    return x.split()


def _bleu_py(pairs) -> float:
    from collections import Counter

    sys_len = ref_len = 0
    correct, total = [0] * 4, [0] * 4
    for h, r in pairs:
        ht, rt = _tok13a(h), _tok13a(r)
        sys_len, ref_len = sys_len + len(ht), ref_len + len(rt)
        for n in range(1, 5):
            hc = Counter(tuple(ht[i:i + n]) for i in range(len(ht) - n + 1))
            rc = Counter(tuple(rt[i:i + n]) for i in range(len(rt) - n + 1))
            correct[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            total[n - 1] += max(0, len(ht) - n + 1)
    if not any(correct) or not all(total):
        return 0.0
    bp = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len)
    logs, k = 0.0, 1.0
    for c, t in zip(correct, total):
        if c == 0:
            k *= 2
            logs += math.log(100.0 / (k * t))
        else:
            logs += math.log(100.0 * c / t)
    return bp * math.exp(logs / 4)


SENT = st.lists(st.sampled_from(["the", "cat", "sat", "on", "mat", "3.5", "a,b", "x-1", "(", ")", "!",
                                 "dog", "&amp;", "end."]), min_size=0, max_size=12).map(" ".join)


# half the references extend their hypothesis, so most corpora score above 0
PAIR = st.one_of(st.tuples(SENT, SENT), st.tuples(SENT, SENT).map(lambda p: (p[0], f"{p[0]} {p[1]}")))


@SETTINGS
@given(pairs=st.lists(PAIR, min_size=1, max_size=5))
def test_corpus_bleu_equals_python(spark, pairs):
    from labelflow.operators.bleu import corpus_bleu

    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "id long, h string, r string")
    got = corpus_bleu(df, "h", "r", "id").first().score
    assert math.isclose(got, round(_bleu_py(pairs), 6), abs_tol=1e-6)


def test_python_twin_scores_overlap():
    # guards the property above against only ever comparing zeros
    assert _bleu_py([("the cat sat on the mat", "the cat sat on the mat today")]) > 50
