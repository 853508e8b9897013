"""Running sums and lags over range-partitioned tables; turn pairing of a hot conversation; length histograms."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from labelflow.operators.runs import RANGE, lagged, ranged, running
from labelflow.operators.tokens import length_histogram, profile_of, token_profile


def test_running_sums_equal_one_window(spark):
    r = random.Random(1)
    rows = [(r.choice([None, 1, 2]), i, r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i long, v long").repartition(5)
    order = [F.col("k").asc_nulls_last(), F.col("i")]
    got = running(ranged(df, order), order, {"n": F.lit(1), "s": F.col("v")}).collect()
    assert len({x[RANGE] for x in got}) > 1
    total, want = 0, {}
    for n, (k, i, v) in enumerate(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))):
        want[i] = (n, total)
        total += v
    assert {x.i: (x.n, x.s) for x in got} == want


def test_lag_crosses_ranges_and_not_keys(spark):
    rows = [(None if i < 3 else i // 400, i, f"t{i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "k int, i long, t string").repartition(7)
    table = ranged(df, [F.col("k"), F.col("i")])
    got = lagged(table, ["i"], "k", ["t"]).collect()
    assert len(got) == len(rows) and len({x[RANGE] for x in got}) == 8
    for n, x in enumerate(sorted(got, key=lambda x: x.i)):
        before = rows[n - 1] if n else None
        assert x.prev_t == (before[2] if before and before[0] == x.k else None)


def test_hot_conversation_spreads_over_tasks(spark):
    from labelflow.plans.catalog_text import assistant_vs_user

    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(3000)]
    turns += [(c, i, ("system", "user", "assistant")[i], f"c{c} {i}") for c in range(2, 300) for i in range(3)]
    turns += [(5, 9, "assistant", "no user before"), (None, 0, "user", "u"), (None, 1, "assistant", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    pairs = assistant_vs_user(df).collect()
    want = {(f"1-{i}-assistant", f"text {i}", f"text {i - 1}") for i in range(1, 3000, 2)}
    want |= {(f"{c}-2-assistant", f"c{c} 2", f"c{c} 1") for c in range(2, 300)} | {("x-1-assistant", "a", "u")}
    assert {(p.rid, p.hyp, p.ref) for p in pairs} == want and len(pairs) == len(want)
    hot = [p for p in pairs if p.rid.startswith("1-")]
    assert len({p[RANGE] for p in hot}) >= 4


def test_histograms_of_parts_add_up(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), " ".join("w" * r.randint(0, 60)) if r.random() < 0.9 else None) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, text string")
    whole = {x.g: x for x in token_profile(df, "text", by=("g",), limits=(40,), cut_at=40).collect()}
    parts = length_histogram(df.limit(300), "text", ("g",)).unionByName(
        length_histogram(df.exceptAll(df.limit(300)), "text", ("g",)))
    merged = parts.groupBy("g", "tokens").agg(F.sum("m").alias("m"))
    assert {x.g: x for x in profile_of(merged, ("g",), (40,), cut_at=40).collect()} == whole
    for g, x in whole.items():
        n = sorted(len((t or "").split()) for k, t in rows if k == g)
        assert (x.n, x.max_tokens, x.n_over_40) == (len(n), n[-1], sum(i > 40 for i in n))
        assert x.kept_tokens == sum(min(i, 40) for i in n) and x.all_tokens == sum(n)
        for p, v in ((0.5, x.p50), (0.95, x.p95), (0.99, x.p99)):
            assert v == n[math.ceil(round(p * len(n), 9)) - 1]
    assert token_profile(df.limit(0), "text", by=("g",)).collect() == []
