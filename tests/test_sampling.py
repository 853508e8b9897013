"""Deterministic sampling and exact splits."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from labelflow.operators import sampling as S


@pytest.mark.parametrize("n", [0, 1, 7, 100, 1003])
def test_exact_split_size(spark, n):
    df = spark.range(n).withColumnRenamed("id", "rid")
    out = S.exact_split(df, "rid", 0.2, bits=4)
    rows = out.collect()
    assert len(rows) == n
    assert sum(r.split == "test" for r in rows) == math.ceil(0.2 * n)


def test_exact_split_is_hash_order_prefix(spark):
    df = spark.range(500).withColumnRenamed("id", "rid")
    from labelflow.functions.hashing import det_hash
    hashed = sorted((r.h, r.rid) for r in df.select("rid", det_hash("rid").alias("h")).collect())
    want = {rid for _, rid in hashed[:100]}
    got = {r.rid for r in S.exact_split(df, "rid", 0.2, bits=3).filter("split = 'test'").collect()}
    assert got == want


def test_stratified_split_per_class(spark):
    df = spark.range(300).select(F.col("id").alias("rid"), (F.col("id") % 7).alias("cls"))
    res = S.stratified_split(df, "rid", "cls", 0.25).groupBy("cls").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).alias("t"))
    for r in res.collect():
        assert r.t == math.ceil(0.25 * r.n)


def test_seeded_shuffle_is_a_permutation(spark):
    df = spark.range(257).withColumnRenamed("id", "rid")
    pos = [r.pos for r in S.seeded_shuffle(df, "rid", bits=3).collect()]
    assert sorted(pos) == list(range(1, 258))


def test_top_k_per_group_and_strict(spark):
    df = spark.range(40).select(F.col("id").alias("rid"), (F.col("id") % 3).alias("cls"))
    got = S.stratified_sample(df, "cls", 5, "rid").groupBy("cls").count().collect()
    assert sorted(r["count"] for r in got) == [5, 5, 5]
    with pytest.raises(Exception):
        S.stratified_sample(df, "cls", 50, "rid", strict=True).collect()


def test_dedup_first_keeps_smallest_order(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "o long, text string")
    assert sorted(tuple(r) for r in S.dedup_first(df, "text", "o").collect()) == [(1, "a"), (2, "b")]


def test_fixed_sample_exact_size(spark):
    df = spark.range(1000).withColumnRenamed("id", "rid")
    assert S.fixed_sample(df, "rid", 37).count() == 37


def test_dedup_first_settles_ties_nulls_and_repeated_rows(spark):
    rows = [(1, "a", "y"), (1, "a", "x"), (2, "a", "z"), (5, None, "n"), (4, None, "m"), (3, "b", "p"), (3, "b", "p"), (9, "c", "q")]
    df = spark.createDataFrame(rows, "o long, text string, extra string").repartition(3)
    got = sorted(tuple(r) for r in S.dedup_first(df, "text", "o").collect())
    assert len(got) == 4
    assert {(o, t) for o, t, _ in got} == {(1, "a"), (3, "b"), (4, None), (9, "c")}
    again = sorted(tuple(r) for r in S.dedup_first(df.repartition(5), "text", "o").collect())
    assert again == got


def test_verdicts_exchange_no_text(spark, sf_dir):
    """Plans of dedup_first and leak_anti_join: texts are in no exchange."""
    from labelflow.plans.prepare import leak_anti_join
    from labelflow.sources.tables import read_table

    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    for out in (S.dedup_first(d, "text", "doc_id"), leak_anti_join(d, d.where("doc_id < 9"), "text")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_seeded_shuffle_with_null_repeated_and_equal_rows(spark):
    from labelflow.functions.hashing import det_hash

    rows = [(None, f"n{i}") for i in range(20_000)] + [(7, f"r{i}") for i in range(6000)] + [(8, "same")] * 6000
    rows += [(i, "x") for i in range(100, 8100)]
    df = spark.createDataFrame(rows, "rid long, t string").repartition(6)
    got = S.seeded_shuffle(df, "rid", bits=6).collect()
    assert sorted(r.pos for r in got) == list(range(1, len(rows) + 1))
    # ids stand in hash order, missing ids after all others
    h = {r.rid: r.h for r in df.select("rid", det_hash("rid").alias("h")).distinct().collect()}
    order = [r.rid for r in sorted(got, key=lambda r: r.pos)]
    known = [i for i in order if i is not None]
    assert order[len(known):] == [None] * 20_000
    assert known == sorted(known, key=lambda i: (h[i], i))
    rerun = S.seeded_shuffle(df.repartition(3, "t"), "rid", bits=6).collect()
    assert sorted((r.pos, r.rid or 0, r.t) for r in got) == sorted((r.pos, r.rid or 0, r.t) for r in rerun)
    sizes = [r["count"] for r in S._shuffle_keys(df.where("rid is null"), "rid", 42, 6).groupBy("_b").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * sum(sizes) / 64


def test_top_k_beyond_the_group_limit(spark):
    df = spark.range(12_000).select(F.col("id").alias("rid"), (F.col("id") % 2).alias("cls"))
    out = S.top_k_per_group(df, "cls", 3000, "rid")
    want = {}
    from labelflow.functions.hashing import det_hash
    for r in df.select("rid", "cls", det_hash("rid").alias("h")).collect():
        want.setdefault(r.cls, []).append((r.h, r.rid))
    got = {}
    for r in out.collect():
        got.setdefault(r.cls, {})[r.rnk] = r.rid
    for c, rows in want.items():
        assert got[c] == {i + 1: rid for i, (_, rid) in enumerate(sorted(rows)[:3000])}
    # classes are ranked in parts before any window over a whole class
    plan = S.top_k_per_group(df, "cls", 3000, "rid")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [row_number()") == 2 and "_part" in plan
