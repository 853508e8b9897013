"""Dictionaries read through Spark from JSON files, and the flows over them."""

import json

import pytest

from labelflow.operators.matching import relabel_expanded
from labelflow.plans.fewshot import retrieve
from labelflow.sources import taxonomy as TX


def _file(tmp_path, value):
    path = tmp_path / "labels.json"
    path.write_text(json.dumps(value, indent=1), encoding="utf-8")
    return str(path)


def test_taxonomy_file_equals_the_dictionary(spark, tmp_path):
    got = TX.read_taxonomy(spark, _file(tmp_path, TX.ATIS_TAXONOMY), "atis")
    want = TX.taxonomy_dim(spark, TX.ATIS_TAXONOMY, "atis")
    assert got.columns == want.columns
    assert sorted(got.collect()) == sorted(want.collect())
    rows = spark.createDataFrame([(1, "flight"), (2, "no such key"), (3, "meal")], "id int, label string")
    mapped = TX.map_labels(rows, "label", got)
    assert {r.id: r.label for r in mapped.collect()} == {
        1: "Flight Booking Request", 3: "Inquiry about In-flight Meals"}


def test_hierarchy_file_counts_a_name_in_each_group(spark, tmp_path):
    groups = {"fares": ["airfare", "cheapest"], "all": ["airfare", "meal"]}
    h = TX.read_hierarchy(spark, _file(tmp_path, groups))
    assert sorted(h.collect()) == sorted(TX.hierarchy_dim(spark, groups).collect())
    rows = spark.createDataFrame([("airfare",), ("airfare",), ("meal",), ("city",)], "name string")
    assert {r.l2: r.n for r in TX.l2_rollup(rows, "name", h).collect()} == {"fares": 2, "all": 3, None: 1}


def test_broken_dictionary_fails(spark, tmp_path):
    path = tmp_path / "broken.json"
    path.write_text('{"a": "b"', encoding="utf-8")
    with pytest.raises(Exception):
        TX.read_taxonomy(spark, str(path)).collect()


def test_expansion_accepts_the_extra_names(spark):
    exp = TX.expansion_dim(spark, TX.BANKING_EXPANSION)
    rows = spark.createDataFrame([("22", "stolen"), ("22", "other"), ("21", "stolen")], "y string, prediction string")
    got = [(r.y, r.prediction) for r in relabel_expanded(rows, exp, "y", "prediction").collect()]
    assert sorted(got) == [("21", "stolen"), ("22", "other"), ("stolen", "stolen")]


def test_retrieve_over_a_separate_test_table(spark):
    train = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], f"c{i % 2}") for i in range(20)],
                                  "vec_id bigint, embedding array<double>, label string")
    test = spark.createDataFrame([(100, [0.9, 0.1], "c1"), (3, [0.2, 0.8], "c0")], train.schema)
    ranked, queries = retrieve(train, "vec_id", "embedding", "label", None, 2, 1, test=test)
    assert {r.vec_id: r.category for r in ranked.collect()} == {100: "c1", 3: "c0"}
    assert sorted(r.vec_id for r in queries.collect()) == [3, 100]
