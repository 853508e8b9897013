"""Sources and sinks: CSV with quoted newlines, nested JSON (hand-made
array files and the bounded records the writer produces)."""

from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from labelflow.sources import csv_io, nested


def _tmp():
    return tempfile.mkdtemp(prefix="labelflow-test-")


def test_csv_round_trip_keeps_newlines_commas_quotes(spark):
    rows = [("a", "x", 'line one\nline "two", and more', "p1", "o", "orig"),
            ("b", "y", "plain", "p2", None, None)]
    df = spark.createDataFrame(rows, csv_io.PREDICTION_SCHEMA)
    path = os.path.join(_tmp(), "preds")
    csv_io.write_csv(df, path)
    back = csv_io.read_predictions_csv(spark, path)
    assert sorted(back.collect(), key=lambda r: r["prediction"]) == sorted(df.collect(), key=lambda r: r["prediction"])


def test_read_hand_made_json_array(spark):
    data = [
        {"Company Name": "acme", "Taxonomy": [],
         "Examples": [{"sample_text": "hi", "class": "greet", "class number": 1},
                      {"sample_text": "bye", "class": "leave", "class number": 2, "entity_action": "go"}]},
        {"Company Name": "beta", "Taxonomy": {},
         "Examples": [{"sample_text": "yo", "class": "greet", "class number": 1}]},
    ]
    path = os.path.join(_tmp(), "ds.json")
    with open(path, "w") as f:
        json.dump(data, f, indent=2)
    nd = nested.read_nested_dataset(spark, path)
    assert nested.filter_datasets(nd, "beta").count() == 1
    ex = nested.explode_examples(nd).orderBy("company_name", "pos").collect()
    assert [(r.company_name, r.pos, r.sample_text, r.class_name, r.class_number, r.entity_action)
            for r in ex] == [("acme", 0, "hi", "greet", 1, None), ("acme", 1, "bye", "leave", 2, "go"),
                             ("beta", 0, "yo", "greet", 1, None)]


def test_nested_writer_bounds_records_and_keeps_positions(spark):
    flat = spark.range(0, 250).select(
        F.when(F.col("id") < 200, F.lit("big")).otherwise(F.lit("small")).alias("company_name"),
        F.col("id").alias("pos"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("sample_text"),
        F.lit("c").alias("class_name"), F.lit(1).alias("class_number"))
    nest = nested.nest_examples(flat, max_examples=32)
    assert nest.select(F.max(F.size("Examples"))).first()[0] <= 32
    path = os.path.join(_tmp(), "nested")
    nested.write_nested_dataset(nest, path)
    back = nested.explode_examples(nested.read_nested_dataset(spark, path, multi_line=False))
    got = sorted((r.company_name, r.pos, r.sample_text) for r in back.collect())
    want = sorted((r.company_name, r.pos, r.sample_text) for r in flat.collect())
    assert got == want


def _without_pos(nest):
    return nest.withColumn("Examples", F.transform("Examples", lambda e: e.dropFields("pos")))


def test_positions_go_on_from_record_to_record(spark):
    spread = {"five": [0, 1, 2, 3, 4], "gaps": [1, 4, 5, 6, 20, 21], None: [7, 8, 9], "one": [3]}
    flat = spark.createDataFrame([(c, p, f"{c} {i}") for c, ps in spread.items() for i, p in enumerate(ps)],
                                 "company_name string, pos long, sample_text string")
    flat = flat.withColumns({"class_name": F.lit("c"), "class_number": F.lit(1)})
    nest = nested.nest_examples(flat, max_examples=2)
    assert nest.select(F.max(F.size("Examples"))).first()[0] == 2
    want = sorted((str(c), i, f"{c} {i}") for c, ps in spread.items() for i in range(len(ps)))
    path = os.path.join(_tmp(), "nested")
    nested.write_nested_dataset(_without_pos(nest), path)
    for n in (_without_pos(nest), nested.read_nested_dataset(spark, path, multi_line=False)):
        got = nested.explode_examples(n).collect()
        assert sorted((str(r.company_name), r.pos, r.sample_text) for r in got) == want


def test_company_in_several_records_needs_positions(spark):
    flat = spark.range(5).selectExpr("'five' AS company_name", "id AS pos", "'t' AS sample_text",
                                     "'c' AS class_name", "1 AS class_number")
    nest = nested.nest_examples(flat, max_examples=2).drop("First Position")
    assert sorted(r.pos for r in nested.explode_examples(nest).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="several records without a first position: five"):
        nested.explode_examples(_without_pos(nest)).collect()


def test_records_are_bounded_by_examples_and_bytes(spark, tmp_path):
    rows = [("a", None, f"null position {i}", "x", 1) for i in range(300)]
    rows += [("a", 7, f"one position {i}", "x", 1) for i in range(200)]
    rows += [("b", i, "y" * 100_000, "x", 1) for i in range(30)] + [(None, 5, "no company", "x", 1), (None, 4, None, "x", 1)]
    rows += [("c", i, f"c{i}", "x", 1) for i in range(10)]
    flat = spark.createDataFrame(rows, "company_name string, pos long, sample_text string, class_name string, "
                                       "class_number int").repartition(5)
    nest = nested.nest_examples(flat, max_examples=32, max_bytes=500_000)
    records = nest.select("Company Name", "Examples", "First Position").collect()
    for r in records:
        assert 1 <= len(r.Examples) <= 32
        assert sum(len(e.sample_text or "") for e in r.Examples) <= 500_000 + 100_000
    assert len([r for r in records if r["Company Name"] == "b"]) >= 6
    # first positions and array positions number every company's examples without gaps
    for name in ("a", "b", "c", None):
        mine = [r for r in records if r["Company Name"] == name]
        at = sorted(r["First Position"] + i for r in mine for i in range(len(r.Examples)))
        assert at == list(range(len([x for x in rows if x[0] == name])))
    path = str(tmp_path / "records")
    nested.write_nested_dataset(nest, path)
    back = nested.explode_examples(nested.read_nested_dataset(spark, path, multi_line=False))
    assert sorted(((r.company_name, r.sample_text) for r in back.collect()), key=str) == sorted(((x[0], x[2]) for x in rows), key=str)
    places = [r.pos for r in back.where("company_name = 'a' and sample_text like 'null%'").collect()]
    assert sorted(places) == list(range(200, 500))           # null positions come last and are numbered on
