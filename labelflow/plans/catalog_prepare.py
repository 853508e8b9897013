"""Registered queries: sources/sinks, prepared tables, prompts, splits with
entity rows, pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.functions import prompts as P
from labelflow.functions.hashing import det_hash, det_hash_sql
from labelflow.functions.sqltext import sql_render
from labelflow.operators.options import prompt_options_company
from labelflow.operators.sampling import exact_split
from labelflow.plans import prepare as PR
from labelflow.plans.inputs import (CONV_SQL, LD_SQL, OPTS_SQL, conversation_examples,
                                    labelled_documents, rule_p, RULE_P_SQL)
from labelflow.plans.registry import register
from labelflow.session import scratch_path
from labelflow.sources import csv_io, nested
from labelflow.sources.tables import read_table

HD = det_hash_sql("doc_id")
HI = det_hash_sql("id")


def _docs(spark, sf):
    return read_table(spark, sf, "documents", "doc_id", "text", "lang", "source")


def _ld(spark, sf):
    return labelled_documents(_docs(spark, sf))


def _prepared(spark, sf, **kw):
    return PR.prepare_labelled_table(_ld(spark, sf), pos_col="doc_id", **kw)


def _conv(spark, sf):
    return conversation_examples(read_table(spark, sf, "conversations"))


COMPANY_PROMPT_SQL = sql_render(
    P.TOPIC_COMPANY, company_name="ld.company_name",
    company_specific="CASE ld.company_name " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in P.COMPANY_DESCRIPTIONS.items()) + " ELSE '' END",
    text="ld.sample_text", prompt="opts.prompt_options")
NO_COMPANY_PROMPT_SQL = sql_render(P.TOPIC_NO_COMPANY, text="ld.sample_text",
                                   prompt="opts.prompt_options")
ENTITY_PROMPT_SQL = sql_render(P.ENTITY_PROMPT, text="sample_text")

PREP_SQL = f"""{LD_SQL}, {OPTS_SQL},
prep AS (SELECT ld.*, opts.prompt_options, ld.class_name AS generator_labels,
                {COMPANY_PROMPT_SQL} AS generator_text,
                {NO_COMPANY_PROMPT_SQL} AS generator_text_no_company,
                ld.company_name AS dataset_name, 'classification' AS task
         FROM ld JOIN opts ON opts.company_name = ld.company_name),
sp AS (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {HD}, doc_id)
                            <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
       FROM documents)"""

ENT_SQL = f"""{CONV_SQL},
entr AS (SELECT id, sample_text, {ENTITY_PROMPT_SQL} AS generator_text,
                entity_action AS generator_labels, 'entity_extraction' AS task
         FROM cx WHERE entity_action IS NOT NULL),
esp AS (SELECT id, CASE WHEN row_number() OVER (ORDER BY {HI}, id)
                         <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
        FROM entr)"""

PAIRS_SQL = f"""tr AS (SELECT prep.* FROM prep JOIN sp USING (doc_id) WHERE sp.split = 'train'),
dd AS (SELECT class_name, sample_text, min(doc_id) AS doc_id FROM tr GROUP BY class_name, sample_text),
r AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY {HD}, doc_id) AS rnk FROM dd),
r8 AS (SELECT *, count(*) OVER (PARTITION BY class_name) AS c FROM r WHERE rnk <= 8),
pr AS (SELECT class_name, ((rnk + 1) // 2)::BIGINT AS pair_no,
              max(CASE WHEN rnk % 2 = 1 THEN doc_id END) AS first_id,
              max(CASE WHEN rnk % 2 = 0 THEN doc_id END) AS second_id,
              max(CASE WHEN rnk % 2 = 1 THEN sample_text END) AS a_text,
              max(CASE WHEN rnk % 2 = 0 THEN sample_text END) AS b_text
       FROM r8 WHERE rnk <= (c // 2) * 2 GROUP BY class_name, pair_no),
prt AS (SELECT pr.*, {sql_render(P.PAIR_PROMPT.replace('@@', '{a}').replace('$$', '{b}'),
                                 a='a_text', b='b_text')} AS generator_text FROM pr)"""


# ---------------------------------------------------------------- sources / sinks

@register("read_benchmark_table", "SELECT item_id, md5(text) AS text_md5, length(text)::BIGINT AS n_chars FROM benchmark")
def q_read_benchmark_table(spark, sf):
    b = read_table(spark, sf, "benchmark", "item_id", "text")
    return b.select("item_id", F.md5("text").alias("text_md5"),
                    F.length("text").cast("bigint").alias("n_chars"))


@register("explode_examples", f"""WITH {CONV_SQL}
SELECT company_name, (row_number() OVER (PARTITION BY company_name ORDER BY pos) - 1)::BIGINT AS pos,
       sample_text, class_name FROM cx""")
def q_explode_examples(spark, sf):
    nest = nested.nest_examples(_conv(spark, sf))
    # no stored positions: array order and the records' first positions only
    plain = nest.withColumn("Examples", F.transform("Examples", lambda e: e.dropFields("pos")))
    return nested.explode_examples(plain).select("company_name", "pos", "sample_text", "class_name")


EX_SUM_SQL = det_hash_sql("CAST(doc_id AS VARCHAR) || '|' || sample_text || '|' || class_name || '|' || "
                          "CAST(class_number AS VARCHAR)")


@register("write_nested_dataset", f"""WITH {LD_SQL}
SELECT company_name, count(*)::BIGINT AS n_examples, sum({EX_SUM_SQL})::BIGINT AS examples_checksum
FROM ld GROUP BY company_name""")
def q_write_nested_dataset(spark, sf):
    nest = nested.nest_examples(_ld(spark, sf), pos_col="doc_id")
    path = scratch_path(spark, "nested")
    nested.write_nested_dataset(nest, path)
    back = nested.explode_examples(nested.read_nested_dataset(spark, path, multi_line=False))
    # order-sensitive checksum per company: a sum, so no company is gathered
    line = F.concat_ws("|", F.col("pos").cast("string"), "sample_text", "class_name",
                       F.col("class_number").cast("string"))
    return back.groupBy("company_name").agg(F.count(F.lit(1)).alias("n_examples"),
                                            F.sum(det_hash(line)).alias("examples_checksum"))


@register("read_nested_dataset", f"""WITH {CONV_SQL}
SELECT company_name, pos, sample_text, class_name, class_number, entity_action FROM cx""")
def q_read_nested_dataset(spark, sf):
    flat = _conv(spark, sf)
    path = scratch_path(spark, "nested-conv")
    nested.write_nested_dataset(nested.nest_examples(flat, entity_col="entity_action"), path)
    back = nested.read_nested_dataset(spark, path, multi_line=False)
    return nested.explode_examples(back)


CSV_SQL = f"""WITH {RULE_P_SQL}
SELECT rp.raw_prediction AS prediction, rp.y,
       d.text AS text, 'row ' || CAST(rp.doc_id AS VARCHAR) AS prompt
FROM rp JOIN documents d USING (doc_id)"""


@register("read_predictions_csv", CSV_SQL)
def q_read_predictions_csv(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "lang", "source", "n_chars", "text")
    preds = rule_p(docs).join(docs.select("doc_id", "text"), "doc_id").select(
        F.col("raw_prediction").alias("prediction"), "y",
        F.col("text"),
        F.concat(F.lit("row "), F.col("doc_id").cast("string")).alias("prompt"))
    path = scratch_path(spark, "predictions-csv")
    csv_io.write_csv(preds, path)
    back = csv_io.read_predictions_csv(spark, path, "prediction string, y string, text string, "
                                                     "prompt string")
    return back


@register("write_csv", f"""WITH {RULE_P_SQL}
SELECT dataset_name, count(*)::BIGINT AS n, count(DISTINCT prediction)::BIGINT AS n_predictions
FROM rp GROUP BY dataset_name""")
def q_write_csv(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "lang", "source", "n_chars")
    preds = rule_p(docs).select("doc_id", "y", "prediction", "dataset_name")
    path = scratch_path(spark, "report-csv")
    csv_io.write_csv(preds, path)
    back = csv_io.read_predictions_csv(spark, path, "doc_id bigint, y string, prediction string, "
                                                     "dataset_name string")
    return back.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"),
                                            F.countDistinct("prediction").alias("n_predictions"))


# ---------------------------------------------------------------- filters / projections

@register("filter_datasets", f"""WITH {LD_SQL}
SELECT doc_id, company_name, class_name FROM ld WHERE company_name IN ('src1', 'src2', 'src3')""")
def q_filter_datasets(spark, sf):
    nest = nested.nest_examples(_ld(spark, sf), pos_col="doc_id")
    kept = nested.filter_datasets(nest, "src1 src2 src3")
    # the stored example positions are the doc ids
    return nested.explode_examples(kept).select(F.col("pos").alias("doc_id"), "company_name",
                                                "class_name")


@register("prepare_labelled_table", f"""WITH {PREP_SQL}
SELECT doc_id, company_name, class_name, class_number, generator_labels,
       md5(prompt_options) AS options_md5, md5(generator_text) AS text_md5,
       md5(generator_text_no_company) AS text_nc_md5, dataset_name, task FROM prep""")
def q_prepare_labelled_table(spark, sf):
    p = _prepared(spark, sf)
    return p.select("doc_id", "company_name", "class_name", "class_number", "generator_labels",
                    F.md5("prompt_options").alias("options_md5"),
                    F.md5("generator_text").alias("text_md5"),
                    F.md5("generator_text_no_company").alias("text_nc_md5"),
                    "dataset_name", "task")


@register("prompt_options_company", f"""WITH {LD_SQL}, {OPTS_SQL}
SELECT company_name AS group_key, 'numbered' AS variant, prompt_options FROM opts
UNION ALL
SELECT company_name, 'bullet', chr(10) || '        OPTIONS:' || chr(10) || '        '
       || string_agg('% ' || class_name || ' ' || chr(10), '' ORDER BY p) || chr(10) || '    '
FROM fc GROUP BY company_name""")
def q_prompt_options_company(spark, sf):
    ld = _ld(spark, sf)
    a = prompt_options_company(ld, "company_name", "class_name", "class_number", "doc_id")
    b = prompt_options_company(ld, "company_name", "class_name", "class_number", "doc_id",
                               bullet="%")
    return (a.select(F.col("company_name").alias("group_key"), F.lit("numbered").alias("variant"),
                     "prompt_options")
             .unionByName(b.select(F.col("company_name").alias("group_key"),
                                   F.lit("bullet").alias("variant"), "prompt_options")))


def _prompt_query(expr_sql: str):
    return f"""WITH {PREP_SQL}
SELECT ld.doc_id, md5({expr_sql}) AS prompt_md5, length({expr_sql})::BIGINT AS prompt_len
FROM ld JOIN opts ON opts.company_name = ld.company_name"""


@register("build_prompt", _prompt_query(COMPANY_PROMPT_SQL))
def q_build_prompt(spark, sf):
    p = _prepared(spark, sf)
    return p.select("doc_id", F.md5("generator_text").alias("prompt_md5"),
                    F.length("generator_text").cast("bigint").alias("prompt_len"))


@register("entity_prompt", _prompt_query(sql_render(P.ENTITY_PROMPT, text="ld.sample_text")))
def q_entity_prompt(spark, sf):
    e = P.entity_prompt("sample_text")
    return _ld(spark, sf).select("doc_id", F.md5(e).alias("prompt_md5"),
                                 F.length(e).cast("bigint").alias("prompt_len"))


@register("json_request_prompt", _prompt_query(sql_render(
    P.JSON_REQUEST_PROMPT,
    options="opts.prompt_options", txt="ld.sample_text")))
def q_json_request_prompt(spark, sf):
    p = _prepared(spark, sf)
    e = P.json_request_prompt("prompt_options", "sample_text")
    return p.select("doc_id", F.md5(e).alias("prompt_md5"), F.length(e).cast("bigint").alias("prompt_len"))


# ---------------------------------------------------------------- entity rows, unions, splits

def _entity(spark, sf):
    return PR.entity_dataset(_conv(spark, sf))


@register("entity_dataset", f"""WITH {ENT_SQL}
SELECT id, generator_labels, task, md5(generator_text) AS text_md5 FROM entr""")
def q_entity_dataset(spark, sf):
    return _entity(spark, sf).select("id", "generator_labels", "task",
                                     F.md5("generator_text").alias("text_md5"))


def _preprocess(spark, sf):
    prep = _prepared(spark, sf).withColumnRenamed("doc_id", "id")
    ent = _entity(spark, sf).select("id", "sample_text", "generator_text", "generator_labels",
                                    "task", "generator_text_no_company")
    return PR.preprocess(prep, "id", entity=ent)


MULTI_SQL = f"""WITH {PREP_SQL}, {ENT_SQL},
cls AS (SELECT prep.doc_id AS id, prep.sample_text, prep.generator_text, prep.generator_labels,
               prep.task, sp.split FROM prep JOIN sp USING (doc_id)
        WHERE prep.sample_text NOT IN (SELECT sample_text FROM entr)),
ents AS (SELECT entr.id, entr.sample_text, entr.generator_text, entr.generator_labels, entr.task,
                esp.split FROM entr JOIN esp USING (id)),
allr AS (SELECT * FROM cls UNION ALL SELECT * FROM ents)"""


@register("preprocess", f"""{MULTI_SQL}, {PAIRS_SQL}
SELECT split, task, id, md5(generator_text) AS text_md5, generator_labels FROM allr
UNION ALL
SELECT 'pairs', NULL, first_id, md5(generator_text), 'yes' FROM prt""")
def q_preprocess(spark, sf):
    prep = _prepared(spark, sf).withColumnRenamed("doc_id", "id")
    ent = _entity(spark, sf).select("id", "sample_text", "generator_text", "generator_labels",
                                    "task", "generator_text_no_company")
    table, pairs = PR.preprocess_table(prep, "id", entity=ent)
    cols = ["task", "id", F.md5("generator_text").alias("text_md5"), "generator_labels"]
    return (table.select("split", *cols)
                 .unionByName(pairs.select(F.lit("pairs").alias("split"),
                                           F.lit(None).cast("string").alias("task"),
                                           F.col("first_id").alias("id"),
                                           F.md5("generator_text").alias("text_md5"),
                                           "generator_labels")))


@register("multi_task_union", f"""{MULTI_SQL}
SELECT task, id, md5(generator_text) AS text_md5, generator_labels FROM cls WHERE split = 'train'
UNION ALL SELECT task, id, md5(generator_text), generator_labels FROM entr""")
def q_multi_task_union(spark, sf):
    prep = _prepared(spark, sf).withColumnRenamed("doc_id", "id")
    train = exact_split(prep, "id").filter(F.col("split") == "train").drop("split")
    u = PR.multi_task_union(train, _entity(spark, sf))
    return u.select("task", "id", F.md5("generator_text").alias("text_md5"), "generator_labels")


@register("filter_tasks", f"""{MULTI_SQL}
SELECT task, id, md5(generator_text) AS text_md5 FROM allr WHERE task IN ('entity_extraction')""")
def q_filter_tasks(spark, sf):
    train, test, _ = _preprocess(spark, sf)
    both = train.unionByName(test)
    f = PR.filter_tasks(both.withColumn("text_md5", F.md5("generator_text")),
                        ["entity_extraction"], "id", "text_md5")
    return f.select(F.lit("entity_extraction").alias("task"), "id", "text_md5")


@register("augment_with_pairs", f"""{MULTI_SQL}, {PAIRS_SQL}
SELECT task, id, md5(generator_text) AS text_md5, generator_labels FROM allr WHERE split = 'train'
UNION ALL SELECT NULL, NULL, md5(generator_text), 'yes' FROM prt""")
def q_augment_with_pairs(spark, sf):
    train, _, pairs = _preprocess(spark, sf)
    a = PR.augment_with_pairs(train, pairs)
    return a.select("task", "id", F.md5("generator_text").alias("text_md5"), "generator_labels")


@register("same_intent_pairs", f"""WITH {PREP_SQL}, {PAIRS_SQL}
SELECT class_name, pair_no, first_id, second_id FROM pr""")
def q_same_intent_pairs(spark, sf):
    prep = _prepared(spark, sf)
    train = exact_split(prep, "doc_id").filter(F.col("split") == "train")
    return PR.same_intent_pairs(train).select("class_name", "pair_no", "first_id", "second_id")


@register("leak_anti_join", f"""WITH {PREP_SQL}
SELECT d.doc_id FROM documents d JOIN sp USING (doc_id) WHERE sp.split = 'train'
AND NOT EXISTS (SELECT 1 FROM documents o JOIN sp t USING (doc_id)
                WHERE t.split = 'test' AND o.text = d.text)""")
def q_leak_anti_join(spark, sf):
    d = read_table(spark, sf, "documents", "doc_id", "text")
    s = exact_split(d, "doc_id")
    train = s.filter(F.col("split") == "train")
    test = s.filter(F.col("split") == "test")
    return PR.leak_anti_join(train, test, "text").select("doc_id")


@register("dataset_stats", f"""WITH {PREP_SQL}
SELECT ld.company_name, count(*) AS n_samples, count(*) FILTER (WHERE sp.split = 'train') AS n_train,
       count(*) FILTER (WHERE sp.split = 'test') AS n_test
FROM ld JOIN sp USING (doc_id) GROUP BY ld.company_name""")
def q_dataset_stats(spark, sf):
    s = exact_split(_ld(spark, sf), "doc_id")
    return PR.dataset_stats(s)


@register("project_training_columns", f"""WITH {PREP_SQL}
SELECT md5(generator_text_no_company) AS text, generator_labels AS label FROM prep""")
def q_project_training_columns(spark, sf):
    p = PR.project_training_columns(_prepared(spark, sf))
    return p.select(F.md5("text").alias("text"), "label")
