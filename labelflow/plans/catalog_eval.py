"""Registered queries: evaluation over rule-P predictions (see inputs.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.functions import text as tx
from labelflow.operators import metrics as M
from labelflow.operators.options import prompt_options_company
from labelflow.plans.inputs import (LD_SQL, OPTS_SQL, RULE_P_SQL,
                                    labelled_documents, option_texts_sql, rule_p, strip_sql)
from labelflow.plans.registry import register
from labelflow.plans.sqlgen import report_sql
from labelflow.sources.tables import read_table


def _rp(spark, sf):
    return rule_p(read_table(spark, sf, "documents", "doc_id", "lang", "source", "n_chars"))


@register("confusion_matrix", f"""WITH {RULE_P_SQL}
SELECT y, prediction, count(*) AS n FROM rp GROUP BY y, prediction""")
def q_confusion(spark, sf):
    return M.confusion_matrix(_rp(spark, sf))


@register("classification_report", f"WITH {RULE_P_SQL},\n{report_sql('rp')}\nSELECT * FROM report")
def q_report(spark, sf):
    return M.classification_report(_rp(spark, sf))


@register("report_per_dataset",
          f"WITH {RULE_P_SQL},\n{report_sql('rp', by=('dataset_name',))}\nSELECT * FROM report")
def q_report_per_dataset(spark, sf):
    return M.report_per_dataset(_rp(spark, sf))


@register("weighted_prf", f"""WITH {RULE_P_SQL},\n{report_sql('rp')}
SELECT precision, recall, f1_score AS f1 FROM report WHERE id = 'weighted avg'""")
def q_weighted_prf(spark, sf):
    return M.weighted_prf(_rp(spark, sf))


@register("accuracy", f"""WITH {RULE_P_SQL}
SELECT round(avg(CASE WHEN y IS NOT DISTINCT FROM prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM rp""")
def q_accuracy(spark, sf):
    return M.accuracy(_rp(spark, sf))


@register("prefix_metrics", f"""WITH {RULE_P_SQL},\n{report_sql('rp')}
SELECT precision AS val_precision, recall AS val_recall, f1_score AS val_f1
FROM report WHERE id = 'weighted avg'""")
def q_prefix_metrics(spark, sf):
    return M.prefix_metrics(M.weighted_prf(_rp(spark, sf)), "val_")


@register("leaderboard", f"""WITH {RULE_P_SQL},\n{report_sql('rp', by=('dataset_name', 'model_name'))},
wide AS (SELECT dataset_name, model_name,
                max(CASE WHEN id = 'weighted avg' THEN f1_score END) AS weighted_f1,
                max(CASE WHEN id = 'accuracy' THEN precision END) AS accuracy
         FROM report GROUP BY dataset_name, model_name)
SELECT *, rank() OVER (PARTITION BY dataset_name ORDER BY weighted_f1 DESC, model_name)::BIGINT AS rnk
FROM wide""")
def q_leaderboard(spark, sf):
    return M.leaderboard(_rp(spark, sf))


@register("value_counts", f"""WITH {RULE_P_SQL}
SELECT prediction, count(*) AS n FROM rp GROUP BY prediction""")
def q_value_counts(spark, sf):
    return M.value_counts(_rp(spark, sf), "prediction")


@register("distinct_labels", f"""WITH {RULE_P_SQL}
SELECT DISTINCT prediction AS label FROM rp""")
def q_distinct_labels(spark, sf):
    return M.distinct_labels(_rp(spark, sf), "prediction")


@register("error_rows", f"""WITH {RULE_P_SQL}
SELECT doc_id, y, prediction FROM rp WHERE y IS DISTINCT FROM prediction""")
def q_error_rows(spark, sf):
    return M.error_rows(_rp(spark, sf)).select("doc_id", "y", "prediction")


@register("extract_class_name", f"""WITH {RULE_P_SQL}
SELECT doc_id, prediction AS value FROM rp""")
def q_extract_class_name(spark, sf):
    return _rp(spark, sf).select("doc_id", tx.extract_class_name("raw_prediction").alias("value"))


@register("normalize_label", f"""WITH {RULE_P_SQL}
SELECT doc_id, {strip_sql('lower(raw_prediction)')} AS value FROM rp""")
def q_normalize_label(spark, sf):
    return _rp(spark, sf).select("doc_id", tx.normalize_label("raw_prediction").alias("value"))


@register("strip_class_prefix", f"""WITH {RULE_P_SQL}
SELECT doc_id, replace(raw_prediction, 'Class name: ', '') AS value FROM rp""")
def q_strip_class_prefix(spark, sf):
    return _rp(spark, sf).select("doc_id", tx.strip_class_prefix("raw_prediction").alias("value"))


def _rp_with_options(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "lang", "source", "text", "n_chars")
    opts = prompt_options_company(labelled_documents(docs), "company_name", "class_name",
                                  "class_number", "doc_id")
    return rule_p(docs).join(opts.withColumnRenamed("company_name", "dataset_name"), "dataset_name")


MISS_SQL = f"""WITH {RULE_P_SQL}, {LD_SQL}, {OPTS_SQL},
chk AS (SELECT rp.doc_id, rp.dataset_name,
               list_contains({option_texts_sql('opts.prompt_options')}, rp.prediction) AS value
        FROM rp JOIN opts ON opts.company_name = rp.dataset_name)"""


@register("is_label_in_options", f"{MISS_SQL}\nSELECT doc_id, value FROM chk")
def q_is_label_in_options(spark, sf):
    df = _rp_with_options(spark, sf)
    return df.select("doc_id", tx.is_label_in_options("prompt_options", "prediction").alias("value"))


@register("taxonomy_miss_rate", f"""{MISS_SQL}
SELECT dataset_name, count(*) AS n, count(*) FILTER (WHERE NOT value) AS n_miss,
       round(count(*) FILTER (WHERE NOT value) / count(*), 6) AS miss_rate
FROM chk GROUP BY dataset_name""")
def q_taxonomy_miss_rate(spark, sf):
    df = _rp_with_options(spark, sf)
    miss = ~tx.is_label_in_options("prompt_options", "prediction")
    return (df.groupBy("dataset_name")
              .agg(F.count(F.lit(1)).alias("n"), F.count_if(miss).alias("n_miss"))
              .withColumn("miss_rate", F.round(F.col("n_miss") / F.col("n"), 6)))


# expansion used by relabel_expanded: extra accepted names for one label
EN_EXPANSION = ("es", "unknown", "english")


@register("relabel_expanded", f"""WITH {RULE_P_SQL},
x AS (SELECT doc_id, lower(replace(raw_prediction, 'Class name: ', '')) AS prediction,
             lower(y) AS y0, y FROM rp)
SELECT doc_id,
       CASE WHEN y = 'en' AND list_contains({list(EN_EXPANSION)}, prediction) THEN prediction ELSE y0 END AS y,
       prediction FROM x""")
def q_relabel_expanded(spark, sf):
    from labelflow.operators.matching import relabel_expanded

    df = _rp(spark, sf).select("doc_id", "y", F.lower(tx.strip_class_prefix("raw_prediction"))
                               .alias("prediction"))
    exp = spark.createDataFrame([("en", list(EN_EXPANSION))], "key string, names array<string>")
    return relabel_expanded(df, exp, "y", "prediction").select("doc_id", "y", "prediction")


@register("classification_report_quality", f"""WITH q AS (
  SELECT CAST(l.quality AS VARCHAR) AS y,
         CASE WHEN d.n_chars > 1000 THEN '1' ELSE '0' END AS prediction
  FROM labels l JOIN documents d USING (doc_id)),
{report_sql('q')}
SELECT * FROM report""")
def q_report_quality(spark, sf):
    lab = read_table(spark, sf, "labels", "doc_id", "quality")
    docs = read_table(spark, sf, "documents", "doc_id", "n_chars")
    df = lab.join(docs, "doc_id").select(
        F.col("quality").cast("string").alias("y"),
        F.when(F.col("n_chars") > 1000, "1").otherwise("0").alias("prediction"))
    return M.classification_report(df)


@register("clean_prediction", """SELECT p_partkey AS id,
  coalesce(translate(p_brand, '0123456789', ''), '') AS value FROM part""")
def q_clean_prediction(spark, sf):
    part = read_table(spark, sf, "part", "p_partkey", "p_brand")
    return part.select(F.col("p_partkey").alias("id"), tx.clean_prediction("p_brand").alias("value"))


BROKEN_PROPS_SQL = """ev AS (SELECT event_id,
  CASE WHEN props LIKE '%7}' THEN replace(props, ':', ' ') ELSE props END AS props FROM events)"""


def _broken_props(spark, sf):
    ev = read_table(spark, sf, "events", "event_id", "props")
    return ev.select("event_id", F.when(F.col("props").endswith("7}"),
                                        F.replace("props", F.lit(":"), F.lit(" ")))
                     .otherwise(F.col("props")).alias("props"))


@register("parse_json_prediction", f"""WITH {BROKEN_PROPS_SQL}
SELECT event_id AS id, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS value
FROM ev""")
def q_parse_json_prediction(spark, sf):
    ev = _broken_props(spark, sf)
    return ev.select(F.col("event_id").alias("id"), tx.parse_json_field("props", "k").alias("value"))


@register("parse_failure_count", f"""WITH {BROKEN_PROPS_SQL},
p AS (SELECT CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS v FROM ev)
SELECT count(*) FILTER (WHERE v IS NOT NULL) AS n_ok, count(*) FILTER (WHERE v IS NULL) AS n_failed FROM p""")
def q_parse_failure_count(spark, sf):
    ev = _broken_props(spark, sf).withColumn("parsed", tx.parse_json_field("props", "k"))
    return M.parse_failure_count(ev, "parsed")
