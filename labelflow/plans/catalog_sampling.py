"""Registered queries: sampling, splits, dedup, ranking, head."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.functions.hashing import det_hash_sql
from labelflow.operators import sampling as S
from labelflow.plans.registry import register
from labelflow.sources.tables import read_table

HD = det_hash_sql("doc_id")
HE = det_hash_sql("event_id")
HV = det_hash_sql("vec_id")


def _docs(spark, sf, *cols):
    return read_table(spark, sf, "documents", *(cols or ("doc_id", "text", "lang", "source")))


@register("exemplars_per_class", f"""WITH d AS (SELECT doc_id, lang, md5(text) AS text,
                                      {HD} AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS rnk FROM d)
SELECT 5::BIGINT AS shots, lang AS category, rnk::BIGINT AS rnk, text FROM r WHERE rnk <= 5
UNION ALL
SELECT DISTINCT 0::BIGINT, lang, 1::BIGINT, lang FROM documents""")
def q_exemplars(spark, sf):
    d = _docs(spark, sf, "doc_id", "lang", "text").withColumn("text", F.md5("text"))
    five = S.exemplars_per_class(d, "lang", "text", 5, "doc_id")
    zero = S.exemplars_per_class(d, "lang", "text", 0, "doc_id")
    out = [x.select(F.lit(k).cast("bigint").alias("shots"), "category", "rnk", "text")
           for k, x in ((5, five), (0, zero))]
    return out[0].unionByName(out[1])


@register("stratified_sample", f"""SELECT label, vec_id FROM (
  SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {HV}, vec_id) AS r
  FROM embeddings) t WHERE r <= 15""")
def q_stratified_sample(spark, sf):
    e = read_table(spark, sf, "embeddings", "vec_id", "label")
    return S.stratified_sample(e, "label", 15, "vec_id", strict=True).select("label", "vec_id")


@register("first_n_per_class", """SELECT lang, doc_id FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) t
WHERE r <= 5""")
def q_first_n(spark, sf):
    return S.first_n_per_class(_docs(spark, sf, "doc_id", "lang"), "lang", 5, "doc_id").select(
        "lang", "doc_id")


@register("dedup_first", """SELECT min(doc_id) AS doc_id, md5(text) AS text_md5
FROM documents GROUP BY text""")
def q_dedup_first(spark, sf):
    d = S.dedup_first(_docs(spark, sf, "doc_id", "text"), "text", "doc_id")
    return d.select("doc_id", F.md5("text").alias("text_md5"))


@register("label_index", """SELECT event_type AS label,
  row_number() OVER (ORDER BY event_type)::BIGINT AS label_id FROM (SELECT DISTINCT event_type FROM events) t""")
def q_label_index(spark, sf):
    return S.label_index(read_table(spark, sf, "events", "event_type"), "event_type")


SPLIT_SQL = """SELECT {id} AS id, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split
FROM (SELECT {id}, row_number() OVER ({part} ORDER BY {h}, {id}) AS rn,
             count(*) OVER ({part}) AS n FROM {t}) s"""


@register("train_test_split", SPLIT_SQL.format(id="doc_id", part="", h=HD, t="documents"))
def q_train_test_split(spark, sf):
    s = S.exact_split(_docs(spark, sf, "doc_id"), "doc_id", 0.2)
    return s.select(F.col("doc_id").alias("id"), "split")


@register("stratified_split", SPLIT_SQL.format(id="vec_id", part="PARTITION BY label", h=HV,
                                               t="embeddings"))
def q_stratified_split(spark, sf):
    e = read_table(spark, sf, "embeddings", "vec_id", "label")
    return S.stratified_split(e, "vec_id", "label").select(F.col("vec_id").alias("id"), "split")


@register("hash_split", f"""SELECT event_id AS id,
  CASE WHEN {HE} % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM events""")
def q_hash_split(spark, sf):
    ev = read_table(spark, sf, "events", "event_id")
    return S.hash_split(ev, "event_id").select(F.col("event_id").alias("id"), "split")


@register("fraction_sample", f"SELECT event_id FROM events WHERE {HE} % 100 < 30")
def q_fraction_sample(spark, sf):
    return S.fraction_sample(read_table(spark, sf, "events", "event_id"), "event_id", 30)


@register("fixed_sample", f"SELECT event_id FROM events ORDER BY {HE}, event_id LIMIT 100")
def q_fixed_sample(spark, sf):
    return S.fixed_sample(read_table(spark, sf, "events", "event_id"), "event_id", 100)


@register("seeded_shuffle", f"""SELECT row_number() OVER (ORDER BY {HD}, doc_id)::BIGINT AS pos, doc_id
FROM documents""")
def q_seeded_shuffle(spark, sf):
    return S.seeded_shuffle(_docs(spark, sf, "doc_id"), "doc_id").select("pos", "doc_id")


@register("head_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def q_head_n(spark, sf):
    return _docs(spark, sf, "doc_id", "lang").orderBy("doc_id").limit(50)


@register("top1_label", """SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT AS top_idx,
  round(CAST(list_max(embedding) AS DOUBLE), 6) AS top_score FROM embeddings""")
def q_top1_label(spark, sf):
    from labelflow.operators.scoring import top1_label

    e = read_table(spark, sf, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", *top1_label("embedding"))
