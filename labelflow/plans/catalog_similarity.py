"""Registered queries: similarity, exemplar retrieval, flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.functions.hashing import det_hash_sql
from labelflow.operators.similarity import cosine, similarity_topn
from labelflow.plans.fewshot import flagship_report, nearest_exemplar_classify, split_exemplars
from labelflow.plans.registry import register
from labelflow.plans.sqlgen import report_sql
from labelflow.sources.tables import read_table

H = det_hash_sql("vec_id")

# exemplars: 5 per label in hash order; queries: all other rows
EX_SQL = f"""hx AS (SELECT vec_id, label, embedding, {H} AS h FROM embeddings),
ex AS (SELECT vec_id AS exemplar_id, label AS category, embedding FROM
        (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) AS r FROM hx) t
       WHERE r <= 5),
q AS (SELECT vec_id, label, embedding FROM embeddings
      WHERE vec_id NOT IN (SELECT exemplar_id FROM ex)),
s AS (SELECT q.vec_id, q.label AS y, ex.exemplar_id, ex.category,
             CASE WHEN list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) = 0
                    OR list_dot_product(ex.embedding::DOUBLE[], ex.embedding::DOUBLE[]) = 0 THEN 0.0
                  ELSE list_cosine_similarity(q.embedding::DOUBLE[], ex.embedding::DOUBLE[]) END AS sim
      FROM q CROSS JOIN ex),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, exemplar_id) AS rnk FROM s)"""


def _emb(spark, sf):
    return read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")


@register("similarity_topn", f"""WITH {EX_SQL}
SELECT vec_id, rnk::BIGINT AS rnk, exemplar_id, round(sim, 6) AS sim FROM rk WHERE rnk <= 5""")
def q_similarity_topn(spark, sf):
    ex, queries = split_exemplars(_emb(spark, sf), "vec_id", "label", 5)
    ex = ex.select(F.col("vec_id").alias("exemplar_id"), "embedding")
    return similarity_topn(queries.select("vec_id", "embedding"), ex, 5)


@register("nearest_exemplar_classify", f"""WITH {EX_SQL}
SELECT vec_id, CAST(y AS VARCHAR) AS y, CAST(category AS VARCHAR) AS prediction,
       round(sim, 6) AS sim FROM rk WHERE rnk = 1""")
def q_nearest_exemplar_classify(spark, sf):
    return nearest_exemplar_classify(_emb(spark, sf))


@register("flagship_report", f"""WITH {EX_SQL},
pred AS (SELECT CAST(y AS VARCHAR) AS y, CAST(category AS VARCHAR) AS prediction FROM rk WHERE rnk = 1),
{report_sql('pred')}
SELECT * FROM report""")
def q_flagship(spark, sf):
    return flagship_report(_emb(spark, sf))


@register("cosine", """SELECT a.vec_id AS a_id, b.vec_id AS b_id,
  round(CASE WHEN list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) = 0
               OR list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]) = 0 THEN 0.0
             ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 6) AS sim
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_cosine(spark, sf):
    a = _emb(spark, sf).select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("ea"))
    b = _emb(spark, sf).select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("eb"))
    j = a.join(b, F.col("b_id") == F.col("a_id") + 1)
    return j.select("a_id", "b_id", F.round(cosine("ea", "eb"), 6).alias("sim"))
