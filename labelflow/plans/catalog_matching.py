"""Registered queries: closest label, lexical scoring, scoring hook."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.operators import matching as MT
from labelflow.operators import scoring as SC
from labelflow.plans.registry import register
from labelflow.sources.tables import read_table

MUTATE_SQL = """mp AS (SELECT p_partkey, p_name,
    substring(p_name, 1, (p_partkey % length(p_name))) || substring(p_name, (p_partkey % length(p_name)) + 2)
      AS prediction FROM part)"""


def mutated_parts(spark, sf):
    """part names with one character deleted: position 1 + p_partkey mod length."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name")
    k = F.pmod(F.col("p_partkey"), F.length("p_name")) + 1
    mutated = F.concat(F.substr(F.col("p_name"), F.lit(1), k - 1), F.substr(F.col("p_name"), k + 1))
    return p.withColumn("prediction", mutated)


def _part_labels(spark, sf):
    return read_table(spark, sf, "part", "p_name").select(F.col("p_name").alias("label")).distinct()


# The stdlib ratio in SQL: the longest common substring (first in the label, then in
# the word) splits a pair into what lies left and right of it, again and again.
# Words of 200 and more characters, where the stdlib ignores popular ones, are not
# covered; part names are shorter.
_SUBS = ("list_distinct(flatten(list_transform(range(1, length({x}) + 1), lambda i: "
         "list_transform(range(1, length({x}) - i + 2), lambda k: substr({x}, i, k)))))")
_BLOCK = ("list_max(list_transform(list_intersect(" + _SUBS.format(x="a") + ", " + _SUBS.format(x="b") + "), "
          "lambda s: {'k': length(s), 'i': -instr(a, s), 's': s})).s")
CLOSEST_CTES = f"""node AS (
  SELECT p, label, a, b, {_BLOCK} AS s FROM (SELECT p, label, label AS a, p AS b FROM miss, lab)
  UNION ALL
  SELECT p, label, a, b, {_BLOCK} AS s
  FROM (SELECT p, label, unnest([left(a, instr(a, s) - 1), substr(a, instr(a, s) + length(s))]) AS a,
               unnest([left(b, instr(b, s) - 1), substr(b, instr(b, s) + length(s))]) AS b
        FROM node WHERE s IS NOT NULL)
  WHERE a <> '' AND b <> ''),
r AS (SELECT p, label, 2.0 * coalesce(sum(length(s)), 0) / (length(p) + length(label)) AS ratio
      FROM node GROUP BY p, label),
best AS (SELECT p, label FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY ratio DESC, label DESC) AS n FROM r)
         WHERE n = 1)"""
# relations miss (p) and lab (label) give best (p, label)
CLOSEST_SQL = f"""WITH RECURSIVE {MUTATE_SQL},
lab AS (SELECT DISTINCT lower(p_name) AS label FROM part),
miss AS (SELECT DISTINCT lower(prediction) AS p FROM mp WHERE lower(prediction) NOT IN (SELECT label FROM lab)),
{CLOSEST_CTES}
SELECT mp.p_partkey, mp.prediction, coalesce(best.label, lower(mp.prediction)) AS label
FROM mp LEFT JOIN best ON best.p = lower(mp.prediction)"""


@register("closest_label", CLOSEST_SQL)
def q_closest_label(spark, sf):
    m = mutated_parts(spark, sf)
    out = MT.closest_label(m, "prediction", _part_labels(spark, sf), "label", out_col="label")
    return out.select("p_partkey", "prediction", "label")


@register("closest_label_levenshtein", f"""WITH {MUTATE_SQL},
lab AS (SELECT DISTINCT lower(p_name) AS label FROM part),
d AS (SELECT DISTINCT lower(prediction) AS p FROM mp),
s AS (SELECT p, label, levenshtein(p, label) AS dist,
             row_number() OVER (PARTITION BY p ORDER BY levenshtein(p, label), label) AS r
      FROM d, lab)
SELECT mp.p_partkey, mp.prediction, s.label, s.dist::BIGINT AS dist
FROM mp JOIN s ON s.p = lower(mp.prediction) AND s.r = 1""")
def q_closest_label_levenshtein(spark, sf):
    m = mutated_parts(spark, sf)
    out = MT.closest_label_levenshtein(m, "prediction", _part_labels(spark, sf), "label",
                                       out_col="label")
    return out.select("p_partkey", "prediction", "label", "dist")


WORD_LABELS_SQL = """lab AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS label FROM part
             UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part)"""


def word_labels(spark, sf):
    """Label set derived from part names: their first and second words."""
    p = read_table(spark, sf, "part", "p_name")
    a = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("label"))
    b = p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("label"))
    return a.union(b).distinct()


def _tokset_sql(x):
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: t <> ''))"


def lexical_sql(text_expr: str, src: str) -> str:
    return f"""{WORD_LABELS_SQL},
x AS (SELECT DISTINCT {text_expr} AS x FROM {src}),
sc AS (SELECT x, label,
         CASE WHEN len(list_distinct(list_concat({_tokset_sql('x')}, {_tokset_sql('label')}))) = 0 THEN 0.0
              ELSE len(list_intersect({_tokset_sql('x')}, {_tokset_sql('label')}))::DOUBLE
                   / len(list_distinct(list_concat({_tokset_sql('x')}, {_tokset_sql('label')}))) END AS jac
       FROM x, lab),
best AS (SELECT x, label FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY jac DESC, label) AS r
                               FROM sc) t WHERE r = 1)"""


@register("lexical_zero_shot", f"""WITH {lexical_sql('p_name', 'part')}
SELECT p.p_partkey, b.label AS prediction FROM part p JOIN best b ON b.x = p.p_name""")
def q_lexical_zero_shot(spark, sf):
    p = read_table(spark, sf, "part", "p_partkey", "p_name")
    out = SC.lexical_zero_shot(p, "p_name", word_labels(spark, sf), "label")
    return out.select("p_partkey", "prediction")


@register("score_prompts", f"""WITH {lexical_sql('p_name', 'part')}
SELECT p.p_partkey, b.label AS prediction FROM part p JOIN best b ON b.x = p.p_name""")
def q_score_prompts(spark, sf):
    p = read_table(spark, sf, "part", "p_partkey", "p_name")
    out = SC.lexical_predict(p, "p_name", word_labels(spark, sf), "label")
    return out.select("p_partkey", "prediction")


TWO_STAGE_SQL = f"""WITH ext AS (SELECT p_partkey, p_name,
    array_to_string(list_transform(list_slice(list_sort(list_transform(
        list_filter(string_split_regex(p_name, '\\s+'), lambda t: t <> ''),
        lambda t, i: {{'neg': -length(t), 'i': i, 't': t}})), 1, 1), lambda s: s.t), ' ') AS extracted
  FROM part),
{lexical_sql('extracted', 'ext')[len(''):]}
SELECT e.p_partkey, e.p_name AS original, e.extracted, b.label AS prediction
FROM ext e JOIN best b ON b.x = e.extracted"""


@register("two_stage_predict", TWO_STAGE_SQL.replace("WITH ext AS", "WITH ext AS", 1))
def q_two_stage_predict(spark, sf):
    p = read_table(spark, sf, "part", "p_partkey", "p_name")
    out = SC.two_stage_predict(p, "p_name", lambda: SC.LongestTokensExtractor(1),
                               labels=word_labels(spark, sf))
    return out.select("p_partkey", "original", "extracted", "prediction")
