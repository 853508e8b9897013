"""Registered queries: embeddings, retrieval prompts, few-shot and taxonomy
evaluation, supervised baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.functions.hashing import det_hash_sql
from labelflow.operators.embed import embed_counts, embed_text
from labelflow.operators.matching import option_to_category
from labelflow.operators.options import prompt_options_topn
from labelflow.operators.scoring import LongestTokensExtractor, score_prompts
from labelflow.plans import fewshot as FS
from labelflow.plans.catalog_matching import CLOSEST_CTES
from labelflow.plans.catalog_similarity import EX_SQL
from labelflow.plans.evaluate import PromptDigestScorer, taxonomy_evaluate
from labelflow.plans.inputs import RULE_P_SQL, rule_p_raw
from labelflow.plans.registry import register
from labelflow.plans.sqlgen import report_sql
from labelflow.sources.taxonomy import expansion_dim, taxonomy_dim
from labelflow.sources.tables import read_table


def _emb(spark, sf):
    return read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")


@register("embed_text", f"""SELECT doc_id,
  ({det_hash_sql("''", seed='x').split('(')[0]}('0x' || substr(md5(substring(t, i, 3)), 1, 8))::UBIGINT % 64)::BIGINT AS bucket,
  count(*) AS n
FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i
      FROM (SELECT doc_id, lower(text) AS t FROM documents) x) y
GROUP BY doc_id, bucket""")
def q_embed_text(spark, sf):
    d = read_table(spark, sf, "documents", "doc_id", "text")
    return embed_counts(d, "doc_id", "text", 64)


@register("embed_text_dense", f"""WITH c AS (SELECT doc_id,
  ('0x' || substr(md5(substring(t, i, 3)), 1, 8))::UBIGINT % 64 AS bucket, count(*) AS n
FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i
      FROM (SELECT doc_id, lower(text) AS t FROM documents) x) y
GROUP BY ALL)
SELECT d.doc_id, b.range AS bucket, coalesce(c.n, 0)::DOUBLE AS value
FROM documents d CROSS JOIN range(64) b
LEFT JOIN c ON c.doc_id = d.doc_id AND c.bucket = b.range""")
def q_embed_text_dense(spark, sf):
    d = embed_text(read_table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", 64)
    return d.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).select(
        "doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.col("value").cast("double").alias("value"))


RANKED_SQL = f"""WITH {EX_SQL},
top AS (SELECT vec_id, rnk, exemplar_id, CAST(category AS VARCHAR) AS category FROM rk WHERE rnk <= 5)"""


def _ranked(spark, sf):
    ranked, _ = FS.retrieve(_emb(spark, sf), "vec_id", "embedding", "label", None, 5, 5)
    return ranked


@register("prompt_options_topn", f"""{RANKED_SQL}
SELECT vec_id AS group_key,
       'Options:' || chr(10) || string_agg('# ' || category || ' ' || chr(10), '' ORDER BY rnk)
         AS prompt_options
FROM top GROUP BY vec_id""")
def q_prompt_options_topn(spark, sf):
    o = prompt_options_topn(_ranked(spark, sf), "vec_id", "rnk", "option_text")
    return o.select(F.col("vec_id").alias("group_key"), "prompt_options")


@register("retrieve_then_prompt", f"""{RANKED_SQL},
o AS (SELECT vec_id, 'Options:' || chr(10) || string_agg('# ' || category || ' ' || chr(10), '' ORDER BY rnk)
        AS opts FROM top GROUP BY vec_id),
p AS (SELECT vec_id, 'Topic %% Customer: vector ' || CAST(vec_id AS VARCHAR) || '.' || chr(10)
        || 'END MESSAGE' || chr(10) || 'Choose one topic that matches customer''s issue.' || chr(10)
        || opts || chr(10) || 'Class name: ' AS prompt FROM o)
SELECT vec_id, md5(prompt) AS prompt_md5, length(prompt)::BIGINT AS prompt_len FROM p""")
def q_retrieve_then_prompt(spark, sf):
    qt = F.concat(F.lit("vector "), F.col("vec_id").cast("string"))
    r = FS.retrieve_then_prompt(_emb(spark, sf), "vec_id", "embedding", "label", qt)
    return r.select("vec_id", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").cast("bigint").alias("prompt_len"))


@register("option_to_category", f"""{RANKED_SQL},
ch AS (SELECT vec_id, 'exemplar ' || CAST(min(exemplar_id) AS VARCHAR) AS option_text FROM top GROUP BY vec_id)
SELECT ch.vec_id, ch.option_text, top.category FROM ch JOIN top
  ON top.vec_id = ch.vec_id AND lower('exemplar ' || CAST(top.exemplar_id AS VARCHAR)) = lower(ch.option_text)""")
def q_option_to_category(spark, sf):
    ranked = _ranked(spark, sf).withColumn(
        "option_text", F.concat(F.lit("exemplar "), F.col("exemplar_id").cast("string")))
    chosen = ranked.groupBy("vec_id").agg(F.min("exemplar_id").alias("_e")).select(
        "vec_id", F.concat(F.lit("exemplar "), F.col("_e").cast("string")).alias("option_text"))
    out = option_to_category(chosen, ranked, "vec_id", "option_text", "option_text", "category")
    return out.select("vec_id", "option_text", "category")


@register("fewshot_evaluate", f"""{RANKED_SQL},
v AS (SELECT vec_id, category, count(*) AS votes, min(rnk) AS best FROM top GROUP BY vec_id, category),
w AS (SELECT vec_id, category FROM (SELECT *, row_number() OVER (PARTITION BY vec_id
        ORDER BY votes DESC, best) AS r FROM v) t WHERE r = 1),
ev AS (SELECT lower(CAST(e.label AS VARCHAR)) AS y, lower(w.category) AS resolved_label
       FROM w JOIN embeddings e USING (vec_id)),
{report_sql('ev', pred='resolved_label')}
SELECT * FROM report""")
def q_fewshot_evaluate(spark, sf):
    _, report = FS.fewshot_evaluate(_emb(spark, sf))
    return report


# Dimension for taxonomy_evaluate over documents.lang ('fr' is unmapped).
LANG_TAXONOMY = {"de": "German", "en": "English", "es": "Spanish"}


@register("taxonomy_evaluate", f"""WITH {RULE_P_SQL},
dd AS (SELECT min(doc_id) AS doc_id FROM documents WHERE lang IN ('de', 'en', 'es') GROUP BY text),
ev AS (SELECT lower(rp.y) AS y, lower(replace(rp.raw_prediction, 'Class name: ', '')) AS prediction
       FROM rp JOIN dd USING (doc_id)),
{report_sql('ev')}
SELECT * FROM report""")
def q_taxonomy_evaluate(spark, sf):
    d = read_table(spark, sf, "documents", "doc_id", "text", "lang")
    tax = taxonomy_dim(spark, LANG_TAXONOMY, "lang")
    out = taxonomy_evaluate(d, "doc_id", "text", "lang", tax,
                            predict=lambda rows: rows.withColumn("raw_prediction", rule_p_raw()),
                            use_default_labels=True, lower=True)
    return out["report"]



# ---------------------------------------------------------------- prompts that a scorer reads

def prompt_sql(text: str, opts: str) -> str:
    return (f"'Topic %% Customer: ' || {text} || '.' || chr(10) || 'END MESSAGE' || chr(10) || "
            f"'Choose one topic that matches customer''s issue.' || chr(10) || {opts} || chr(10) || 'Class name: '")


def pick_sql(options: str, prompt: str = "prompt") -> str:
    """The option that PromptDigestScorer answers a prompt with."""
    return f"{options}[('0x' || substr(md5({prompt}), 1, 8))::UBIGINT::BIGINT % len({options}) + 1]"


def _answered(cut: bool = False):
    return lambda rows: score_prompts(rows, "prompt", lambda: PromptDigestScorer(cut), "raw_prediction")


# Accepted names of one label of LANG_TAXONOMY.
LANG_EXPANSION = {"en": ["English", "Anglais", "UK English"]}
LANG_OPTIONS = "['German', 'English', 'Spanish']"
LANG_BLOCK = ("'OPTIONS' || chr(10) || ' 1. German ' || chr(10) || ' 2. English ' || chr(10) || ' 3. Spanish ' || chr(10)")
EXPANDED_OPTIONS = "['German', 'English', 'Anglais', 'UK English', 'Spanish', 'other', 'general', 'unknown']"
EXPANDED_BLOCK = ("'OPTIONS' || chr(10) || ' 1. German ' || chr(10) || '# English' || chr(10) || '# Anglais' || chr(10) "
                  "|| '# UK English' || chr(10) || ' 2. Spanish ' || chr(10) || ' # other # general # unknown '")
BLANKS = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
LONGEST_SQL = f"""coalesce((list_sort(list_transform(
    list_filter(string_split_regex('Extraction %% Customer: ' || text, '{BLANKS}'), lambda t: t <> ''),
    lambda t, i: {{'neg': -length(t), 'i': i, 't': t}})))[1].t, '')"""


def taxonomy_sql(block: str, options: str, text: str = "text") -> str:
    """CTE ``ev``: doc_id, original, text (in the prompt), prompt, y, prediction before relabelling."""
    return f"""dd AS (SELECT min(doc_id) AS doc_id FROM documents WHERE lang IN ('de', 'en', 'es') GROUP BY text),
b AS (SELECT doc_id, lang, text AS original, {text} AS text FROM documents JOIN dd USING (doc_id)),
p AS (SELECT *, {prompt_sql('text', block)} AS prompt FROM b),
ev AS (SELECT doc_id, original, text, prompt, lang,
              CASE lang WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' ELSE 'Spanish' END AS y,
              {pick_sql(options)} AS prediction FROM p)"""


def _taxonomy(spark, sf, expansion=None, extract=None):
    d = read_table(spark, sf, "documents", "doc_id", "text", "lang")
    tax = taxonomy_dim(spark, LANG_TAXONOMY, "lang")
    exp = None if expansion is None else expansion_dim(spark, expansion)
    return taxonomy_evaluate(d, "doc_id", "text", "lang", tax, predict=_answered(), expansion=exp, extract=extract)


@register("taxonomy_evaluate_predictions", f"""WITH {taxonomy_sql(LANG_BLOCK, LANG_OPTIONS)}
SELECT doc_id, y, prediction, md5(prompt) AS prompt_md5 FROM ev""")
def q_taxonomy_predictions(spark, sf):
    return _taxonomy(spark, sf)["predictions"].select("doc_id", "y", "prediction", F.md5("prompt").alias("prompt_md5"))


@register("taxonomy_evaluate_errors", f"""WITH {taxonomy_sql(LANG_BLOCK, LANG_OPTIONS)}
SELECT doc_id, y, prediction FROM ev WHERE y IS DISTINCT FROM prediction""")
def q_taxonomy_errors(spark, sf):
    return _taxonomy(spark, sf)["errors"].select("doc_id", "y", "prediction")


@register("taxonomy_evaluate_counts", f"""WITH {taxonomy_sql(LANG_BLOCK, LANG_OPTIONS)}
SELECT prediction, count(*) AS n FROM ev GROUP BY prediction""")
def q_taxonomy_counts(spark, sf):
    return _taxonomy(spark, sf)["counts"]


RELABELLED_SQL = """ex AS (SELECT doc_id, lower(prediction) AS prediction, md5(prompt) AS prompt_md5,
  CASE WHEN lang = 'en' AND lower(prediction) IN ('english', 'anglais', 'uk english') THEN lower(prediction)
       ELSE lower(y) END AS y FROM ev)"""


@register("taxonomy_evaluate_expanded", f"""WITH {taxonomy_sql(EXPANDED_BLOCK, EXPANDED_OPTIONS)}, {RELABELLED_SQL},
{report_sql('ex')}
SELECT * FROM report""")
def q_taxonomy_expanded(spark, sf):
    return _taxonomy(spark, sf, LANG_EXPANSION)["report"]


@register("taxonomy_evaluate_expanded_predictions",
          f"""WITH {taxonomy_sql(EXPANDED_BLOCK, EXPANDED_OPTIONS)}, {RELABELLED_SQL}
SELECT doc_id, y, prediction, prompt_md5 FROM ex""")
def q_taxonomy_expanded_predictions(spark, sf):
    return _taxonomy(spark, sf, LANG_EXPANSION)["predictions"].select(
        "doc_id", "y", "prediction", F.md5("prompt").alias("prompt_md5"))


def _longest(rows):
    return score_prompts(rows, "prompt", lambda: LongestTokensExtractor(1), "extracted")


@register("taxonomy_evaluate_extracted", f"""WITH {taxonomy_sql(LANG_BLOCK, LANG_OPTIONS, LONGEST_SQL)}
SELECT doc_id, y, prediction, md5(original) AS original_md5, text, md5(prompt) AS prompt_md5 FROM ev""")
def q_taxonomy_extracted(spark, sf):
    out = _taxonomy(spark, sf, extract=_longest)["predictions"]
    return out.select("doc_id", "y", "prediction", F.md5("original").alias("original_md5"), "text",
                      F.md5("prompt").alias("prompt_md5"))


# ---------------------------------------------------------------- few-shot modes over texts

def trigram_vectors_sql(src: str, key: str, text: str, name: str) -> str:
    """CTE ``name``(key, v): hashed trigram counts of each row's text as a list of 64 doubles."""
    return f"""{name}_c AS (SELECT k, ('0x' || substr(md5(substring(t, i, 3)), 1, 8))::UBIGINT % 64 AS bucket, count(*) AS n
  FROM (SELECT k, t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT {key} AS k, lower({text}) AS t FROM {src}) x) y
  GROUP BY ALL),
{name} AS (SELECT s.k, list(coalesce(c.n, 0)::DOUBLE ORDER BY b.range) AS v
  FROM (SELECT {key} AS k FROM {src}) s CROSS JOIN range(64) b
  LEFT JOIN {name}_c c ON c.k = s.k AND c.bucket = b.range GROUP BY s.k)"""


def ranked_sql(queries: str, exemplars: str, top_n: int) -> str:
    """CTE ``top``: (doc_id, rnk, exemplar_id, option_text, category) of ``queries``(k, v) over
    ``exemplars``(k, v, option_text, category)."""
    return f"""s AS (SELECT q.k AS doc_id, e.k AS exemplar_id, e.option_text, e.category,
  CASE WHEN list_dot_product(q.v, q.v) = 0 OR list_dot_product(e.v, e.v) = 0 THEN 0.0
       ELSE list_cosine_similarity(q.v, e.v) END AS sim FROM {queries} q CROSS JOIN {exemplars} e),
top AS (SELECT doc_id, rnk, exemplar_id, option_text, category FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, exemplar_id) AS rnk FROM s) t
  WHERE rnk <= {top_n})"""


def _source_docs(spark, sf):
    return read_table(spark, sf, "documents", "doc_id", "text", "source")


REPORTS_SQL = f"""kinds AS (SELECT y, unnest(['prediction', 'v_pred', 'few_shot']) AS prediction_kind,
  unnest([prediction, v_pred, few_shot]) AS label FROM scored),
{report_sql('kinds', pred='label', by=('prediction_kind',))}"""
# n_shot = 0: classes are retrieved by the vectors of their names, the nearest one answers
ZERO_SHOT_SQL = f"""WITH names AS (SELECT source AS category, row_number() OVER (ORDER BY source) - 1 AS k
  FROM (SELECT DISTINCT source FROM documents)),
{trigram_vectors_sql('documents', 'doc_id', 'text', 'dv')},
{trigram_vectors_sql('names', 'k', 'category', 'nv')},
ne AS (SELECT nv.k, nv.v, category AS option_text, category FROM nv JOIN names USING (k)),
{ranked_sql('dv', 'ne', 5)},
scored AS (SELECT d.doc_id, lower(d.source) AS y, 'class name: ' || lower(t.category) AS prediction,
                  lower(t.category) AS v_pred, t.category AS few_shot
           FROM top t JOIN documents d USING (doc_id) WHERE t.rnk = 1)"""


def _zero_shot(spark, sf):
    docs = FS.with_vectors(_source_docs(spark, sf), "doc_id", "text")
    return FS.fewshot_evaluate(docs, "doc_id", "embedding", "source", n_shot=0, top_n=5)[0]


@register("fewshot_zero_shot", f"""{ZERO_SHOT_SQL}
SELECT doc_id, y, prediction, v_pred, few_shot FROM scored""")
def q_fewshot_zero_shot(spark, sf):
    return _zero_shot(spark, sf).select("doc_id", "y", "prediction", "v_pred", "few_shot")


@register("fewshot_zero_shot_reports", f"""{ZERO_SHOT_SQL},
{REPORTS_SQL}
SELECT * FROM report""")
def q_fewshot_zero_shot_reports(spark, sf):
    return FS.fewshot_reports(_zero_shot(spark, sf))


# without retrieval: every class is an option of every prompt, answers are snapped onto them
CATEGORIES_SQL = f"""WITH RECURSIVE names AS (SELECT list(source ORDER BY source) AS opts,
    'Options:' || chr(10) || string_agg('# ' || source || ' ' || chr(10), '' ORDER BY source) AS block
  FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
p AS (SELECT doc_id, source, opts, {prompt_sql('text', 'block')} AS prompt FROM documents, names),
a AS (SELECT doc_id, source, prompt, {pick_sql('opts')} AS name,
             ('0x' || substr(md5(prompt), 1, 8))::UBIGINT % 2 = 1 AS cut FROM p),
raw AS (SELECT doc_id, lower(source) AS y, prompt, lower(CASE WHEN cut THEN substr(name, 2) ELSE name END) AS answer FROM a),
lab AS (SELECT DISTINCT lower(source) AS label FROM documents WHERE source IS NOT NULL),
miss AS (SELECT DISTINCT answer AS p FROM raw WHERE answer NOT IN (SELECT label FROM lab)),
{CLOSEST_CTES},
snap AS (SELECT raw.*, coalesce(best.label, answer) AS v_pred FROM raw LEFT JOIN best ON best.p = answer),
scored AS (SELECT doc_id, y, prompt, 'class name: ' || answer AS prediction, v_pred,
                  (SELECT min(source) FROM documents d WHERE lower(d.source) = v_pred) AS few_shot FROM snap)"""


def _categories(spark, sf):
    return FS.categories_evaluate(_source_docs(spark, sf), "doc_id", "source", "text", _answered(cut=True))[0]


@register("fewshot_categories", f"""{CATEGORIES_SQL}
SELECT doc_id, y, md5(prompt) AS prompt_md5, prediction, v_pred, few_shot FROM scored""")
def q_fewshot_categories(spark, sf):
    return _categories(spark, sf).select("doc_id", "y", F.md5("prompt").alias("prompt_md5"), "prediction", "v_pred",
                                         "few_shot")


@register("fewshot_categories_reports", f"""{CATEGORIES_SQL},
{REPORTS_SQL}
SELECT * FROM report""")
def q_fewshot_categories_reports(spark, sf):
    return FS.fewshot_reports(_categories(spark, sf))


# retrieval of texts: two exemplars a language in hash order, found by the texts' vectors
TEXT_RANKED_SQL = f"""WITH hx AS (SELECT doc_id, lang, text, {det_hash_sql('doc_id')} AS h FROM documents),
pick AS (SELECT doc_id AS k, lang AS category, text AS option_text FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS r FROM hx) t WHERE r <= 2),
{trigram_vectors_sql('documents', 'doc_id', 'text', 'dv')},
qv AS (SELECT k, v FROM dv WHERE k NOT IN (SELECT k FROM pick)),
ev AS (SELECT k, v, option_text, category FROM dv JOIN pick USING (k)),
{ranked_sql('qv', 'ev', 3)}"""


def _lang_vectors(spark, sf):
    d = read_table(spark, sf, "documents", "doc_id", "text", "lang")
    return FS.with_vectors(d, "doc_id", "text")


@register("retrieve_then_prompt_texts", f"""{TEXT_RANKED_SQL},
o AS (SELECT doc_id, 'Options:' || chr(10) || string_agg('# ' || option_text || ' ' || chr(10), '' ORDER BY rnk) AS opts
      FROM top GROUP BY doc_id),
p AS (SELECT doc_id, {prompt_sql('d.text', 'o.opts')} AS prompt FROM o JOIN documents d USING (doc_id))
SELECT doc_id, md5(prompt) AS prompt_md5, length(prompt)::BIGINT AS prompt_len FROM p""")
def q_retrieve_then_prompt_texts(spark, sf):
    r = FS.retrieve_then_prompt(_lang_vectors(spark, sf), "doc_id", "embedding", "lang", F.col("text"),
                                text_col="text", n_shot=2, top_n=3)
    return r.select("doc_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("prompt_len"))


@register("fewshot_text_reports", f"""{TEXT_RANKED_SQL},
v AS (SELECT doc_id, option_text, count(*) AS votes, min(rnk) AS best FROM top GROUP BY ALL),
w AS (SELECT doc_id, option_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, best) AS r
      FROM v) t WHERE r = 1),
scored AS (SELECT lower(d.lang) AS y, md5('class name: ' || lower(w.option_text)) AS prediction,
                  (SELECT lower(arg_min(category, rnk)) FROM top t WHERE t.doc_id = w.doc_id
                     AND lower(t.option_text) = lower(w.option_text)) AS few_shot
           FROM w JOIN documents d USING (doc_id)),
kinds AS (SELECT y, 'prediction' AS prediction_kind, prediction AS label FROM scored
          UNION ALL SELECT y, 'few_shot', few_shot FROM scored),
{report_sql('kinds', pred='label', by=('prediction_kind',))}
SELECT * FROM report""")
def q_fewshot_text_reports(spark, sf):
    scored, _ = FS.fewshot_evaluate(_lang_vectors(spark, sf), "doc_id", "embedding", "lang", text_col="text",
                                    n_shot=2, top_n=3)
    short = scored.withColumn("prediction", F.md5("prediction"))
    return FS.fewshot_reports(short).where("prediction_kind <> 'v_pred'")


@register("train_text_classifier")
def q_train_text_classifier(spark, sf):
    from labelflow.plans.train import train_text_classifier

    d = read_table(spark, sf, "documents", "doc_id", "text", "lang")
    return train_text_classifier(d, "doc_id", "text", "lang")["metrics"]


# the rows the classifier is tested on, each with an answer out of the labels it saw
@register("train_text_classifier_rows", f"""WITH s AS (SELECT doc_id, lang,
  row_number() OVER (ORDER BY {det_hash_sql('doc_id')}, doc_id) <= ceil(0.2 * count(*) OVER ()) AS test FROM documents)
SELECT doc_id, lang AS y, TRUE AS known FROM s WHERE test""")
def q_train_text_classifier_rows(spark, sf):
    from labelflow.plans.train import train_text_classifier

    d = read_table(spark, sf, "documents", "doc_id", "text", "lang")
    p = train_text_classifier(d, "doc_id", "text", "lang")["predictions"]
    labels = d.select(F.col("lang").alias("prediction")).distinct()
    known = p.join(labels.withColumn("_known", F.lit(True)), "prediction", "left")
    return known.select("doc_id", "y", F.coalesce("_known", F.lit(False)).alias("known"))
