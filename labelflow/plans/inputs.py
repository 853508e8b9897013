"""Derived inputs shared by the registered queries.

The driver tables carry no model output, so the evaluation queries score a
deterministic *prediction rule* ("rule P") over ``documents``:

* bucket = hash(doc_id) % 10
* bucket < 7  -> ``'Class name: ' || upper(lang)``  (right, with the prefix)
* bucket < 9  -> the next language in de, en, es, fr order (wrong)
* otherwise   -> ``'unknown'``
* y = lang, dataset = source, model = ``'m' || hash % 3``

Each builder has a SQL twin used by the oracle texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.functions.hashing import det_hash, det_hash_sql
from labelflow.functions.text import extract_class_name

# The language cycle of rule P.
LANG_CYCLE = ("de", "en", "es", "fr")


def rule_p_raw(id_col: str = "doc_id", lang_col: str = "lang"):
    """The raw model answer of rule P as a column expression."""
    b = F.pmod(det_hash(id_col), F.lit(10))
    lang = F.col(lang_col)
    nxt = (F.when(lang == "de", "en").when(lang == "en", "es").when(lang == "es", "fr")
             .otherwise("de"))
    return (F.when(b < 7, F.concat(F.lit("Class name: "), F.upper(lang)))
             .when(b < 9, nxt).otherwise(F.lit("unknown")))


def rule_p(documents: DataFrame) -> DataFrame:
    """(doc_id, y, raw_prediction, prediction, dataset_name, model_name, n_chars)."""
    h = det_hash("doc_id")
    lang = F.col("lang")
    raw = rule_p_raw()
    out = documents.select(
        "doc_id", lang.alias("y"), raw.alias("raw_prediction"),
        F.col("source").alias("dataset_name"),
        F.concat(F.lit("m"), F.pmod(h, F.lit(3)).cast("string")).alias("model_name"),
        "n_chars")
    return out.withColumn("prediction", extract_class_name("raw_prediction"))


EXTRACT_SQL = ("coalesce(regexp_replace(CASE WHEN instr(lower({x}), ':') > 0 "
               "THEN split_part(lower({x}), ':', 2) ELSE lower({x}) END, "
               "'^\\s+|\\s+$', '', 'g'), '')")


def extract_sql(x: str) -> str:
    return EXTRACT_SQL.format(x=x)


RULE_P_SQL = f"""rule_p AS (
  SELECT doc_id, lang AS y, source AS dataset_name, n_chars,
         CASE WHEN h % 10 < 7 THEN 'Class name: ' || upper(lang)
              WHEN h % 10 < 9 THEN CASE lang WHEN 'de' THEN 'en' WHEN 'en' THEN 'es'
                                             WHEN 'es' THEN 'fr' ELSE 'de' END
              ELSE 'unknown' END AS raw_prediction,
         'm' || CAST(h % 3 AS VARCHAR) AS model_name
  FROM (SELECT *, {det_hash_sql('doc_id')} AS h FROM documents) d),
rp AS (SELECT *, {extract_sql('raw_prediction')} AS prediction FROM rule_p)"""


def labelled_documents(documents: DataFrame) -> DataFrame:
    """``documents`` as a flat labelled table: company = source, class = lang,
    sample text = the whole text, class number = 1-based sorted lang
    index, table order = doc_id."""
    from labelflow.operators.joins import bounded_broadcast
    from labelflow.operators.sampling import label_index

    idx = label_index(documents, "lang", name="class_number").select(
        F.col("label").alias("class_name"), F.col("class_number").cast("int"))
    flat = documents.select("doc_id", F.col("source").alias("company_name"),
                            F.col("text").alias("sample_text"),
                            F.col("lang").alias("class_name"))
    return flat.join(bounded_broadcast(idx), "class_name").select("doc_id", "company_name", "sample_text",
                                               "class_name", "class_number")


LD_SQL = """ld AS (SELECT doc_id, source AS company_name, text AS sample_text,
                 lang AS class_name, CAST(dense_rank() OVER (ORDER BY lang) AS INTEGER) AS class_number
          FROM documents)"""

# per-company numbered option block over ``ld``
OPTS_SQL = """fc AS (SELECT company_name, class_name, min(doc_id) AS p,
                  arg_min(class_number, doc_id) AS num FROM ld GROUP BY company_name, class_name),
opts AS (SELECT company_name,
                chr(10) || '        OPTIONS:' || chr(10) || '        '
                || string_agg(CAST(num AS VARCHAR) || '.' || class_name || ' ' || chr(10), '' ORDER BY p)
                || chr(10) || '    ' AS prompt_options
         FROM fc GROUP BY company_name)"""

STRIP_SQL = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip_sql(x: str) -> str:
    return STRIP_SQL.format(x=x)


def option_texts_sql(options: str) -> str:
    body = strip_sql(f"replace({options}, 'OPTIONS:', '')")
    return (f"list_transform(list_filter(string_split({body}, chr(10)), lambda l: instr(l, '.') > 0), "
            f"lambda l: {strip_sql('lower(substring(l, instr(l, chr(46)) + 1))')})")


def conversation_examples(conversations: DataFrame) -> DataFrame:
    """Conversation turns as flat examples: company = ``conv_<id>``, pos =
    turn, sample text = the whole text, class = role, class number =
    turn, row id = 60 bits of a digest of (conv_id, turn, role).  User turns that contain a comma
    carry an entity annotation (their first word, lower-cased); all other
    rows have none."""
    txt = F.col("text")
    ent = F.when((F.col("role") == "user") & (F.instr(txt, ",") > 0),
                 F.lower(F.split_part(txt, F.lit(" "), F.lit(1))))
    return conversations.select(
        F.conv(F.substring(F.md5(F.concat_ws("-", "conv_id", "turn", "role")), 1, 15), 16, 10).cast("bigint").alias("id"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("company_name"),
        F.col("turn").alias("pos"),
        txt.alias("sample_text"),
        F.col("role").alias("class_name"),
        F.col("turn").cast("int").alias("class_number"),
        ent.alias("entity_action"))


CONV_SQL = """cx AS (SELECT ('0x' || substr(md5(concat_ws('-', conv_id, turn, role)), 1, 15))::UBIGINT::BIGINT AS id, 'conv_' || CAST(conv_id AS VARCHAR) AS company_name,
                 turn AS pos, text AS sample_text, role AS class_name,
                 CAST(turn AS INTEGER) AS class_number,
                 CASE WHEN role = 'user' AND instr(text, ',') > 0 THEN lower(split_part(text, ' ', 1)) END
                   AS entity_action
          FROM conversations)"""
