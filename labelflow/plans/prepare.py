"""Preparing labelled tables for training and evaluation.

``prepare_labelled_table`` turns flat examples into the prompted table;
``preprocess`` splits it, mines same-intent pairs, adds the entity task and
removes train/test leaks.  Option blocks are computed once per company and
joined back last, by a broadcast where they fit.  Prompts are then in no shuffle
of the big table: splits, pairs and leaks are decided on ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.functions.hashing import DEFAULT_SEED, det_hash
from labelflow.functions.prompts import build_prompt, entity_prompt, pair_prompt
from labelflow.operators.joins import bounded_broadcast
from labelflow.operators.options import prompt_options_company
from labelflow.operators.sampling import exact_split

CLASSIFICATION = "classification"
ENTITY_EXTRACTION = "entity_extraction"
# Fixed value: rows drawn per class for pairing, the first size a class can fill.
PAIR_SIZES = (8, 6, 4, 2)


def prepare_labelled_table(flat: DataFrame, company_col: str = "company_name",
                           pos_col: str = "pos", bullet: str | None = None,
                           compat: bool = False) -> DataFrame:
    """Add ``generator_labels, prompt_options, generator_text,
    generator_text_no_company, dataset_name, task`` to flat examples
    (``company_name, sample_text, class_name, class_number`` + ``pos``).

    ``compat=True`` renders the no-company text exactly as the reference
    does (company template with an empty name and ``False`` as description).
    """
    opts = prompt_options_company(flat, company_col, "class_name", "class_number", pos_col,
                                  bullet=bullet)
    t = flat.join(bounded_broadcast(opts), company_col)
    if compat:
        no_company = build_prompt("sample_text", "prompt_options", F.lit(""), F.lit("False"))
    else:
        no_company = build_prompt("sample_text", "prompt_options", no_company_specific=True)
    return (t.withColumn("generator_labels", F.col("class_name"))
             .withColumn("generator_text", build_prompt("sample_text", "prompt_options",
                                                        company_col))
             .withColumn("generator_text_no_company", no_company)
             .withColumn("dataset_name", F.col(company_col))
             .withColumn("task", F.lit(CLASSIFICATION)))


def entity_dataset(flat: DataFrame, text_col: str = "sample_text",
                   entity_col: str = "entity_action") -> DataFrame:
    """Rows that carry an entity/action annotation become extraction rows:
    label = the annotation, both prompt columns = the extraction prompt."""
    e = flat.filter(F.col(entity_col).isNotNull())
    p = entity_prompt(text_col)
    return (e.withColumn("generator_text", p)
             .withColumn("generator_labels", F.col(entity_col))
             .withColumn("task", F.lit(ENTITY_EXTRACTION))
             .withColumn("generator_text_no_company", p))


def leaked_digests(df: DataFrame, other: DataFrame, text_col: str = "sample_text") -> DataFrame:
    """Digests of the texts that occur in both tables, written, and a broadcast side where they fit.

    Distinct 256-bit digests of both sides meet, so a digest that many rows share
    is one row before any shuffle, and no text or prompt is exchanged."""
    def digests(side: DataFrame) -> DataFrame:
        key = F.unhex(F.sha2(F.col(text_col), 256)).alias("_leak")
        return side.select(key).where(F.col("_leak").isNotNull()).distinct()

    return bounded_broadcast(digests(df).join(digests(other), "_leak", "left_semi"))


def leak_anti_join(df: DataFrame, other: DataFrame, text_col: str = "sample_text",
                   leaked: DataFrame | None = None) -> DataFrame:
    """Drop rows whose text occurs in ``other`` (exact, null-free equality); ``leaked`` is
    the verdict of :func:`leaked_digests`, if it is known."""
    leaked = leaked_digests(df, other, text_col) if leaked is None else leaked
    return df.join(leaked, F.unhex(F.sha2(F.col(text_col), 256)) == F.col("_leak"), "left_anti")


def multi_task_union(classification: DataFrame, entity: DataFrame,
                     text_col: str = "sample_text") -> DataFrame:
    """Classification rows without leaked texts, plus all entity rows."""
    clean = leak_anti_join(classification, entity, text_col)
    return clean.unionByName(entity, allowMissingColumns=True)


def same_intent_pairs(df: DataFrame, class_col: str = "class_name",
                      text_col: str = "sample_text", id_col: str = "doc_id",
                      seed=DEFAULT_SEED) -> DataFrame:
    """Positive same-intent pairs per class.

    Texts are deduplicated inside each class, the first ``n`` in hash order
    are drawn (n = the largest of 8, 6, 4, 2 not above the class size) and
    consecutive ranks form pairs (1,2), (3,4), ...  Label is always ``yes``.
    Returns ``class_name, pair_no, first_id, second_id, generator_text,
    generator_text_no_company, generator_labels``.
    """
    # texts compare by their md5 digest: the shuffle moves 32-byte keys, not
    # the texts; only the <= 8 drawn rows per class fetch their text back
    keyed = df.select(class_col, id_col, F.md5(F.col(text_col)).alias("_t"))
    dedup = keyed.groupBy(class_col, "_t").agg(F.min(id_col).alias(id_col))
    top = max(PAIR_SIZES)
    w = Window.partitionBy(class_col).orderBy(det_hash(id_col, seed), id_col)
    ranked = dedup.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top)
    sized = ranked.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(class_col)))
    kept = (sized.filter(F.col("_r") <= F.floor(F.col("_c") / 2) * 2)
                 .select(F.col(class_col).alias("_cls"), F.col(id_col).alias("_id"), "_r"))
    texts = df.select(class_col, id_col, text_col).join(
        bounded_broadcast(kept), (F.col(id_col) == F.col("_id")) & (F.col(class_col) == F.col("_cls")))
    pairs = (texts.withColumn("pair_no", F.floor((F.col("_r") + 1) / 2).cast("bigint"))
                  .groupBy(class_col, "pair_no")
                  .agg(F.min_by(F.struct(id_col, text_col), "_r").alias("a"),
                       F.max_by(F.struct(id_col, text_col), "_r").alias("b")))
    prompt = pair_prompt(F.col(f"a.{text_col}"), F.col(f"b.{text_col}"))
    return pairs.select(F.col(class_col), "pair_no",
                        F.col(f"a.{id_col}").alias("first_id"),
                        F.col(f"b.{id_col}").alias("second_id"),
                        prompt.alias("generator_text"),
                        prompt.alias("generator_text_no_company"),
                        F.lit("yes").alias("generator_labels"))


def preprocess_table(prepared: DataFrame, id_col: str = "doc_id", entity: DataFrame | None = None,
                     no_classification_task: bool = False, test_fraction: float = 0.2,
                     seed=DEFAULT_SEED, split_col: str = "split") -> tuple[DataFrame, DataFrame]:
    """(split table, pairs): every row once with ``split`` = train / test.

    Exact-size hash split of the prepared table; pairs are mined from the
    train rows only (no leak into test).  With ``entity`` rows, those are
    split the same way and unioned after removing classification rows whose
    text occurs among the entity texts; ``no_classification_task`` keeps only
    the entity rows.  One table with a split column renders each prompt once;
    write it partitioned by ``split`` to get the train and test files.
    """
    table = exact_split(prepared, id_col, test_fraction, seed=seed, split_col=split_col)
    pairs = same_intent_pairs(table.filter(F.col(split_col) == "train").drop(split_col),
                              id_col=id_col, seed=seed)
    if entity is not None:
        e_table = exact_split(entity, id_col, test_fraction, seed=seed, split_col=split_col)
        if no_classification_task:
            table = e_table
        else:
            # the verdict needs neither split nor prompts
            leaked = leaked_digests(prepared, entity)
            table = leak_anti_join(table, entity, leaked=leaked).unionByName(e_table, allowMissingColumns=True)
    return table, pairs


def preprocess(prepared: DataFrame, id_col: str = "doc_id", entity: DataFrame | None = None,
               no_classification_task: bool = False, test_fraction: float = 0.2,
               seed=DEFAULT_SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, pairs) -- :func:`preprocess_table` cut by split."""
    table, pairs = preprocess_table(prepared, id_col, entity, no_classification_task,
                                    test_fraction, seed, split_col="_split")
    return (table.filter(F.col("_split") == "train").drop("_split"),
            table.filter(F.col("_split") == "test").drop("_split"), pairs)


def augment_with_pairs(train: DataFrame, pairs: DataFrame) -> DataFrame:
    """Train rows plus pair rows (missing columns become null)."""
    return train.unionByName(pairs.select("generator_text", "generator_text_no_company",
                                          "generator_labels"), allowMissingColumns=True)


def filter_tasks(df: DataFrame, tasks: list[str], text_col: str, label_col: str) -> DataFrame:
    """Rows of the given tasks, two columns kept."""
    return df.filter(F.col("task").isin(list(tasks))).select(text_col, label_col)


def project_training_columns(df: DataFrame, use_company: bool = False,
                             label_col: str = "generator_labels") -> DataFrame:
    """``(text, label)`` for training: the prompt with or without company."""
    src = "generator_text" if use_company else "generator_text_no_company"
    return df.select(F.col(src).alias("text"), F.col(label_col).alias("label"))


def dataset_stats(split_table: DataFrame, company_col: str = "company_name",
                  split_col: str = "split") -> DataFrame:
    """Samples per company with their train/test counts, one aggregate."""
    s = F.col(split_col)
    return split_table.groupBy(company_col).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(s == "train").alias("n_train"),
        F.count_if(s == "test").alias("n_test"))
