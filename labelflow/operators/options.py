"""Option lists rendered into prompts.

Every builder aggregates to one row per group (company / dataset / query)
and returns the option text there; callers join that small table back last,
so long option strings never travel through a shuffle of the big table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.functions.prompts import company_options_block

# Headers and bullets of the reference's option blocks.
TAXONOMY_HEADER = "OPTIONS\n"
TOPN_HEADER = "Options:\n"
EXPANDED_SUFFIX = " # other # general # unknown "


def prompt_options_company(df: DataFrame, company_col: str, class_col: str,
                           number_col: str, pos_col: str, bullet: str | None = None,
                           name: str = "prompt_options") -> DataFrame:
    """Per company: each distinct class once, in first-appearance order, with
    the class number of its first appearance: ``"{num}.{class} \\n"`` (or
    ``"{bullet} {class} \\n"``), wrapped in the indented ``OPTIONS:`` block."""
    first = df.groupBy(company_col, class_col).agg(
        F.min(pos_col).alias("_p"), F.min_by(number_col, pos_col).alias("_num"))
    item = F.struct(F.col("_p"), F.col(class_col).alias("c"), F.col("_num").alias("num"))
    per = first.groupBy(company_col).agg(F.array_sort(F.collect_list(item)).alias("_o"))
    if bullet is None:
        line = lambda x: F.concat(x["num"].cast("string"), F.lit("."), x["c"], F.lit(" \n"))
    else:
        line = lambda x: F.concat(F.lit(bullet + " "), x["c"], F.lit(" \n"))
    text = F.array_join(F.transform("_o", line), "")
    return per.select(company_col, company_options_block(text).alias(name))


def option_numbering(labels: DataFrame, key_col: str, name_col: str) -> DataFrame:
    """Mapped labels numbered from 1 in key order: ``(option_no, key, label)``."""
    w = Window.orderBy(key_col)
    return (labels.select(key_col, name_col).distinct()
                  .withColumn("option_no", F.row_number().over(w).cast("bigint"))
                  .select("option_no", key_col, F.col(name_col).alias("label")))


def prompt_options_taxonomy(present_keys: DataFrame, taxonomy: DataFrame, key_col: str = "key",
                            name_col: str = "name", bullet: str | None = None,
                            use_default_labels: bool = False,
                            by: Sequence[str] = (), name: str = "prompt_options") -> DataFrame:
    """``OPTIONS\\n`` + one line per taxonomy label whose key occurs in
    ``present_keys`` (sorted by key): ``" {i}. {name} \\n"`` or
    ``"{bullet} {name} \\n"``; ``use_default_labels`` shows the raw key."""
    keys = present_keys.select(*by, key_col).distinct()
    mapped = keys.join(taxonomy.select(key_col, name_col), key_col, "inner")
    shown = F.col(key_col).cast("string") if use_default_labels else F.col(name_col)
    item = F.struct(F.col(key_col).alias("k"), shown.alias("n"))
    per = mapped.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_o"))
    if bullet is None:
        body = F.array_join(F.transform("_o", lambda x, i: F.concat(
            F.lit(" "), (i + 1).cast("string"), F.lit(". "), x["n"], F.lit(" \n"))), "")
    else:
        body = F.array_join(F.transform("_o", lambda x: F.concat(
            F.lit(bullet + " "), x["n"], F.lit(" \n"))), "")
    return per.select(*by, F.concat(F.lit(TAXONOMY_HEADER), body).alias(name))


def prompt_options_expanded(present_keys: DataFrame, taxonomy: DataFrame,
                            expansion: DataFrame, key_col: str = "key", name_col: str = "name",
                            extra_col: str = "names", bullet: str | None = None,
                            use_default_labels: bool = False,
                            name: str = "prompt_options") -> DataFrame:
    """Like :func:`prompt_options_taxonomy`, but a key with extra names emits
    ``"# {extra}\\n"`` per name without taking a number, and the block ends
    with ``" # other # general # unknown "``."""
    keys = present_keys.select(key_col).distinct()
    mapped = (keys.join(taxonomy.select(key_col, name_col), key_col, "inner")
                  .join(expansion.select(key_col, extra_col), key_col, "left"))
    shown = F.col(key_col).cast("string") if use_default_labels else F.col(name_col)
    is_exp = F.col(extra_col).isNotNull()
    # numbers advance only on non-expanded keys
    w = Window.orderBy(key_col).rowsBetween(Window.unboundedPreceding, 0)
    numbered = mapped.withColumn("_i", F.sum(F.when(is_exp, 0).otherwise(1)).over(w))
    if bullet is None:
        plain = F.concat(F.lit(" "), F.col("_i").cast("string"), F.lit(". "), shown, F.lit(" \n"))
    else:
        plain = F.concat(F.lit(bullet + " "), shown, F.lit(" \n"))
    extra = F.array_join(F.transform(extra_col, lambda e: F.concat(F.lit("# "), e, F.lit("\n"))), "")
    line = F.when(is_exp, extra).otherwise(plain)
    per = numbered.agg(F.array_sort(F.collect_list(F.struct(F.col(key_col).alias("k"),
                                                            line.alias("l")))).alias("_o"))
    return per.select(F.concat(F.lit(TAXONOMY_HEADER),
                               F.array_join(F.transform("_o", lambda x: x["l"]), ""),
                               F.lit(EXPANDED_SUFFIX)).alias(name))


def prompt_options_topn(ranked: DataFrame, group_col: str, rank_col: str, text_col: str,
                        bullet: str = "#", name: str = "prompt_options") -> DataFrame:
    """``Options:\\n`` + ``"{bullet} {text} \\n"`` for each group's ranked texts."""
    item = F.struct(F.col(rank_col).alias("r"), F.col(text_col).alias("t"))
    per = ranked.groupBy(group_col).agg(F.array_sort(F.collect_list(item)).alias("_o"))
    body = F.array_join(F.transform("_o", lambda x: F.concat(F.lit(bullet + " "), x["t"],
                                                             F.lit(" \n"))), "")
    return per.select(group_col, F.concat(F.lit(TOPN_HEADER), body).alias(name))


# Fixed value: the default template of the template-dataset builder.
DEFAULT_TEMPLATE = "This sentence is {}"


def templated_dataset(labels: DataFrame, label_col: str, sample_size: int,
                      template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """``sample_size`` template rows per label: ``(label, copy, text)``.
    Copies come from ``explode(sequence)``, not from a join."""
    pre, post = template.split("{}")
    return (labels.select(F.col(label_col).alias("label")).distinct()
                  .select("label", F.explode(F.sequence(F.lit(1).cast("bigint"),
                                                        F.lit(sample_size).cast("bigint"))).alias("copy"))
                  .withColumn("text", F.concat(F.lit(pre), F.col("label"), F.lit(post))))
