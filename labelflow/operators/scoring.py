"""Choosing a label from model scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def top1_label(scores, labels=None, digits: int = 6) -> list[Column]:
    """Position (1-based) and value of the largest score, first on ties; with
    ``labels`` also the label at that position (argmax over a scored list)."""
    s = _c(scores)
    best = F.array_max(s)
    pos = F.array_position(s, best)
    out = [pos.cast("bigint").alias("top_idx"), F.round(best.cast("double"), digits).alias("top_score")]
    if labels is not None:
        out.append(F.element_at(_c(labels), pos.cast("int")).alias("top_label"))
    return out


# --------------------------------------------------------------------------
# offline lexical scorer and the pluggable scoring hook
# --------------------------------------------------------------------------
from collections.abc import Callable, Iterator  # noqa: E402

import pyarrow as pa  # noqa: E402
from pyspark.sql import DataFrame, Window  # noqa: E402

from labelflow.functions.text import whitespace_tokens  # noqa: E402
from labelflow.operators.joins import bounded_broadcast  # noqa: E402
from labelflow.operators.matching import MAX_INLINE_LABELS  # noqa: E402
from labelflow.session import cut_lineage  # noqa: E402


def token_set(col) -> Column:
    """Distinct lower-cased whitespace tokens."""
    return F.array_distinct(whitespace_tokens(F.lower(_c(col))))


def _label_tokens(labels: DataFrame, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(tokens, table): documents per token (``tok, df``) and the inverted index, one row per
    label and token with the label's size and the token's place among its tokens, rarest first."""
    lab = labels.select(F.col(label_col).alias("l")).where(F.col("l").isNotNull()).distinct()
    rows = cut_lineage(lab.withColumn("_s", token_set("l"))
                          .select("l", F.size("_s").alias("nl"), F.explode("_s").alias("tok")))
    df = rows.groupBy("tok").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("nl", "l")).alias("rep"))
    place = F.row_number().over(Window.partitionBy("l").orderBy("df", "tok"))
    return df, cut_lineage(rows.join(df.select("tok", "df"), "tok").withColumn("at", place))


def lexical_zero_shot(df: DataFrame, text_col: str, labels: DataFrame, label_col: str,
                      out_col: str = "prediction") -> DataFrame:
    """Offline stand-in for a zero-shot model: the label whose token set has
    the largest Jaccard similarity with the text's (ties: label ascending).

    Only labels that share a token with a text are scored, through an inverted
    token index, once per distinct text; a text that shares none takes the
    smallest label.  For each of its tokens a text first meets one label, the
    smallest of that token's.  The best similarity r found there bounds the
    rest: a label at least as good has between r * n and n / r tokens (n: the
    text's), and shares one of the text's first n - ceil(r * n) + 1 tokens and
    of its own first tokens likewise, rarest tokens first (prefix filter).
    """
    freq, index = _label_tokens(labels, label_col)
    # texts are known by their digest from here on; only tokens that some label holds stay
    tokens = (df.select(F.md5(F.col(text_col)).alias("k"), token_set(text_col).alias("_s"))
                .select("k", F.size("_s").alias("nt"), F.explode("_s").alias("tok")))
    known = cut_lineage(tokens.join(freq, "tok").dropDuplicates(["k", "tok"]))
    own = Window.partitionBy("k")
    placed = known.withColumn("at", F.col("nt") - F.count(F.lit(1)).over(own)
                              + F.row_number().over(own.orderBy("df", "tok")))

    def scored(pairs: DataFrame) -> DataFrame:
        """(k, l, sim) of the pairs (k, l): a label's tokens that the text holds are counted."""
        each = pairs.join(index.select("l", "nl", "tok"), "l")
        both = each.join(known.select("k", "nt", "tok"), ["k", "tok"]).groupBy("k", "l", "nl", "nt").agg(
            F.count(F.lit(1)).alias("c"))
        return both.select("k", "l", (F.col("c") / (F.col("nl") + F.col("nt") - F.col("c"))).alias("sim"))

    first = cut_lineage(scored(known.select("k", F.col("rep.l").alias("l")).distinct()))
    best = first.groupBy("k").agg(F.max("sim").alias("r"))
    nt, nl, r = F.col("nt"), F.col("nl"), F.col("r")

    def prefix(n):
        return n - F.greatest(F.ceil(r * n - 1e-9), F.lit(1)) + 1

    asking = placed.join(best, "k").where(F.col("at") <= prefix(nt)).select("k", "nt", "r", "tok")
    reach = (F.col("lat") <= prefix(nl)) & (nl >= r * nt - 1e-9) & (nt >= r * nl - 1e-9)
    pairs = (asking.join(index.select("l", "nl", "tok", F.col("at").alias("lat")), "tok").where(reach)
                   .select("k", "l").distinct())
    mapping = (first.unionByName(scored(pairs)).groupBy("k")
                    .agg(F.min(F.struct((-F.col("sim")).alias("s"), F.col("l").alias("l"))).alias("_b"))
                    .select(F.col("k").alias("_k"), F.col("_b.l").alias("_hit")))
    least = labels.agg(F.min(label_col)).first()[0]          # one value
    out = df.join(mapping, F.md5(F.col(text_col)) == F.col("_k"), "left")
    return out.withColumn(out_col, F.coalesce("_hit", F.lit(least).cast("string"))).drop("_k", "_hit")


class LexicalScorer:
    """Python twin of :func:`lexical_zero_shot` implementing the scorer protocol
    ``predict(texts) -> predictions``, over an inverted index of label tokens."""

    def __init__(self, labels: list[str]):
        self.labels = sorted(labels)
        self.size, self.holders = [], {}
        for i, x in enumerate(self.labels):
            tokens = set(x.lower().split())
            self.size.append(len(tokens))
            for t in tokens:
                self.holders.setdefault(t, []).append(i)

    def predict(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            tokens = set((t or "").lower().split())
            shared: dict[int, int] = {}
            for x in tokens:
                for i in self.holders.get(x, ()):
                    shared[i] = shared.get(i, 0) + 1
            # labels are sorted: the smallest index wins ties, and the first label where none shares a token
            best = max(shared, key=lambda i: (shared[i] / (self.size[i] + len(tokens) - shared[i]), -i), default=0)
            out.append(self.labels[best] if self.labels else None)
        return out


def lexical_predict(df: DataFrame, text_col: str, labels: DataFrame, label_col: str,
                    out_col: str = "prediction", max_inline_labels: int = MAX_INLINE_LABELS) -> DataFrame:
    """The batch scorer over all labels: a label set that one task can hold goes
    through :func:`score_prompts`, a larger one through the distributed index of
    :func:`lexical_zero_shot`.  No label is left out."""
    rows = (labels.select(F.col(label_col).alias("_l")).where(F.col("_l").isNotNull()).distinct()
                  .limit(max_inline_labels + 1).collect())
    if len(rows) <= max_inline_labels:
        known = sorted(r["_l"] for r in rows)
        return score_prompts(df, text_col, lambda: LexicalScorer(known), out_col)
    return lexical_zero_shot(df, text_col, labels, label_col, out_col)


class LongestTokensExtractor:
    """Offline keyword extractor: the ``k`` longest whitespace tokens (first
    occurrence wins ties), in text order of their ranks."""

    def __init__(self, k: int = 1):
        self.k = k

    def predict(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            toks = (t or "").split()
            order = sorted(range(len(toks)), key=lambda i: (-len(toks[i]), i))[: self.k]
            out.append(" ".join(toks[i] for i in order))
        return out


BATCH_PROMPTS = 256


def score_prompts(df: DataFrame, prompt_col: str, scorer_factory: Callable[[], object],
                  out_col: str = "prediction", batch_size: int = BATCH_PROMPTS) -> DataFrame:
    """Run a text model over every distinct prompt in batches of like lengths.

    Prompts are told apart by a 256-bit digest and scored once each.  Within a
    task they go by length, so a batch of ``batch_size`` prompts needs little
    padding.  ``scorer_factory`` is called once per task (model weights load
    once per executor core); its ``predict(list[str]) -> list[str]`` gets whole
    batches, never single rows.  Answers are joined back by digest; input
    columns pass through unchanged, and null prompts are one prompt.
    """
    digest = F.coalesce(F.unhex(F.sha2(F.col(prompt_col), 256)), F.lit(b""))
    distinct = (df.select(digest.alias("_k"), F.col(prompt_col).alias("_p"))
                  .groupBy("_k").agg(F.first("_p").alias("_p"))
                  .sortWithinPartitions(F.length("_p"), "_k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scorer_factory()
        for keys, prompts in _rebatched(batches, batch_size):
            answers = model.predict(prompts)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(answers, pa.string())], ["_k", "_a"])

    answers = distinct.mapInArrow(run, "_k binary, _a string")
    # answers are written once: the model runs once, the join reads its answers
    answers = bounded_broadcast(answers.select(F.col("_k").alias("_ak"), F.col("_a").alias(out_col)))
    return df.withColumn("_k", digest).join(answers, F.col("_k") == F.col("_ak"), "left").drop("_k", "_ak")


def _rebatched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list]]:
    """(keys, prompts) lists of ``size`` rows in the order of the rows."""
    keys, prompts = [], []
    for b in batches:
        for lo in range(0, len(b), size):
            part = b.slice(lo, size)
            keys += part.column(0).to_pylist()
            prompts += part.column(1).to_pylist()
            while len(keys) >= size:
                yield keys[:size], prompts[:size]
                keys, prompts = keys[size:], prompts[size:]
    if keys:
        yield keys, prompts


def longest_tokens(col, k: int = 1) -> Column:
    """Native twin of :class:`LongestTokensExtractor`."""
    toks = whitespace_tokens(col)
    ranked = F.transform(toks, lambda t, i: F.struct((-F.length(t)).alias("neg"), i.alias("i"),
                                                     t.alias("t")))
    return F.array_join(F.transform(F.slice(F.array_sort(ranked), 1, k), lambda x: x["t"]), " ")


def two_stage_predict(df: DataFrame, text_col: str, extractor_factory, scorer_factory=None,
                      out_col: str = "prediction", labels: DataFrame | None = None,
                      label_col: str = "label") -> DataFrame:
    """Extract keywords with one scorer, classify them with another (or, given
    ``labels``, with the lexical one); the original text is kept in ``original``."""
    staged = score_prompts(df.withColumn("original", F.col(text_col)), "original",
                           extractor_factory, "extracted")
    if labels is not None:
        return lexical_predict(staged, "extracted", labels, label_col, out_col)
    return score_prompts(staged, "extracted", scorer_factory, out_col)
