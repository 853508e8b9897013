"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of labelled
text: pieces of up to ``SAMPLE_DOCS`` distinct texts, all as long as each other
as far as the texts reach, ``SAMPLE_BYTES`` in all.  A text is parsed against it into phrases: each phrase is the longest
match in the sample from where the last one ended (an unknown byte is a phrase
of its own).  The fewer phrases, the lower the cross entropy; the language with
the fewest normalised phrases (phrases x log2 of the sample size, per byte)
wins, ties going to the first in order.

The automaton with "start a new phrase at the root" filled in is a complete
transition table with one output bit, so whole slices are parsed by array
lookups: texts are cut into windows of ``WINDOW`` bytes that advance together,
each parsed from the root.  Texts are read in lower case, with every run of
ASCII non-letters as one blank.

A text that is null or has no letter is ``und`` with score 0.  Without any
labelled text every text is ``und``, as it is with more languages than
``SAMPLE_TOTAL`` bytes (none gets a byte then).  The score is the runner-up's
phrases as a share of both counts, 1 if a single language is known.  Rows with a
null id, and repeated rows, are predicted one by one; rows without id, text or
lang are not learned from.  Whole texts are read, very long ones in windows.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm import common as C

SAMPLE_BYTES = 24_000       # labelled text a language is learned from
SAMPLE_TOTAL = 125_000      # of all languages together: at most 2 states a byte, each of 4 bytes
                            # a byte class (256 at most), so all tables stay below 256 MB
SAMPLE_DOCS = 200           # distinct texts a language's sample is drawn from
SAMPLE_PARTS = 16
WINDOW = 1024
LETTER = re.compile(r"[^\W\d_]")

_KEEP = np.array([97 <= (c | 32) <= 122 or c >= 128 for c in range(256)])
_PLAIN = np.where(_KEEP, np.arange(256), 32).astype(np.uint8)


def plain_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with each run of ASCII non-letters as one blank, within its row."""
    if not len(data):
        return data, offsets
    keep = _KEEP[data]
    first = np.ones(len(data), bool)
    first[1:] = keep[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    stay = keep | first
    return _PLAIN[data[stay]], np.concatenate([[0], np.cumsum(stay)])[offsets]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton (state 0 is the root): online construction."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray            # byte -> class, shared by all tables
    n_classes: int
    tables: list[np.ndarray]       # (state * n_classes + class) -> next state * n_classes * 2 + new phrase
    weight: np.ndarray             # log2 of the sample size


def fit(samples: dict[str, bytes]) -> Model:
    """Parsing tables of the languages' samples."""
    languages = sorted(k for k, v in samples.items() if v)
    used = sorted(set().union(*(samples[k] for k in languages))) if languages else []
    classes = np.zeros(256, np.int32)                     # class 0: bytes of no sample
    classes[used] = np.arange(1, len(used) + 1)
    n = len(used) + 1
    tables = []
    for k in languages:
        step = suffix_automaton(samples[k])
        root = np.zeros(n, np.int64)
        for c, to in step[0].items():
            root[classes[c]] = to
        # without a transition the phrase ends: the byte starts one at the root
        table = np.tile(root * (2 * n) + 1, (len(step), 1))
        table[0] = root * (2 * n) + 1                     # at the root every byte starts a phrase
        for s, row in enumerate(step):
            if s:
                for c, to in row.items():
                    table[s, classes[c]] = to * (2 * n)
        tables.append(table.ravel().astype(np.int32))
    return Model(languages, classes, n, tables, np.log2([len(samples[k]) + 1.0 for k in languages]))


def phrases(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(row, language): number of phrases; ``data`` are plain bytes."""
    rows, langs = len(offsets) - 1, len(model.languages)
    out = np.zeros((rows, langs), np.int64)
    size = np.diff(offsets)
    n_win = -(-size // WINDOW)
    row = np.repeat(np.arange(rows), n_win)
    begin = C.gather_spans(n_win, np.zeros(rows, np.int64)) * WINDOW + offsets[:-1][row]
    length = np.minimum(WINDOW, offsets[1:][row] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length, row = begin[order], length[order], row[order]
    coded = model.classes[data]
    active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
    for j, table in enumerate(model.tables):
        state = np.zeros(len(begin), np.int32)
        count = np.zeros(len(begin), np.int32)
        for t, m in enumerate(active):
            nxt = table[(state[:m] >> 1) + coded[begin[:m] + t]]
            count[:m] += nxt & 1
            state[:m] = nxt
        out[:, j] = np.bincount(row, count, rows).astype(np.int64)
    return out


def level(sizes: list[int], total: int) -> int:
    """Largest size such that pieces of at most that size sum up to ``total`` or less."""
    left = total
    for i, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - i) > left:
            return left // (len(sizes) - i)
        left -= n
    return max(sizes, default=0)


def sample_pieces(docs: DataFrame, labelled, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, int]:
    """(lang, key, t): one piece of each drawn text, and the bytes a language may have.

    Distinct texts are drawn in the order of their digests, so copies count once.
    The pieces of a language have twice its bytes at most (blanks are dropped
    later), dealt evenly; a piece starts anywhere in its text, by the digest.
    """
    text = F.col(text_col).cast("string")
    rows = docs.where(labelled).select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"),
                                       F.unhex(F.md5(text)).alias("key"), text.alias("t")).dropna()
    distinct = rows.groupBy("lang", "key").agg(F.max(F.octet_length("t")).alias("size"),
                                               F.max(F.length("t")).alias("chars")).where("size > 0")
    # a language's first texts are among the first of its parts: what one task ranks does not grow with the tasks
    parts = distinct.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(SAMPLE_PARTS)))
    for by in (("lang", "part"), ("lang",)):
        parts = (parts.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("key")))
                 .where(F.col("n") <= SAMPLE_DOCS))
    drawn = C.materialize(parts.drop("part"), "language_sample")
    most = min(SAMPLE_BYTES, SAMPLE_TOTAL // max(1, drawn.select("lang").distinct().count()))
    # with very many languages each has fewer texts, not shorter pieces
    drawn = drawn.where(F.col("n") <= (max(1, most * SAMPLE_DOCS // SAMPLE_BYTES) if most else 0))
    by_size, every = Window.partitionBy("lang").orderBy("size", "key"), Window.partitionBy("lang")
    # an even share of what the smaller texts leave; the largest of these is the length of a cut piece
    share = ((F.lit(2 * most) - F.sum("size").over(by_size) + F.col("size"))
             / (F.count(F.lit(1)).over(every) - F.row_number().over(by_size) + 1))
    cut = (drawn.withColumn("share", share).withColumn("share", F.max("share").over(every))
           .withColumn("take", F.floor(F.least("size", "share") * F.col("chars") / F.col("size")).cast("int"))
           .withColumn("at", (F.pmod(F.xxhash64("key"), F.col("chars") - F.col("take") + 1) + 1).cast("int"))
           .select("lang", "key", "take", "at"))
    return (rows.join(F.broadcast(cut), ["lang", "key"])
            .select("lang", "key", F.substring("t", F.col("at"), F.col("take")).alias("t"))
            .groupBy("lang", "key").agg(F.min("t").alias("t"))), most


def sample_texts(docs: DataFrame, labelled, id_col: str, text_col: str, lang_col: str) -> dict[str, bytes]:
    """Plain bytes of the drawn texts' pieces by language, a blank between them; predictions read whole texts."""
    pieces, most = sample_pieces(docs, labelled, id_col, text_col, lang_col)
    found: dict[str, list[bytes]] = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.lang, r.key)):
        raw = np.frombuffer(r.t.lower().encode() + b" ", np.uint8)
        found.setdefault(r.lang, []).append(plain_bytes(raw, np.array([0, len(raw)]))[0].tobytes())
    samples = {}
    for k, v in found.items():
        size = level([len(x) for x in v], most)
        samples[k] = b"".join(x if len(x) <= size else x[:size - 1] + b" " for x in v if size)
    return samples


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    # plain data: workers may not have this package
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.classes, model.n_classes, model.tables,
                                                     model.weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        names = np.array([*m.languages, "und"], object)
        for b in batches:
            for lo, hi, data, off in C.text_slices(b.column(1)):
                raw = data.tobytes()
                texts = [raw[off[i]:off[i + 1]].decode() for i in range(hi - lo)]
                low = [t.lower().encode() for t in texts]
                ends = np.concatenate([[0], np.cumsum([len(t) for t in low])])
                flat, at = plain_bytes(np.frombuffer(b"".join(low), np.uint8), ends)
                score, pick = np.zeros(hi - lo), np.full(hi - lo, len(m.languages))
                if m.languages:
                    cost = phrases(m, flat, at) * m.weight
                    known = np.array([bool(LETTER.search(t)) for t in texts])
                    ranked = np.sort(cost, axis=1)
                    second = ranked[:, 1] if len(m.languages) > 1 else np.ones(hi - lo)
                    first = ranked[:, 0] if len(m.languages) > 1 else np.zeros(hi - lo)
                    pick = np.where(known, cost.argmin(axis=1), pick)
                    score = np.where(known, second / np.maximum(first + second, 1e-9), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(names[pick], pa.string()), pa.array(score, pa.float64())],
                    schema.names)
    return rows.mapInArrow(run, schema)


def q_op2(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents")
    model = fit(sample_texts(docs, C.fold("doc_id", 5) != 0, "doc_id", "text", "lang"))
    held = (C.fold("doc_id", 5) == 0).alias("held_out")
    return predict(docs, model).select("doc_id", held, "lang_pred", "score")


QUERIES = {"op2_cross_parsing": q_op2}
ORACLE_SQL: dict[str, str] = {}
