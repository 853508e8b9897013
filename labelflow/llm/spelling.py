"""Spelling variant grouping by finite-state composition.

1. Words are counted over all texts.  A run whose crc32 with its document's id
   is a multiple of ``EVERY`` loses one code point first (the contract's typos).
2. The pairs of words one edit apart are the paths of the composition
   acceptor . one-edit transducer . acceptor.  Its start is split into
   partitions: for a shorter length L the edit falls into the first or the
   second half of the positions, and both words then share all that lies outside
   that half.  A partition is the words of L and L + 1 code points that share it,
   so its initial state is the one reached by the shared half.  Words are dealt
   to partitions by a shuffle; each is small, as words are distinct.
3. A partition above ``GROUP_WORDS`` words is split at the same point again:
   the window of edit positions is halved, and the words share more.  A window
   of one position holds at most two words a letter of the alphabet.
4. In a task the words of a partition become a minimal acceptor.  The
   composition is walked from the initial state: equal symbols on both sides up
   to the edit, then one replaced or inserted symbol, then the intersection of
   the two states' languages.  Every pair has its edit at the end of the common
   prefix, so it is found once, in one partition.
5. Forms are followed to their roots by doubling the links, written each time.

Null and empty texts have no words; null ids count as the empty id.  Very long
texts are read in parts cut between words.  Repeated rows are counted each, ties
in n go to the smaller word in code-point order, and an empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm import common as C
from labelflow.operators.joins import bounded_broadcast

EVERY = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5
GROUP_WORDS = 20_000
LONG_WORD = 64

# Not a letter, seen by a single byte: U+00C0 to U+00FF are 0xC3 and a continuation byte.
_EDGE = np.ones(256, bool)
_EDGE[65:91] = _EDGE[97:123] = _EDGE[0x80:0xC0] = False
_EDGE[0xC3] = False
# the crc32 step of a byte: a one-byte crc starts from 0xFFFFFFFF and is inverted at the end
_CRC = np.array([zlib.crc32(bytes([b ^ 0xFF])) for b in range(256)], np.uint32) ^ np.uint32(0xFF000000)


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lowered bytes, start, end, row, code points) of every run of letters."""
    low = C.LOWER[data]
    letter = ((low >= 97) & (low <= 122)) | (low == 0xC3)
    letter[1:] |= low[:-1] == 0xC3
    start, end, row = C.words(low, offsets, ~letter)
    lead = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
    return low, start, end, row, lead[end] - lead[start]


def run_crc(low: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """crc32 of prefix and run for every run; ``prefix`` holds the crc32 of what comes before."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    state = ~prefix[order]
    for j in range(min(int(left[0]) if len(left) else 0, LONG_WORD)):
        m = int(np.searchsorted(-left, -j, "left"))        # runs longer than j bytes
        state[:m] = (state[:m] >> np.uint32(8)) ^ _CRC[(state[:m] ^ low[at[:m] + j]) & np.uint32(0xFF)]
    out = np.empty(len(start), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = zlib.crc32(low[start[i]:end[i]].tobytes(), int(prefix[i]))
    return out


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): runs of at least ``LEAST_LETTERS`` code points, after their edits."""
    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("i"), docs[text_col].cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head = np.array([zlib.crc32(f"{i}:".encode()) for i in b.column(0).to_pylist()], np.uint32)
            for lo, _, data, off in C.text_slices(b.column(1)):
                for part, cut in C.parts(data, off, _EDGE):
                    low, start, end, row, letters = letter_runs(part, cut)
                    use = letters >= LEAST_LETTERS
                    start, end, row, letters = start[use], end[use], row[use], letters[use]
                    crc = run_crc(low, start, end, head[lo + row])
                    edited = crc % EVERY == 0
                    typed = Counter()
                    for i in np.flatnonzero(edited):
                        w, at = low[start[i]:end[i]].tobytes().decode(), int(crc[i]) % int(letters[i])
                        if letters[i] > LEAST_LETTERS:
                            typed[w[:at] + w[at + 1:]] += 1
                    start, end = start[~edited], end[~edited]
                    _, first, n = np.unique(C.span_hashes(low, start, end), return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [C.spans(low, start[first], end[first], pa.string()), pa.array(n, pa.int64())], ["word", "n"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(typed), pa.string()), pa.array(list(typed.values()), pa.int64())], ["word", "n"])
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def acceptor(words: list[str]) -> tuple[int, list[dict[str, int]], list[bool]]:
    """(initial state, arcs, final) of the minimal acceptor of sorted distinct words."""
    register: dict[tuple, int] = {}
    arcs: list[dict[str, int]] = []
    final: list[bool] = []

    def state(children: dict[str, int], end: bool) -> int:
        sign = (end, tuple(children.items()))
        if sign not in register:
            register[sign] = len(arcs)
            arcs.append(children)
            final.append(end)
        return register[sign]

    path: list[dict[str, int]] = [{}]
    ends = [False]
    last = ""
    for w in words:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        while len(path) - 1 > same:
            s = state(path.pop(), ends.pop())
            path[-1][last[len(path) - 1]] = s
        path += [{} for _ in w[same:]]
        ends += [False] * (len(w) - same)
        ends[-1] = True
        last = w
    while len(path) > 1:
        s = state(path.pop(), ends.pop())
        path[-1][last[len(path) - 1]] = s
    return state(path[0], ends[0]), arcs, final


def one_edit_pairs(words: list[str], length: int, low: int, high: int) -> Iterator[tuple[str, str]]:
    """(x, y): x of ``length`` code points, y one replacement or insertion away, first differing
    at a position from ``low`` to before ``high``; ``words`` are sorted and distinct."""
    initial, arcs, final = acceptor(words)

    def shared(p: int, q: int, barred: str = "") -> list[str]:
        """Strings both states accept, not beginning with ``barred``."""
        out, open_ = [], [(p, q, "")]
        while open_:
            p, q, s = open_.pop()
            if final[p] and final[q]:
                out.append(s)
            few, many = (arcs[p], arcs[q]) if len(arcs[p]) <= len(arcs[q]) else (arcs[q], arcs[p])
            for c in few:
                if c in many and (s or c != barred):
                    open_.append((arcs[p][c], arcs[q][c], s + c))
        return out

    edits: dict[int, list[tuple[str, str]]] = {}

    def edited(p: int) -> list[tuple[str, str]]:
        """Rests of x and y from a state both have reached, with the edit here."""
        if p not in edits:
            out = []
            for i, (c, to) in enumerate(arcs[p].items()):
                for d, other in itertools.islice(arcs[p].items(), i + 1, None):
                    out += [(c + s, d + s) for s in shared(to, other)]
                out += [(s, c + s) for s in shared(p, to, c)]
            edits[p] = out
        return edits[p]

    walk = [(initial, "")]
    while walk:
        p, s = walk.pop()
        if len(s) >= low:
            yield from ((s + x, s + y) for x, y in edited(p) if len(s) + len(x) == length)
        if len(s) + 1 < high:
            walk += [(to, s + c) for c, to in arcs[p].items()]


def _keyed(words: DataFrame, windows: Column) -> DataFrame:
    """``words`` (word, n, base) once per edit window, with the key of its partition."""
    out = words.withColumn("win", F.explode(windows)).select("word", "n", "base", "win.low", "win.high")
    tail = F.greatest(F.col("base") - F.col("high"), F.lit(0))
    head = F.substring("word", F.lit(1), F.col("low"))
    rest = F.when(tail > 0, F.substring("word", F.length("word") - tail + 1, tail)).otherwise("")
    return out.withColumn("key", F.concat_ws(",", "base", "low", "high", head, rest))


def _halves(low: Column, middle: Column, high: Column) -> Column:
    return F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high")))


def partitions(vocabulary: DataFrame, most: int = GROUP_WORDS) -> DataFrame:
    """(word, n, base, low, high, key): every word in the partitions that may hold a near word, written."""
    base = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("base")
    words = vocabulary.select("word", "n", base).where(F.col("base") >= LEAST_LETTERS)
    level = C.materialize(_keyed(words, _halves(F.lit(0), F.floor(F.col("base") / 2).cast("int"), F.col("base") + 1)),
                          "partitions")
    done = None
    while True:
        large = (level.where("high - low > 1").groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most)
                 .select("key"))
        if large.isEmpty():
            return level if done is None else done.unionByName(level)
        large = bounded_broadcast(C.materialize(large, "large_keys"))
        small = level.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        grown = level.join(large, "key", "left_semi")
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        again = grown.select("word", "n", "base", _halves(F.col("low"), middle, F.col("high")).alias("halves"))
        level = C.materialize(_keyed(again, F.col("halves")), "partitions")


def near_pairs(parts: DataFrame) -> DataFrame:
    """(word, other, m): every near pair in both directions, m the count of the other word."""
    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, int]] = []

        def batch() -> pa.RecordBatch:
            word, other, m = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(other, pa.string()),
                                               pa.array(m, pa.int64())], ["word", "other", "m"])
        for _, rows in itertools.groupby(stream(batches), key=lambda r: r[0]):
            rows = list(rows)
            if len(rows) == 1:
                continue
            n = {r[1]: r[2] for r in rows}
            _, _, _, base, low, high = rows[0]
            for x, y in one_edit_pairs(sorted(n), base, low, high):
                out += [(x, y, n[y]), (y, x, n[x])]
                if len(out) >= 20_000:
                    yield batch()
                    out.clear()
        yield batch()

    dealt = (parts.select("key", "word", "n", "base", "low", "high")
             .repartition(C.partitions(parts.sparkSession), "key").sortWithinPartitions("key"))
    return dealt.mapInArrow(run, "word string, other string, m bigint")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by doubling: forms grow in n, so links end."""
    now = C.materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = now.select(F.col("word").alias("w"), F.col("root").alias("r"))
        step = C.materialize(now.join(nxt, F.col("root") == F.col("w"), "left")
                             .select("word", F.coalesce("r", "root").alias("root"),
                                     F.col("w").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT,
             times: int = TIMES, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    vocabulary = C.materialize(word_counts(docs, id_col, text_col).where(F.col("n") >= least_count), "vocabulary")
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("best")
    near = near_pairs(partitions(vocabulary, group_words)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    form = -F.col("best.m") >= times * F.col("n")
    table = C.materialize(
        vocabulary.join(near, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(form, F.col("best.form")).alias("form"), F.when(form, -F.col("best.m")).alias("form_n")), "variants")
    ends = roots(table.where("form is not null"))
    return (table.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def q_op12(spark, sf_dir):
    return variants(C.read(spark, sf_dir, "documents"))


QUERIES = {"op12_spelling_variants": q_op12}
ORACLE_SQL: dict[str, str] = {}
