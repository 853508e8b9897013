"""Small tables with the awkward cases, and plain Python versions to compare with."""

from __future__ import annotations

import random
import re
import zlib

from pyspark.sql import types as T

# columns of documents plus ones whose names clash with internal and output names
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("node", T.StringType()), T.StructField("t", T.StringType()),
    T.StructField("dropped_id", T.LongType()), T.StructField("digest", T.StringType())])


def texts(seed: int = 1) -> list[str | None]:
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    base = [" ".join(r.choice(vocab) for _ in range(n)) for n in (3, 12, 40, 90, 150, 400)]
    out: list[str | None] = [None, "", "", "   \n\t ", "a", "É ÇA\nà 12 ", base[0], base[0].upper(), base[1], base[1]]
    for b in base[2:]:
        words = b.split(" ")
        out += [b, b.upper(), b + " tail"]
        for _ in range(6):                      # near copies of near copies
            w = list(words)
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    out += ["same line\n" + x for x in base] + ["same line\n Same LINE \nother %d" % i for i in range(12)]
    out.append(" ".join(r.choice(vocab) for _ in range(40_000)))            # a very long text
    out.append("x" * 150_000)                                              # without any boundary
    out.append("a<|endoftext|>b don't!'s  \n\n x ü×. 你好 世界 　y\U0001f600")
    return out


def frame(spark, rows=None):
    """Documents; ids ascending, the last two rows repeat others with their ids."""
    rows = texts() if rows is None else rows
    data = [(i, t, ("en", "fr")[i % 2] if i % 7 else None, "src0", len(t or ""), "x", "x", "x", "x", "x", i, "x")
            for i, t in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t: str | None) -> str:
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def fold(i, m: int) -> int:
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


def shingles(t: str | None, n: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def components(ids: list, links: list[tuple]) -> dict:
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_classes(rows: dict[int, str | None], n: int, percent: int) -> dict[int, int]:
    sets = {i: shingles(t, n) for i, t in rows.items()}
    ids = [i for i in sets if sets[i]]
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return components(list(sets), links)
