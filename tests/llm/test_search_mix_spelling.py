"""Ranked lexical search, spelling variants and the source mix."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
from pyspark.sql import functions as F

from labelflow.llm import common as C
from labelflow.llm import max_sketch as S
from labelflow.llm import source_mix as M
from labelflow.llm import spelling as V

# ---------------------------------------------------------------- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs: list, items: list, k: int) -> list[tuple]:
    """docs: (id, text) rows, items: (id, text) rows."""
    bags = [(i, TERM.findall(cases.lower(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(len(b) for _, b in bags)
    counts = [(i, len(b), Counter(b)) for i, b in bags]
    df = Counter(t for _, _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall(cases.lower(t)))
    out = []
    for item, ts in asked.items():
        found = []
        for i, size, c in counts:
            m = 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in ts if t in c)
            if s > 0:
                found.append((-s, i is not None, i or 0, i))
        found.sort()
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(found[:k])]
    return sorted(out, key=str)


def search_rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def item_frame(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string, score string").repartition(3)


def test_search_equals_plain_scoring(spark, monkeypatch):
    texts = cases.texts()
    docs = cases.frame(spark).unionByName(cases.frame(spark).where("doc_id in (6, 9, 40)"))
    docs = docs.unionByName(docs.where("doc_id in (2, 7)").withColumn("doc_id", F.lit(None).cast("long")))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(1, texts[6] + " ÇA 12"), (2, None), (3, ""), (4, texts[10][:60]), (4, texts[11]), (None, "same line"),
             (7, "x" * 150_000), (8, "nowhere zzzzzz"), (9, texts[12]), (9, texts[12]), (10, "你好 y\U0001f600")]
    asked = item_frame(spark, [(*i, "x") for i in items])
    want = plain_search(rows, items, 5)
    assert search_rows(S.search(docs, asked, 5)) == want and want
    # several sets of items, a first part with thresholds, blocks of few documents, narrow sketches
    for name, value in (("SET_ITEMS", 3), ("FIRST_ROWS", 20), ("BLOCK_DOCS", 7), ("SKETCH", 8), ("FIRST_SCORED", 2),
                        ("ITEM_COLUMNS", 2)):
        monkeypatch.setattr(S, name, value)
    assert search_rows(S.search(docs, asked, 5)) == want


def test_search_long_text_in_parts(monkeypatch):
    r = random.Random(5)
    text = " ".join("".join(r.choice("abcé9") for _ in range(r.randint(1, 9))) for _ in range(5000)).encode()
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = S.terms(data, off)
    found = []
    for part, cut in C.parts(data, off, S.BREAK, 1000):
        low, start, end, _ = S.terms(part, cut)
        found += [low[a:b].tobytes() for a, b in zip(start, end)]
    assert found == [whole[0][a:b].tobytes() for a, b in zip(whole[1], whole[2])]
    assert sum(len(p) for p, _ in C.parts(data, off, S.BREAK, 1000)) == len(data)


def test_search_empty_tables(spark):
    asked = item_frame(spark, [(1, "a", "x")])
    assert search_rows(S.search(cases.empty(spark), asked)) == []
    assert search_rows(S.search(cases.frame(spark), asked.where("false"))) == []


# ---------------------------------------------------------------- spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows: list) -> list[tuple]:
    count = Counter()
    for i, t in rows:
        for w in RUN.findall(t or ""):
            w = cases.lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    links, form = defaultdict(list), {}
    for a in n:
        for b in n:
            if near(a, b):
                links[a].append(b)
    for a, bs in links.items():
        best = min(bs, key=lambda b: (-n[b], b))
        if n[best] >= 5 * n[a]:
            form[a] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(links[w]), n[form[w]] if w in form else None))
    return sorted(out)


def variant_rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def spelling_texts() -> list[str | None]:
    r = random.Random(3)
    letters = "abceé×"
    base = ["".join(r.choice(letters) for _ in range(r.randint(6, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aabaaaa"]
    words = []
    for w in base:
        words += [w] * r.choice((8, 60, 400))
        for _ in range(5):
            i, c = r.randrange(len(w)), r.choice(letters)
            v = r.choice((w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:]))
            words += [v] * r.choice((3, 6, 30))
    words += ["chainab"] * 500 + ["chainac"] * 60 + ["chaindc"] * 8
    words += ["internationalisation" * 5] * 9 + ["internationalisation" * 5 + "s"] * 50
    r.shuffle(words)
    out: list[str | None] = [" ".join(words[i:i + 40]) for i in range(0, len(words), 40)]
    out += [None, "", "short", out[0].upper(), out[1], out[1], "日本 ÀÉÎ·" + out[2].replace(" ", "-")]
    return out


def test_variants_equal_all_pairs(spark):
    docs = cases.frame(spark, spelling_texts())
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id in (4, 5)").withColumn("doc_id", F.lit(None).cast("long")))
    want = plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(want) > 60 and sum(w[1] is not None for w in want) > 10 and any(w[1] != w[2] for w in want if w[1])
    assert variant_rows(V.variants(docs)) == want
    assert variant_rows(V.variants(docs, group_words=3)) == want             # partitions split to single positions


def test_variants_of_given_tables_equal_all_pairs(spark):
    docs = C.read(spark, "/root/testdata/sf0.001", "documents")
    want = plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert variant_rows(V.variants(docs)) == want and want


def test_variants_of_nothing(spark):
    assert variant_rows(V.variants(cases.empty(spark))) == []
    assert variant_rows(V.variants(cases.frame(spark, [None, "", "a b c"]))) == []


def test_run_crc_and_long_words():
    words = ["a", "é" * 40, "x" * 200, "word"]
    text = " ".join(words).encode()
    low, start, end, row, letters = V.letter_runs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    head = np.full(4, zlib.crc32(b"17:"), np.uint32)
    assert V.run_crc(low, start, end, head).tolist() == [zlib.crc32(b"17:" + w.encode()) for w in words]
    assert letters.tolist() == [1, 40, 200, 4]


def test_acceptor_is_minimal():
    initial, arcs, final = V.acceptor(["tap", "taps", "top", "tops"])
    assert len(arcs) == 5 and sum(final) == 2 and set(arcs[initial]) == {"t"}


# ---------------------------------------------------------------- source mix

def plain_mix(rows: list) -> list[tuple]:
    """rows: (id, source, text); targets by resharing round after round."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows]
    total = defaultdict(int)
    for _, s, n in sized:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    whole, capped = sum(total.values()), set()
    while True:
        left = whole - sum(3 * total[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * total[s] if s in capped else left * weight[s] / w for s in names}
        above = {s for s in names if target[s] > 3 * total[s]}
        if not above:
            return sized, total, target
        capped |= above


def mix_rows(spark, data):
    return spark.createDataFrame(data, "doc_id bigint, source string, text string, size string, s bigint, slot int").repartition(4)


def mix_data():
    r = random.Random(8)
    data = [(i, r.choice(["a", "b", "b", "b", "c", None]), " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 80))))
            for i in range(400)]
    data += [(1000, "tiny", "one two"), (1001, "é", "  "), (1002, "zero", None), (1003, "long", "word\t" * 30_000),
             (None, "a", "x y"), (None, "a", "x y z"), (1, "a", "")] + [(77, "hot", "one two three")] * 300
    return [(*x, "x", 1, 2) for x in data]


def test_mix_meets_targets(spark, monkeypatch):
    data = mix_data()
    sized, total, target = plain_mix([x[:3] for x in data])
    monkeypatch.setattr(M, "COPY_CHUNK", 32)
    got = [tuple(r) for r in M.taken(mix_rows(spark, data), block=16).collect()]
    again = [tuple(r) for r in M.taken(mix_rows(spark, data[::-1]), block=16).collect()]
    assert sorted(got, key=str) == sorted(again, key=str)
    assert Counter((i, n) for i, n, *_ in got) == Counter((i, n) for i, _, n in sized)
    by_size = defaultdict(set)
    for s, n in total.items():
        by_size[n].add(s)
    sums = defaultdict(int)
    for _, n, size, want, took in got:
        assert 0 <= took <= 3 * n
        assert any(abs(want - target[s]) < 1e-6 * max(1, want) for s in by_size[size])
        sums[(size, want)] += took
    assert all(abs(took - want * len([1 for s in by_size[size] if abs(target[s] - want) < 1e-6 * max(1, want)])) <= 1
               for (size, want), took in sums.items())
    assert abs(sum(x[4] for x in got) - sum(total.values())) <= len(total)


def test_mix_is_a_schedule_of_blocks(spark):
    data = mix_data()
    rows = M.mix(mix_rows(spark, data), block=16).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.slot].append(r)
    assert all(len({r.source for r in rs}) == 1 and sum(r.length for r in rs) <= 16 for rs in slots.values())
    # the schedule interleaves: any stretch of slots holds each source about as often as its target says
    _, total, target = plain_mix([x[:3] for x in data])
    whole = sum(total.values())
    order = sorted(slots)
    for lo in range(0, len(order) - 500, 250):
        share = Counter(slots[s][0].source for s in order[lo:lo + 500])
        for s in target:
            assert abs(share[s] - 500 * target[s] / whole) < 12


def test_mix_of_nothing(spark):
    assert M.taken(mix_rows(spark, mix_data()).where("false")).collect() == []
    only = M.taken(mix_rows(spark, [(1, None, None, "x", 1, 1), (2, "a", " ", "x", 1, 1)])).collect()
    assert sorted(tuple(r) for r in only) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mix_plan_is_native(spark):
    plan = M.taken(mix_rows(spark, mix_data()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
