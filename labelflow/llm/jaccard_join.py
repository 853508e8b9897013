"""Near-duplicate classes by an exact n-gram Jaccard join with PartEnum signatures.

A document's set holds the 64-bit hashes of its word shingles; documents with
equal sets are one node (copies are never expanded into pairs).  Equal means equal
in 128 bits: a node is known by a 64-bit key, and where sets with one key differ in
a second key, made from other hashes of the shingles, each goes by its second key.

Signatures.  Sets whose Jaccard similarity is at least p/100 differ in at most
k = (100 - p)(|a| + |b|) / (100 + p) shingles.  Sizes fall into bands; a set
signs for its own band and, if it may have partners in the next band, for that
one too, so two such sets always sign for a common band and its k.  Within a
band the shingle domain is partitioned by a hash into parts, some more than k / 2,
and each part into three cells; a signature is the content of two cells of a part
(small k: one part of k + 3 cells).  Where two sets differ in at most k shingles,
some part holds at most one of them, and two of its cells agree.
Any partner of a set of size s differs from it in at most d = min(k, (100 - p)s / p)
shingles, each in one cell: in a part with three filled cells the first of them
costs two pairs of filled cells, all others cost one pair at most.  What is left of
the filled pairs is the number of signatures that similar sets share at least.  So
empty cells, which would match any sparse set, are left out unless that is none, and
of every set the most frequent signatures, one fewer than that number, can go: the
rarest one that two similar sets share is among those of neither.

Candidates.  A task sorts the signatures of its slice of documents, links the
members of a signature to its first one, and ships only the first: a signature
that a third of all documents share leaves each slice once.  Packed blobs go by
signature range to groups of about ``GROUP_SIGNATURES``; a group links again.

Verification.  Each set has a parity sketch of two to four bits a shingle; two
sets differ in at least as many shingles as their sketches do in bits, so pairs
whose sketches differ in more than k bits are dropped without loss.  Sets are
rebuilt only for the pairs that remain.  Each node is first checked against its
most frequent partner, then against the others that are not in its class yet.
A signature whose members still belong to different classes is settled exactly:
its members are dealt into blocks, the sketches of all cross-class pairs of
blocks are compared (members of one class never with each other), and what
remains is verified.  Links are joined by distributed connected components.

Texts without a word are empty sets: linked with nothing.  Texts with fewer
words than ``n`` have one shingle, the whole sequence.  A row with a null id
has no part in links; its component is null unless an equal set has an id.  Rows
repeated with one id, with the same or another text, are rows each, in the class
of their own text.  A very long text is one slice; an empty table gives an empty
result; other columns are not read (``keep_one`` keeps them).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm import common as C
from labelflow.llm.components import components
from labelflow.operators.joins import bounded_broadcast

GROUP_SIGNATURES = 1_000_000
BLOCK_NODES = 512
BLOCK_SHINGLES = 8_000_000
PIVOT_NODES = 500
PART = 3           # cells of a part
SPARE = 3          # parts beyond k / 2, and a twelfth of k more
ONE_PART = 3       # up to this k all cells are one part
MAX_CLASHES = 1_000_000    # keys that several sets have: some n * n / 2**65 of n sets
BAND_BITS = 127    # these bits of a signature tell its band


# ---------------------------------------------------------------- sets

def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, other hash of the shingle), distinct and sorted by row and hash."""
    low = C.LOWER[data]
    start, end, row = C.words(low, offsets)
    word = C.span_hashes(low, start, end)
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # a row of m words has max(1, m - n + 1) shingles; missing words count as 0
    count = np.bincount(row, minlength=len(offsets) - 1)
    last = np.cumsum(count)[row] - 1
    i = np.arange(len(word))
    h, other = np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            w = np.where(i + j <= last, word[np.minimum(i + j, len(word) - 1)], np.uint64(j + 1))
            h = C.mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
            other = (other ^ (other >> np.uint64(29)) ^ w) * np.uint64(0xC2B2AE3D27D4EB4F)
    keep = (i + n - 1 <= last) | ((i == last - count[row] + 1) & (count[row] < n))
    row, h, other = row[keep], h[keep], other[keep]
    order = np.lexsort((h, row))
    row, h, other = row[order], h[order], other[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new], other[new]


def set_keys(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit key) of each row's set; the key of an empty set is 0."""
    size = np.bincount(row, minlength=rows)
    key = np.zeros(rows, np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        with np.errstate(over="ignore"):
            total = np.add.reduceat(C.mix(h ^ np.uint64(0xA5A5A5A5A5)), (np.cumsum(size) - size)[some])
            key[some] = C.mix(total + size[some].astype(np.uint64))
    return size, key


def node_keys(row: np.ndarray, h: np.ndarray, other: np.ndarray, rows: int, bits: int,
              clashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, node) of each row's set: its key of ``bits`` bits, or its second key where several sets have that one."""
    size, key = set_keys(row, h, rows)
    key >>= np.uint64(64 - bits)
    if len(clashes):
        hit = np.isin(key, clashes) & (size > 0)
        key = np.where(hit, set_keys(row, other, rows)[1], key)
    return size, key


def sketches(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> pa.Array:
    """Parity sketch of each row's set, a power of two of at least 64 bits and two bits a
    shingle: bit i tells whether an odd number of shingles hash to i.  A sketch's halves
    XORed are the sketch of half the width."""
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    base = np.cumsum(width) - width
    bit = (C.mix(h ^ np.uint64(0x5EED)) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(base[row] + bit, minlength=int(width.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8))
    ends = np.concatenate([[0], np.cumsum(width // 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(packed)])


def may_be_similar(na, a: np.ndarray, nb, b: np.ndarray, percent: int) -> np.ndarray:
    """Rows of sketches (uint8) of two widths, pairwise by broadcasting: False only if the sets can't be similar."""
    while a.shape[-1] > b.shape[-1]:
        a = a[..., :a.shape[-1] // 2] ^ a[..., a.shape[-1] // 2:]
    while b.shape[-1] > a.shape[-1]:
        b = b[..., :b.shape[-1] // 2] ^ b[..., b.shape[-1] // 2:]
    bits = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.int64)
    for i in range(0, a.shape[-1], 8):                      # one 64-bit word at a time
        x = np.ascontiguousarray(a[..., i:i + 8]).view(np.uint64)[..., 0]
        y = np.ascontiguousarray(b[..., i:i + 8]).view(np.uint64)[..., 0]
        bits += np.bitwise_count(x ^ y)
    return (bits * (100 + percent) <= (100 - percent) * (na + nb)) & (
        100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


# ---------------------------------------------------------------- signatures

def _bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(largest size, k) of the size bands; a band spans about percent**-3."""
    upper = [1]
    while upper[-1] < 1 << 40:
        u = upper[-1]
        upper.append(max(u + 1, u * 100 ** 3 // percent ** 3))
    upper = np.array(upper, np.int64)
    return upper, (100 - percent) * 2 * upper // (100 + percent)


def _cells(k: np.ndarray) -> np.ndarray:
    return np.where(k <= ONE_PART, k + 3, PART * ((k + 1) // 2 + SPARE + k // 12))


class _Band:
    """Cells of the sets that sign for one band each; the other sets have none."""

    def __init__(self, row: np.ndarray, h: np.ndarray, size: np.ndarray, band: np.ndarray, takes: np.ndarray,
                 percent: int):
        self.band = band
        self.k = _bands(percent)[1][band]
        self.takes = takes & (self.k > 0)
        self.m = np.where(self.takes, _cells(self.k), 0)
        self.base = np.cumsum(self.m) - self.m
        self.total = int(self.m.sum())
        use = self.takes[row]
        r = row[use]
        with np.errstate(over="ignore"):
            self.x = C.mix(h[use] ^ (band[r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        self.cell = self.base[r] + ((self.x >> np.uint64(32)) % self.m[r].astype(np.uint64)).astype(np.int64)
        self.filled = np.bincount(self.cell, minlength=self.total) > 0
        self.owner = np.repeat(np.arange(len(size)), self.m)
        fill = np.bincount(self.owner, self.filled, len(size)).astype(np.int64)
        differ = np.minimum(self.k, (100 - percent) * size // percent)
        # the parts of the sets with several: their owners, numbers and first cells
        parts = np.where(self.k > ONE_PART, self.m // PART, 0)
        self.part_owner = np.repeat(np.arange(len(size)), parts)
        self.part = C.gather_spans(parts, np.zeros(len(parts), np.int64))
        self.part_at = self.base[self.part_owner] + PART * self.part
        full = sum((self.filled[self.part_at + c] for c in range(PART)), np.zeros(len(self.part), np.int64))
        pairs = np.bincount(self.part_owner, full * (full - 1) // 2, len(size)).astype(np.int64)
        whole = np.bincount(self.part_owner, full == PART, len(size)).astype(np.int64)
        several = pairs - 2 * np.minimum(differ, whole) - np.maximum(0, differ - whole)
        agree = np.maximum(fill - differ, 0)
        # pairs of filled cells that agree with any similar set
        self.shared = np.where(self.k > ONE_PART, several, agree * (agree - 1) // 2)

    def least(self) -> np.ndarray:
        """Signatures a set shares at least with any similar one that signs for the band."""
        return np.maximum(1, self.shared)


def _own_and_next(row: np.ndarray, h: np.ndarray, rows: int, percent: int) -> tuple[_Band, _Band]:
    upper, _ = _bands(percent)
    size = np.bincount(row, minlength=rows)
    own = np.searchsorted(upper, size)
    both = percent * (upper[own] + 1) <= 100 * size
    return (_Band(row, h, size, own, size > 0, percent), _Band(row, h, size, own + 1, both & (size > 0), percent))


def signature_count(size: np.ndarray, percent: int) -> np.ndarray:
    """Upper bound of a set's signatures, to size the groups."""
    upper, k = _bands(percent)
    k = k[np.minimum(np.searchsorted(upper, size) + 1, len(k) - 1)]
    cells = _cells(k)
    return np.where(size == 0, 0, np.where(k == 0, 0, 2 * np.where(k <= ONE_PART, cells * (cells - 1) // 2, cells)))


def signatures(row: np.ndarray, h: np.ndarray, rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of sets given as distinct (row, shingle) sorted by row."""
    out_row, out_sig = [], []
    for b in _own_and_next(row, h, rows, percent):
        with np.errstate(over="ignore"):
            # the content of a cell: a sum of hashes, exact in two halves of 32 bits
            y = C.mix(b.x + np.uint64(1))
            low = np.bincount(b.cell, (y & np.uint64(0xFFFFFFFF)).astype(np.float64), b.total).astype(np.uint64)
            high = np.bincount(b.cell, (y >> np.uint64(32)).astype(np.float64), b.total).astype(np.uint64)
            content = C.mix(low * np.uint64(0xC2B2AE3D27D4EB4F) + high)
            tag = C.mix(b.band.astype(np.uint64))

            def put(who, first, second, number):
                """One pair of cells of each set in ``who``; ``number`` tells the pair among the set's."""
                ok = (b.filled[first] & b.filled[second]) | (b.shared[who] < 1)
                who, pair = who[ok], content[first[ok]] * np.uint64(3) + content[second[ok]]
                hashes = C.mix(pair ^ C.mix(tag[who] + number[ok].astype(np.uint64)))
                out_row.append(who)
                out_sig.append((hashes & np.uint64(~BAND_BITS & (1 << 64) - 1))
                               | (b.band[who].astype(np.uint64) & np.uint64(BAND_BITS)))

            for i, (c, d) in enumerate(itertools.combinations(range(PART), 2)):
                put(b.part_owner, b.part_at + c, b.part_at + d, PART * b.part + i)
            for kk in range(1, ONE_PART + 1):
                mine = np.flatnonzero(b.takes & (b.k == kk))
                for i, (c, d) in enumerate(itertools.combinations(range(kk + 3), 2)):
                    put(mine, b.base[mine] + c, b.base[mine] + d, np.full(len(mine), i))
    return np.concatenate(out_row), np.concatenate(out_sig)


def _meetings(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (signature, node): position of each signature's first member, and its other members."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[new], node[new]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(sig) else np.zeros(0, np.int64)
    return sig, node, first, head


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))


def set_table(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    """(id, n_shingles, node, other, n_sig, band, least, least_next, sketch) of every row; other is the second key."""
    rows = _texts(docs, id_col, text_col)
    schema = T.StructType([rows.schema["id"], T.StructField("n_shingles", T.LongType()),
                           T.StructField("node", T.LongType()), T.StructField("other", T.LongType()),
                           T.StructField("n_sig", T.LongType()),
                           T.StructField("band", T.LongType()), T.StructField("least", T.LongType()),
                           T.StructField("least_next", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in C.text_slices(b.column(1)):
                row, h, other = shingle_sets(data, off, n)
                size, key = node_keys(row, h, other, hi - lo, key_bits, ())
                second = set_keys(row, other, hi - lo)[1]
                own, after = _own_and_next(row, h, hi - lo, percent)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(key.view(np.int64)),
                     pa.array(second.view(np.int64)), pa.array(signature_count(size, percent), pa.int64()), pa.array(own.band & BAND_BITS, pa.int64()),
                     pa.array(own.least(), pa.int64()), pa.array(after.least(), pa.int64()),
                     sketches(row, h, size)], schema.names)
    return rows.mapInArrow(run, schema)


MEETING = ["sig", "node", "head"]


def meetings(docs: DataFrame, groups: int, n: int, percent: int, text_col: str, key_bits: int,
             clashes: np.ndarray) -> DataFrame:
    """(sig, node, head): nodes that share a signature with ``head``, the first one known of it."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in C.text_slices(b.column(0)):
                row, h, other = shingle_sets(data, off, n)
                _, key = node_keys(row, h, other, hi - lo, key_bits, clashes)
                at, sig = signatures(row, h, hi - lo, percent)
                sig, node, first, head = _meetings(sig, key[at])
                part = ((sig >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
                met = np.column_stack([sig, node, node[head]])[~first]
                lead, lead_part = np.column_stack([sig, node])[first], part[first]
                cuts, met_cuts = (np.searchsorted(x, np.arange(groups + 1)) for x in (lead_part, part[~first]))
                parts = [p for p in range(groups) if cuts[p] < cuts[p + 1]]
                blobs = [lead[cuts[p]:cuts[p + 1]].tobytes() for p in parts]
                mine = [met[met_cuts[p]:met_cuts[p + 1]].tobytes() for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts, pa.int32()), pa.array(blobs, pa.large_binary()).cast(pa.binary()),
                     pa.array(mine, pa.large_binary()).cast(pa.binary())], ["part", "lead", "met"])

    def link(t: pa.Table) -> pa.Table:
        lead = np.frombuffer(b"".join(t.column("lead").to_pylist()), np.uint64).reshape(-1, 2)
        met = np.frombuffer(b"".join(t.column("met").to_pylist()), np.uint64).reshape(-1, 3)
        sig, node, first, head = _meetings(lead[:, 0], lead[:, 1])
        new = np.column_stack([sig, node, node[head]])[~first]
        out = np.concatenate([met, new]).view(np.int64)
        return pa.table({c: pa.array(np.ascontiguousarray(out[:, i])) for i, c in enumerate(MEETING)})

    blobs = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(
        sign, "part int, lead binary, met binary")
    return blobs.groupBy("part").applyInArrow(link, "sig bigint, node bigint, head bigint")


def strong_meetings(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """Meetings over the signatures that similar sets can't do without, each under its smallest node."""
    member = met.select("sig", "node").unionByName(met.select("sig", F.col("head").alias("node"))).distinct()
    member = C.materialize(member, "signed")
    least = nodes.select("node", "band", "least", "least_next")
    counts = member.groupBy("sig").agg(F.count(F.lit(1)).alias("c"))
    ranked = (member.join(counts, "sig").join(least, "node")
              .withColumn("b", F.col("sig").bitwiseAND(F.lit(BAND_BITS).cast("long")))
              .withColumn("place", F.row_number().over(
                  Window.partitionBy("node", "b").orderBy(F.desc("c"), "sig"))))
    member = C.materialize(ranked.where("place >= IF(b = band, least, least_next)").select("sig", "node"), "strong")
    heads = (member.groupBy("sig").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("c"))
             .where("c > 1").select("sig", "head"))
    return member.join(heads, "sig").where("node <> head").select(*MEETING)


# ---------------------------------------------------------------- verification

def node_texts(docs: DataFrame, nodes: DataFrame, table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, t) of the nodes in ``nodes`` (node); texts are joined by id only, each once for all checks,
    and shuffled only where the ids are too many to broadcast."""
    ids = (table.where("id is not null").join(nodes, "node").groupBy("node").agg(F.min("id").alias("low"))
           .select("node", "low"))
    ids = bounded_broadcast(ids, beyond="shuffle_hash")
    return _texts(docs, id_col, text_col).join(ids, F.col("id") == F.col("low")).select("node", "t")


def node_sets(texts: DataFrame, wanted: DataFrame, n: int, key_bits: int, clashes: np.ndarray) -> DataFrame:
    """(node, s array<long>) of the nodes in ``wanted`` (node)."""
    rows = texts.join(wanted, "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column(0).to_numpy()
            for lo, hi, data, off in C.text_slices(b.column(1)):
                row, h, other = shingle_sets(data, off, n)
                size, key = node_keys(row, h, other, hi - lo, key_bits, clashes)
                ok = key.view(np.int64) == want[lo:hi]      # an id may be repeated with another text
                keep = ok[row]
                at = np.concatenate([[0], np.cumsum(size[ok])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)[ok]),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h[keep].view(np.int64)))], ["node", "s"])
    return rows.mapInArrow(run, "node bigint, s array<bigint>").dropDuplicates(["node"])


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the distinct pairs (node, head) that are similar; at most PIVOT_NODES nodes meet a head at once."""
    salts = (pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / F.lit(PIVOT_NODES)).cast("int").alias("salts")))
    sided = pairs.join(salts, "head").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    left = sided.select("head", "salt", "node").join(sets, "node")
    right = (salts.select(F.col("head").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
             .join(sets, "node").select(F.col("node").alias("head"), "salt", F.col("s").alias("hs")))

    def check(nodes: pa.Table, head: pa.Table) -> pa.Table:
        u, v = [], []
        if len(head):
            base, name = head.column("hs")[0].values.to_numpy(), head.column("head")[0].as_py()
            for node, s in zip(nodes.column("node").to_pylist(), nodes.column("s")):
                if _similar(s.values.to_numpy(), base, percent):
                    u.append(node)
                    v.append(name)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return (left.groupBy("head", "salt").cogroup(right.groupBy("head", "salt"))
            .applyInArrow(check, "u bigint, v bigint"))


def _widths(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """width in bytes -> (row numbers, sketches of those rows)."""
    raw = column.to_pylist()
    size = np.array([len(x) for x in raw], np.int64)
    return {int(w): (at, np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), -1))
            for w in np.unique(size) for at in [np.flatnonzero(size == w)]}


def block_pairs(a: pa.Table, b: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` of different classes that may be similar, by their sketches."""
    na, nb = a.column("n_shingles").to_numpy(), b.column("n_shingles").to_numpy()
    la, lb = a.column("label").to_numpy(), b.column("label").to_numpy()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    other = _widths(b.column("sketch"))
    for w, (ia, sa) in _widths(a.column("sketch")).items():
        for v, (ib, sb) in other.items():
            # similar sizes have sketches of the same width or one step apart, more below 50 %
            if max(w, v) * percent <= 200 * min(w, v):
                ok = may_be_similar(na[ia][:, None], sa[:, None, :], nb[ib][None, :], sb[None, :, :], percent)
                i, j = np.nonzero(ok & (la[ia][:, None] != lb[ib][None, :]))
                left.append(ia[i])
                right.append(ib[j])
    return np.concatenate(left), np.concatenate(right)


def sketched(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (node, head, ...) whose sketches allow them to be similar."""
    def ends(name):
        return sketch.select(F.col("node").alias(name), F.col("n_shingles").alias(f"{name} n"),
                             F.col("sketch").alias(f"{name} sketch"))

    keep = pairs.columns
    both = pairs.join(ends("node"), "node").join(ends("head"), "head").select(
        *keep, "`node n`", "`node sketch`", "`head n`", "`head sketch`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(len(keep)).to_numpy(), b.column(len(keep) + 2).to_numpy()
            one, two = (_widths(b.column(len(keep) + i)) for i in (1, 3))
            ok = np.zeros(len(b), bool)
            for ia, sa in one.values():
                for ib, sb in two.values():
                    at, x, y = np.intersect1d(ia, ib, assume_unique=True, return_indices=True)
                    for lo in range(0, len(at), 1024):
                        i, p, q = at[lo:lo + 1024], x[lo:lo + 1024], y[lo:lo + 1024]
                        ok[i] = may_be_similar(na[i], sa[p], nb[i], sb[q], percent)
            yield b.select(keep).filter(pa.array(ok))
    return both.mapInArrow(run, pairs.schema)


def open_pairs(met: DataFrame, labels: DataFrame, sketch: DataFrame, percent: int) -> DataFrame | None:
    """(node, head) of different classes that may be similar, among the members of
    signatures that hold several classes; None if there is no such signature."""
    def labelled(df, node, name):
        own = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        return (df.join(own, df[node] == own["_n"], "left")
                .withColumn(name, F.coalesce("_l", node)).drop("_n", "_l"))

    both = labelled(labelled(met, "node", "ln"), "head", "lh")
    # with a single meeting both members have been compared already
    open_sigs = (both.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.max((F.col("ln") != F.col("lh")).cast("int")).alias("d"))
                 .where("c > 1 and d = 1").select("sig"))
    rows = C.materialize(both.join(open_sigs, "sig").select("node", "head", "ln", "lh").distinct(), "open")
    if rows.isEmpty():
        return None
    group = components(rows.select(F.col("ln").alias("u"), F.col("lh").alias("v")), "open_groups")
    member = (rows.select("node", F.col("ln").alias("label"))
              .unionByName(rows.select(F.col("head").alias("node"), F.col("lh").alias("label"))).distinct())
    member = C.materialize(
        member.join(group.select(F.col("node").alias("label"), F.col("label").alias("g")), "label")
        .join(sketch.select("node", "n_shingles"), "node").select("g", "label", "node", "n_shingles"), "members")
    sizes = member.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("w"))
    top = sizes.groupBy("g").agg(F.max(F.struct("c", "label")).getField("label").alias("main"),
                                 F.sum("c").alias("all_c"), F.sum("w").alias("all_w"))
    rest = (sizes.join(top, "g").where("label <> main").groupBy("g")
            .agg(F.sum("c").alias("rest_c"), F.sum("w").alias("rest_w")))

    def chunks(c, w):
        return F.greatest(F.ceil(F.col(c) / F.lit(BLOCK_NODES)), F.ceil(F.col(w) / F.lit(BLOCK_SHINGLES))).cast("int")

    plan = (top.join(rest, "g").withColumn("rows", chunks("rest_c", "rest_w"))
            .withColumn("cols", chunks("all_c", "all_w")).select("g", "main", "rows", "cols"))
    placed = (member.join(plan, "g").withColumn("r", F.pmod(F.xxhash64("node"), F.col("rows")).cast("int"))
              .withColumn("c", F.pmod(F.xxhash64("node", F.lit(1)), F.col("cols")).cast("int")))

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def side(df):                # columns of its own for each side of the cogroup
        return df.join(sketch, "node").select(
            *[F.col(x).alias(x) for x in ("g", "r", "c", "label", "node", "n_shingles", "sketch")])

    left = side(placed.where("label <> main").select("g", "r", every("cols").alias("c"), "label", "node"))
    right = side(placed.select("g", every("rows").alias("r"), "c", "label", "node"))

    def check(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j = block_pairs(a, b, percent) if len(a) and len(b) else (np.zeros(0, np.int64),) * 2
        u, v = a.column("node").to_numpy()[i], b.column("node").to_numpy()[j]
        return pa.table({"node": pa.array(np.maximum(u, v), pa.int64()), "head": pa.array(np.minimum(u, v), pa.int64())})

    return (left.groupBy("g", "r", "c").cogroup(right.groupBy("g", "r", "c"))
            .applyInArrow(check, "node bigint, head bigint").distinct())


# ---------------------------------------------------------------- the join

def node_table(table: DataFrame) -> DataFrame:
    """One written row per node with shingles; ``other`` and ``other_high`` differ if several sets have its key."""
    return C.materialize(table.where("n_shingles > 0").groupBy("node").agg(
        F.min("id").alias("low"), F.min("other").alias("other"), F.max("other").alias("other_high"),
        *[F.min(c).alias(c) for c in ("band", "least", "least_next")]), "nodes")


def told_apart(table: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """``table`` and ``nodes`` with sets that share a key under their second key, and the shared keys."""
    shared = nodes.where("other < other_high").select("node").limit(MAX_CLASHES + 1)
    clashes = np.array([r[0] for r in shared.collect()], np.int64)
    if len(clashes) > MAX_CLASHES:
        raise ValueError(f"more than {MAX_CLASHES} set keys are shared")
    if len(clashes):
        hit = table.sparkSession.createDataFrame([(int(c),) for c in clashes], "shared_key long")
        second = F.col("shared_key").isNotNull() & (F.col("n_shingles") > 0)
        table = C.materialize(
            table.join(F.broadcast(hit), F.col("node") == F.col("shared_key"), "left")
            .withColumn("node", F.when(second, F.col("other")).otherwise(F.col("node"))).drop("shared_key"), "sets")
        nodes = node_table(table)
    return table, nodes, clashes.view(np.uint64)


def classes(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text",
            key_bits: int = 64) -> DataFrame:
    """(id, n_shingles, node, component) of every row; component is the smallest id linked, its own at least.

    ``key_bits`` of a node's first key are used: results do not depend on them, fewer let tests see shared keys."""
    if not 0 < percent <= 100:
        raise ValueError("percent lies in 1..100")
    table = C.materialize(set_table(docs, n, percent, id_col, text_col, key_bits), "sets")
    table, nodes, clashes = told_apart(table, node_table(table))
    total = table.agg(F.sum("n_sig")).first()[0] or 0
    groups = max(C.partitions(docs.sparkSession), math.ceil(total / GROUP_SIGNATURES))
    met = C.materialize(meetings(docs, groups, n, percent, text_col, key_bits, clashes), "met")
    met = C.materialize(strong_meetings(met, nodes), "meetings")
    labels = None
    if not met.isEmpty():
        met_nodes = met.select("node").unionByName(met.select(F.col("head").alias("node"))).distinct()
        sketch = C.materialize(table.join(met_nodes, "node").dropDuplicates(["node"])
                               .select("node", "n_shingles", "sketch"), "sketches")
        texts = C.materialize(node_texts(docs, met_nodes, table, id_col, text_col), "texts")
        votes = met.groupBy("node", "head").agg(F.count(F.lit(1)).alias("n"))
        votes = C.materialize(sketched(votes, sketch, percent), "votes")

        def check(pairs):
            """Similar pairs among distinct (node, head); sets are built for their nodes only."""
            wanted = pairs.select("node").unionByName(pairs.select(F.col("head").alias("node"))).distinct()
            return verify(pairs, C.materialize(node_sets(texts, wanted, n, key_bits, clashes), "node_sets"), percent)

        best = votes.groupBy("node").agg(F.max_by("head", F.struct("n", "head")).alias("head"))
        def joined(links):
            """Classes after new links (u, v): a star for each old class, and the links."""
            stars = labels.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
            return components(stars.unionByName(links))

        labels = components(check(best))
        own = labels.select(F.col("node").alias("x"), F.col("label").alias("lx"))
        oth = labels.select(F.col("node").alias("y"), F.col("label").alias("ly"))
        others = C.materialize(
            votes.join(best, ["node", "head"], "left_anti")
            .join(own, F.col("node") == F.col("x"), "left").join(oth, F.col("head") == F.col("y"), "left")
            .where(F.coalesce("lx", "node") != F.coalesce("ly", "head")).select("node", "head"), "other_pairs")
        if not others.isEmpty():
            labels = joined(check(others))
        more = open_pairs(met, labels, sketch, percent)
        if more is not None:
            more = C.materialize(more, "open_pairs")
            if not more.isEmpty():
                labels = joined(check(more))
    if labels is None:
        out = nodes.select("node", F.col("low").alias("component"))
    else:
        known = nodes.select("node", "low").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = known.groupBy("label").agg(F.min("low").alias("component"))
        out = known.join(least, "label").select("node", "component")
    empty = table.where("n_shingles = 0").select("id", "n_shingles", "node", F.col("id").alias("component"))
    return table.where("n_shingles > 0").join(out, "node").select("id", "n_shingles", "node", "component").unionByName(empty)


def q_op7(spark, sf_dir):
    found = classes(C.read(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but those in the class of a smaller id; all columns stay.

    Rows with a null id stay.  Rows repeated with the smallest id of a class all
    stay (exact dedup removes them before).
    """
    found = classes(docs, n, percent, id_col, text_col)
    drop = found.where("component < id").select(F.col("id").alias("dropped id")).distinct()
    drop = bounded_broadcast(drop, beyond="shuffle_hash")
    return docs.join(drop, docs[id_col] == drop["dropped id"], "left_anti")


QUERIES = {"op7_partenum_jaccard": q_op7}
ORACLE_SQL: dict[str, str] = {}
