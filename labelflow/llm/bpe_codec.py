"""Byte-level BPE by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be merged
across, so a text may be cut there before encoding.  The pre-tokenizer must
agree as well: only such pairs are used where its pattern always ends a match
(an ASCII letter before a non-letter, a digit before a non-digit, punctuation
other than an apostrophe before a letter, digit or blank, and a two-byte Latin
letter before an ASCII non-letter).  The left fragment then never ends in a
blank, so the look-ahead of the pattern sees the same.  Special tokens found
in a text are fragments of their own.

Fragments repeat a lot: a slice of the batch is cut with array operations, its
distinct fragments are encoded once, and the ids are gathered back.  Fragments
of ASCII and two-byte Latin letters go through the faster of two encoders over
the same vocabulary; all others (other scripts, very long ones) through the
tokenizer the file describes.  Decoding concatenates the tokens' bytes.

What this rests on is compared with the file: each merge's token must have a
larger id than the one before (ids then serve as ranks), and normaliser,
pre-tokenizer and model options must be the plain byte-level ones.  A byte-level
file that differs is not cut: its rows go whole through the described tokenizer.
Other kinds of vocabulary are refused.

Null texts are empty and encode to no id.  Null and repeated ids are kept, each
row is encoded by itself.  A very long text is one slice.  An empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm import common as C

CACHE_FRAGMENTS = 200_000
CACHE_BYTES = 48          # longer fragments rarely repeat and are not kept
LONG_BYTES = 400          # longer fragments are left to the described tokenizer

# Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# bytes a fragment for the fast encoder consists of: ASCII and U+00C0 to U+00FF
LATIN = re.compile(rb"(?:[\x00-\x7f]|\xc3[\x80-\xbf])*")


def byte_chars() -> dict[str, int]:
    """The characters that stand for the 256 bytes in byte-level vocabularies:
    printable Latin-1 for itself, the others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def safe_pairs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cut between a and b; cut between a Latin letter ending in a and b), 256 x 256 each."""
    code = np.arange(256)
    letter = ((code | 32) >= 97) & ((code | 32) <= 122) & (code < 128)
    digit = (code >= 48) & (code <= 57)
    blank = C.SEPARATOR
    ascii_ = code < 128
    punct = ascii_ & (code > 32) & (code < 127) & ~letter & ~digit & (code != 39)
    pair = (letter[:, None] & (ascii_ & ~letter)[None, :]
            | digit[:, None] & (ascii_ & ~digit)[None, :]
            | punct[:, None] & (letter | digit | blank)[None, :])
    trail = (code >= 0x80) & (code < 0xC0) & (code != 0x97) & (code != 0xB7)
    latin = trail[:, None] & (ascii_ & ~letter)[None, :]
    return pair & ~inside, latin & ~inside


def plain_byte_level(spec: dict, merges: list[str]) -> bool:
    """Whether ids follow the order of the merges and nothing but the plain byte-level options is set."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    ids = np.array([model["vocab"][m] for m in merges], np.int64)
    return (bool((np.diff(ids) > 0).all()) and not spec.get("normalizer")
            and before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True)
            and before.get("use_regex", True)
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix",
                                               "end_of_word_suffix")))


class Codec:
    """Encoder and decoder over one vocabulary; lives in a task."""

    def __init__(self, tokenizer_json: str):
        import tiktoken

        self.described = None
        self.source = tokenizer_json
        spec = json.loads(tokenizer_json)
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        chars = byte_chars()
        special = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        vocab = {i: t for t, i in spec["model"]["vocab"].items()} | special
        size = max(vocab) + 1
        tokens = [b""] * size
        for i, t in vocab.items():
            tokens[i] = t.encode() if i in special else bytes(map(chars.__getitem__, t))
        plain = [t for i, t in enumerate(tokens) if i not in special]
        joined = np.frombuffer(b"".join(plain), np.uint8)
        within = np.ones(len(joined), bool)                   # not the first byte of a token
        first = np.cumsum([0, *map(len, plain)])[:-1]
        within[first[first < len(joined)]] = False
        inside = np.zeros((256, 256), bool)
        at = np.flatnonzero(within)
        inside[joined[at - 1], joined[at]] = True
        ranks = {t: i for i, t in enumerate(tokens) if t and i not in special}
        if len(ranks) != len(merges) + 256:
            raise ValueError("not a byte-level vocabulary of 256 bytes and one token per merge")
        self.cuttable = plain_byte_level(spec, merges)
        self.fast = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {t.encode(): i for i, t in special.items()}
        self.pair, self.latin = (m.ravel() for m in safe_pairs(inside))
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[bytes, list[int]] = {}

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Start positions of the fragments; every row starts one."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1 and self.cuttable:
            two = (data[:-1].astype(np.uint16) << 8) | data[1:]
            cut[1:-1] = self.pair[two]
            if len(data) > 2:
                cut[2:-1] |= (data[:-2] == 0xC3) & self.latin[two[1:]]
            raw = data.tobytes()
            for s in self.special:
                at = raw.find(s)
                while at >= 0:
                    # a match across two rows is none
                    if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(s) - 1, "right"):
                        cut[at + 1:at + len(s)] = False
                        cut[[at, at + len(s)]] = True
                        at = raw.find(s, at + len(s))
                    else:
                        at = raw.find(s, at + 1)
        cut[offsets] = True
        cut[len(data)] = False
        return np.flatnonzero(cut)

    def _described(self, fragments: list[bytes]) -> list[list[int]]:
        if self.described is None:
            from tokenizers import Tokenizer

            self.described = Tokenizer.from_str(self.source)
            self.described.no_truncation()
            self.described.no_padding()
        return [self.described.encode(f.decode(), add_special_tokens=False).ids for f in fragments]

    def _encode_fragment(self, f: bytes) -> list[int]:
        if f in self.special and self.cuttable:
            return [self.special[f]]
        if self.cuttable and len(f) <= LONG_BYTES and (f.isascii() or LATIN.fullmatch(f)):
            return self.fast.encode_ordinary(f.decode())
        return self._described([f])[0]

    def _fragment_ids(self, fragments: list[bytes]) -> list[list[int]]:
        cache, out = self.cache, []
        if len(cache) > CACHE_FRAGMENTS:
            cache.clear()
        for f in fragments:
            ids = cache.get(f)
            if ids is None:
                ids = self._encode_fragment(f)
                if len(f) <= CACHE_BYTES:
                    cache[f] = ids
            out.append(ids)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of the rows in them)."""
        start = self.cuts(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = np.append(start, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        ids = self._fragment_ids(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum()))
        at = np.cumsum(size) - size
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        return flat[C.gather_spans(n, at[code])], ends[np.searchsorted(start, offsets, "left")]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[C.gather_spans(self.token_len[ids], self.token_at[ids])].tobytes()


def load(spark: SparkSession, path: str):
    """Broadcast of the tokenizer file's text (one vocabulary: a few MB).

    Only the driver opens the file; tasks build their codec from the text.
    """
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string): the operator's own output."""
    text = load(docs.sparkSession, path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(text.value)
        for b in batches:
            for lo, hi, data, off in C.text_slices(b.column(1)):
                ids, at = codec.encode(data, off)
                back = [codec.decode(ids[at[i]:at[i + 1]]).decode("utf-8", "replace") for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))),
                     pa.array(back, pa.string())], ["id", "ids", "decoded"])
    return rows.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), digested where the ids are made."""
    text = load(docs.sparkSession, path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(text.value)
        decimal = [b"%d" % i for i in range(len(codec.token_len))]
        for b in batches:
            for lo, hi, data, off in C.text_slices(b.column(1)):
                ids, at = codec.encode(data, off)
                listed, sha, back = ids.tolist(), [], []
                for i in range(hi - lo):
                    own = b",".join([decimal[x] for x in listed[at[i]:at[i + 1]]])
                    sha.append(hashlib.sha256(own).hexdigest())
                    whole = codec.decode(ids[at[i]:at[i + 1]]).decode("utf-8", "replace").encode()
                    back.append(hashlib.sha256(whole).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(sha, pa.string()),
                     pa.array(back, pa.string())], schema.names)
    return rows.mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def q_op9(spark, sf_dir):
    return encode_digests(C.read(spark, sf_dir, "documents"), default_path())


QUERIES = {"op9_bpe_codec": q_op9}
ORACLE_SQL: dict[str, str] = {}
