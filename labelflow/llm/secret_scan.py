"""Secret scanning with one combined deterministic automaton.

The rules' patterns (bytes, ASCII) become one nondeterministic automaton; the
subset construction and a minimisation turn it into an array of transitions
over byte classes, with a bit set of rules per accepting state.  All rules are
scanned in one pass over the bytes.

The automaton is a filter: it tells which stretches of text hold a match of which
rule.  Some bytes lead from every state to the start state (a line break, a comma, any
non-ASCII byte): no match crosses them.  Texts are cut into lanes behind such
bytes and the lanes of a slice advance together, one byte a step, by array
lookups.  A lane in which a rule fires is then matched exactly by the rule's
base pattern, leftmost and non-overlapping, which gives the spans; a lane's
matches are the text's, since none crosses a lane's end.

Spans are code points, end exclusive.  Null and empty texts have none.  Texts
of any length are scanned whole; one without such bytes is a single lane.  Null
ids and repeated rows are kept, each row is scanned by itself; an empty table
gives an empty result.  ``scan`` reads no other columns, ``redact`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm import common as C


@dataclass(frozen=True)
class Rule:
    """``scan`` is what the automaton looks for: every match of ``base`` that
    counts holds one.  ``group`` of a base match needs ``least`` characters."""

    kind: str
    scan: str
    base: str
    group: int = 0
    least: int = 1
    basic: bool = False


# The base rules' patterns and lengths.
KEYWORD = "(password|passwd|secret|token|api_?key)"
VALUE = "[A-Za-z0-9+/_.=-]"
BETWEEN = r"""["']?\x20*[:=]\x20*["']?"""


def _either_case(pattern: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


RULES = (
    Rule("assign", f"{_either_case(KEYWORD)}{BETWEEN}{VALUE}{{8}}",
         f"{_either_case(KEYWORD)}{BETWEEN}({VALUE}+)", group=2, least=8, basic=True),
    Rule("access", "AKIA[A-Z0-9]{12}", "AKIA[A-Z0-9]+", least=16, basic=True),
    Rule("hex", "[0-9a-f]{32}", "[0-9a-f]+", least=32, basic=True),
    # public formats beyond the base rules
    Rule("github", "gh[opsu]_[A-Za-z0-9]", "gh[opsu]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)


class Nfa:
    """Thompson automaton over byte sets, built from Python's own pattern parser."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[list[tuple[np.ndarray, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append([])
        return len(self.empty) - 1

    def add(self, node, at: int) -> int:
        """Append one parsed element behind state ``at``; returns its end."""
        op, arg = node
        if op in (K.LITERAL, K.IN):
            to = self.state()
            self.step[at].append((self._bytes(node), to))
            return to
        if op is K.SUBPATTERN:
            return self.chain(arg[-1], at)
        if op is K.BRANCH:
            end = self.state()
            for option in arg[1]:
                self.empty[self.chain(option, at)].append(end)
            return end
        if op is K.MAX_REPEAT:
            low, high, body = arg
            for _ in range(low):
                at = self.chain(body, at)
            if high is K.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.empty[at].append(loop)
                self.empty[self.chain(body, loop)].append(loop)
                self.empty[loop].append(end)
                return end
            end = self.state()
            self.empty[at].append(end)
            for _ in range(high - low):
                at = self.chain(body, at)
                self.empty[at].append(end)
            return end
        raise ValueError(f"pattern element {op} is not supported")

    def chain(self, nodes, at: int) -> int:
        for node in nodes:
            at = self.add(node, at)
        return at

    @staticmethod
    def _bytes(node) -> np.ndarray:
        hit = np.zeros(256, bool)
        for op, arg in [node] if node[0] is K.LITERAL else node[1]:
            if op is K.LITERAL:
                hit[arg] = True
            elif op is K.RANGE:
                hit[arg[0]:arg[1] + 1] = True
            else:
                raise ValueError(f"character set element {op} is not supported")
        return hit

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Automaton:
    classes: np.ndarray       # byte -> class
    step: np.ndarray          # state * n_classes + class -> state * n_classes
    accept: np.ndarray        # state -> bit set of rules
    n_classes: int
    sync: np.ndarray          # byte leads from every state to the start


def compile_rules(patterns: list[str]) -> Automaton:
    """Search automaton of all patterns: after each byte, which ones end there."""
    nfa = Nfa()
    start = nfa.state()
    ends: dict[int, int] = {}
    for i, p in enumerate(patterns):
        first = nfa.state()
        nfa.empty[start].append(first)
        ends[nfa.chain(sre.parse(p), first)] = 1 << i
    sets = np.array([s for row in nfa.step for s, _ in row])
    _, classes = np.unique(sets, axis=1, return_inverse=True)
    classes = classes.ravel().astype(np.uint8)
    n = int(classes.max()) + 1
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(n)]
    moves = [[[t for s, t in row if s[b]] for b in sample] for row in nfa.step]
    begin = nfa.closure([start])
    known, order, rows = {begin: 0}, [begin], []
    for states in order:                                  # subset construction
        row = []
        for c in range(n):
            to = nfa.closure({start, *(t for s in states for t in moves[s][c])})
            if to not in known:
                known[to] = len(order)
                order.append(to)
            row.append(known[to])
        rows.append(row)
    table = np.array(rows)
    accept = np.array([sum(ends.get(s, 0) for s in states) for states in order], np.int64)
    part = np.unique(accept, return_inverse=True)[1].ravel()
    while True:                                           # refine until stable: minimal states
        key = np.column_stack([part, part[table]])
        new = np.unique(key, axis=0, return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    # start state first
    rename = np.full(part.max() + 1, -1)
    rename[part[0]] = 0
    others = [p for p in range(part.max() + 1) if p != part[0]]
    rename[others] = np.arange(1, len(others) + 1)
    part = rename[part]
    first = np.zeros(part.max() + 1, np.int64)
    first[part[::-1]] = np.arange(len(part))[::-1]
    small = part[table[first]]
    sync = (small == 0).all(axis=0)[classes]
    return Automaton(classes, (small * n).ravel().astype(np.int32), accept[first], n, sync)


LANE_BYTES = 256
FEW_LANES = 16


def lanes(a: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lane starts: every non-empty row, and behind a sync byte about every LANE_BYTES."""
    rows = np.unique(offsets[:-1][np.diff(offsets) > 0])
    safe = a.sync[data]
    safe[:-1] &= (data[1:] & 0xC0) != 0x80                # not inside a character
    sync = np.flatnonzero(safe)
    size = np.diff(np.append(rows, len(data)))
    many = size // LANE_BYTES
    goal = C.gather_spans(many, np.zeros(len(many), np.int64)) * LANE_BYTES + np.repeat(rows, many) + LANE_BYTES - 1
    at = np.searchsorted(sync, goal)
    cut = sync[at[at < len(sync)]] + 1
    start = np.unique(np.concatenate([rows, cut]))
    return start[start < len(data)]


def fired(a: Automaton, data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per lane, the bit set of rules that end somewhere in it."""
    size = np.diff(np.append(start, len(data)))
    order = np.argsort(-size, kind="stable")
    begin, size = start[order], size[order]
    state = np.zeros(len(order), np.int32)
    hit = np.zeros(len(order), np.int64)
    accept = np.repeat(a.accept, a.n_classes)
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
    t = 0
    while t < len(active) and active[t] >= FEW_LANES:
        m = active[t]
        state[:m] = a.step[state[:m] + a.classes[data[begin[:m] + t]]]
        hit[:m] |= accept[state[:m]]
        t += 1
    if t < len(active):                                   # a few long lanes: one after another
        step, flags = a.step.tolist(), accept.tolist()
        for i in range(active[t]):
            s, h = int(state[i]), int(hit[i])
            for c in a.classes[data[begin[i] + t:begin[i] + size[i]]].tolist():
                s = step[s + c]
                h |= flags[s]
            hit[i] = h
    out = np.zeros(len(order), np.int64)
    out[order] = hit
    return out


def find_spans(a: Automaton, rules, matchers, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple]]:
    """row -> [(start, rule number, end)] in code points, sorted."""
    start = lanes(a, data, offsets)
    hits = fired(a, data, start)
    found: dict[int, list[tuple]] = {}
    ends = np.append(start, len(data))
    chars, row_of = None, -1
    for i in np.flatnonzero(hits):
        lo, hi = int(start[i]), int(ends[i + 1])
        row = int(np.searchsorted(offsets, lo, "right")) - 1
        if row != row_of:                                 # code points before each byte of the row
            own = data[offsets[row]:offsets[row + 1]]
            chars, row_of = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)]), row
        base = int(chars[lo - offsets[row]])
        text = data[lo:hi].tobytes().decode()
        for n, rule in enumerate(rules):
            if hits[i] >> n & 1:
                for m in matchers[n].finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found.setdefault(row, []).append((base + m.start(), n, base + m.end()))
    return {r: sorted(s) for r, s in found.items()}


def _sent(docs: DataFrame, rules):
    """The automaton as plain data: workers may not have this package."""
    a = compile_rules([r.scan for r in rules])
    return docs.sparkSession.sparkContext.broadcast((a.classes, a.step, a.accept, a.n_classes, a.sync))


def _scan(docs: DataFrame, id_col: str, text_col: str, rules, schema_of, make) -> DataFrame:
    """mapInArrow over (id, text): ``make(batch part, texts, spans)`` builds the output."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    automaton = _sent(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, matchers = Automaton(*automaton.value), [re.compile(r.base) for r in rules]
        for b in batches:
            for lo, hi, data, off in C.text_slices(b.column(1)):
                yield make(b.column(0).slice(lo, hi - lo), find_spans(a, rules, matchers, data, off), hi - lo)
    return rows.mapInArrow(run, schema_of(rows.schema["id"].dataType))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: id and its spans array<struct<kind, start, end>>."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])
    kinds = [r.kind for r in rules]
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make(ids, found, n):
        rows = [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in found.get(i, ())] for i in range(n)]
        return pa.RecordBatch.from_arrays([ids, pa.array(rows, arrow)], ["id", "spans"])

    return _scan(docs, id_col, text_col, rules, lambda t: T.StructType(
        [T.StructField("id", t), T.StructField("spans", T.ArrayType(span))]), make)


def scan_digests(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, a count per basic kind, the digest of the basic spans, all spans as text."""
    basic = [i for i, r in enumerate(rules) if r.basic]
    kinds = [r.kind for r in rules]

    def listed(spans):
        return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)

    def make(ids, found, n):
        spans = [found.get(i, []) for i in range(n)]
        base = [[s for s in x if s[1] in basic] for x in spans]
        counts = [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in basic]
        sha = [hashlib.sha256(listed(x).encode()).hexdigest() for x in base]
        return pa.RecordBatch.from_arrays(
            [ids, *counts, pa.array(sha, pa.string()), pa.array([listed(x) for x in spans], pa.string())], names)

    names = ["doc_id", *(f"n_{kinds[k]}" for k in basic), "base_sha256", "spans"]
    return _scan(docs, "doc_id", "text", rules, lambda t: T.StructType(
        [T.StructField("doc_id", t), *(T.StructField(c, T.LongType()) for c in names[1:-2]),
         T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]), make)


def redact(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; all columns
    stay, and ``n_chars``, if there is one, counts the new text.  Overlapping spans
    are replaced as one, under the kind that starts first."""
    automaton = _sent(docs, rules)
    at = docs.columns.index(text_col)
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, matchers = Automaton(*automaton.value), [re.compile(r.base) for r in rules]
        for b in batches:
            for lo, hi, data, off in C.text_slices(b.column(at)):
                part = b.slice(lo, hi - lo)
                found = find_spans(a, rules, matchers, data, off)
                if not found:
                    yield part
                    continue
                texts, cols = part.column(at).to_pylist(), list(part.columns)
                sizes = cols[count].to_pylist() if count is not None else None
                for i, spans in found.items():
                    new, last = [], 0
                    for s, k, e in spans:
                        if s >= last:
                            new += [texts[i][last:s], f"[{rules[k].kind}]"]
                        last = max(last, e)
                    texts[i] = "".join(new) + texts[i][last:]
                    if sizes is not None:
                        sizes[i] = len(texts[i])
                cols[at] = pa.array(texts, cols[at].type)
                if sizes is not None:
                    cols[count] = pa.array(sizes, cols[count].type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)
    return docs.mapInArrow(run, docs.schema)


def q_op5(spark, sf_dir):
    return scan_digests(C.read(spark, sf_dir, "documents"))


QUERIES = {"op5_secret_scan": q_op5}
ORACLE_SQL: dict[str, str] = {}
