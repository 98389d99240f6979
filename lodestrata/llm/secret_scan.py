"""Secret scan: one deterministic automaton for all rules, one pass over the bytes.

Rule patterns (byte classes, groups, alternation, ``? * + {n} {n,}``) become one NFA; subset
construction over byte classes, with every rule's start added at every step, and partition
refinement give one minimal transition array. A batch of texts is laid end to end with a byte
that no rule accepts between them and cut into lanes at bytes that lead every state back to
the start, so all lanes step together and no match is cut. States in which a rule accepts are
rare; only there the match's start and longest end are settled with that rule's own automaton.

Defined cases: null and empty texts have no spans; texts of any length are scanned whole;
repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

ALL_BYTES = frozenset(range(256))


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str
    base: bool = False
    keep: str = ""  # a whole match stays only if it also matches this


_KEY = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
#: Lengths are checked on whole matches: counting them in the automaton would multiply its states.
#: Listed in the order in which spans with one start are reported. Base rules first.
RULES = (
    SecretRule("assign", _KEY + r"""["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+""", True, r"""[A-Za-z_]+["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{6,}"""),
    SecretRule("access", "AKIA[A-Z0-9]+", True, ".{20,}"),
    SecretRule("hex", "[0-9a-f]{24,}", True),
    SecretRule("forge_token", "gh[opsur]_[A-Za-z0-9]+", False, ".{40}"),
    SecretRule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", False, ".{15,}"),
    SecretRule("web_token", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", False, ".{40,}"),
    SecretRule("private_key", "-----BEGIN (RSA |DSA |EC |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
)


class _Nfa:
    """Fragments (start, end) of one growing automaton; ``moves[s]`` is (byte set, target)."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        at, frag = self._either(pattern, 0)
        if at != len(pattern):
            raise ValueError(f"cannot read {pattern!r} from {at}")
        return self.build(frag)

    # the parser gives a tree: ("set", bytes) | ("cat", [..]) | ("alt", [..]) | ("rep", x, least, most)
    def _either(self, p: str, at: int):
        options = []
        while True:
            items = []
            while at < len(p) and p[at] not in "|)":
                at, item = self._atom(p, at)
                while at < len(p) and p[at] in "?*+{":
                    if p[at] == "{":
                        m = re.compile(r"\{(\d+)(,?)\}").match(p, at)
                        if not m:
                            raise ValueError(f"cannot read {p!r} from {at}")
                        item, at = ("rep", item, int(m[1]), None if m[2] else int(m[1])), m.end()
                    else:
                        item, at = ("rep", item, int(p[at] == "+"), 1 if p[at] == "?" else None), at + 1
                items.append(item)
            options.append(("cat", items))
            if at == len(p) or p[at] == ")":
                return at, ("alt", options)
            at += 1

    def _atom(self, p: str, at: int):
        if p[at] == "(":
            at, inner = self._either(p, at + 1)
            return at + 1, inner
        if p[at] == "[":
            end = p.index("]", at + 1)
            chars, out, i = p[at + 1 : end], set(), 0
            while i < len(chars):
                if i + 2 < len(chars) and chars[i + 1] == "-":
                    out |= set(range(ord(chars[i]), ord(chars[i + 2]) + 1))
                    i += 3
                else:
                    out.add(ord(chars[i]))
                    i += 1
            return end + 1, ("set", frozenset(out))
        return at + 1, ("set", frozenset({ord(p[at])}))

    def build(self, x) -> tuple[int, int]:
        a, b = self.state(), self.state()
        if x[0] == "set":
            self.moves[a].append((x[1], b))
        elif x[0] == "cat":
            at = a
            for part in x[1]:
                s, e = self.build(part)
                self.free[at].append(s)
                at = e
            self.free[at].append(b)
        elif x[0] == "alt":
            for part in x[1]:
                s, e = self.build(part)
                self.free[a].append(s)
                self.free[e].append(b)
        else:
            _, inner, least, most = x
            at = a
            for _ in range(least):
                s, e = self.build(inner)
                self.free[at].append(s)
                at = e
            if most is None:
                s, e = self.build(inner)
                self.free[at] += [s, b]
                self.free[e] += [s, b]
            else:
                for _ in range(most - least):
                    s, e = self.build(inner)
                    self.free[at] += [s, b]
                    at = e
                self.free[at].append(b)
        return a, b

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += self.free[s]
        return frozenset(s for s in out if self.moves[s] or not self.free[s])


@dataclass
class Automaton:
    """``step[state * 256 + byte]``; state 0 is the start; ``accepts[state]`` has a bit per rule."""

    step: np.ndarray
    accepts: np.ndarray

    @property
    def n_states(self) -> int:
        return len(self.accepts)


def compile_rules(patterns: list[str], search: bool) -> Automaton:
    """Subset construction and minimisation. ``search``: a match may begin at any byte."""
    nfa = _Nfa()
    ends = [nfa.add(p) for p in patterns]
    sets = {m for moves in nfa.moves for m, _ in moves}
    signature = defaultdict(list)
    for b in range(256):
        signature[tuple(b in s for s in sets)].append(b)
    groups = list(signature.values())
    start = nfa.closed(s for s, _ in ends)
    again = start if search else frozenset()
    index, todo, rows = {start: 0}, [start], []
    moves = [[(b[0], nfa.closed([t])) for b in groups for chars, t in m if b[0] in chars] for m in nfa.moves]
    while todo:
        here, todo = todo, []
        for state in here:
            row = []
            reached = defaultdict(set, {})
            for s in state:
                for b, to in moves[s]:
                    reached[b] |= to
            for g in groups:
                to = again | reached[g[0]]
                if to not in index:
                    index[to] = len(index)
                    todo.append(to)
                row.append(index[to])
            rows.append(row)
    states = sorted(index, key=index.get)
    accepts = np.array([sum(1 << k for k, (_, e) in enumerate(ends) if e in s) for s in states])
    table = np.array(rows)
    # refinement: states stay together while they accept alike and lead to the same blocks
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    order = np.unique(block, return_index=True)[1]
    rename = np.empty(len(order), dtype=np.int64)
    rename[[block[0], *(b for b in range(len(order)) if b != block[0])]] = np.arange(len(order))
    small, small_accepts = np.zeros((len(order), len(groups)), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
    for b, s in enumerate(order):
        small[rename[b]], small_accepts[rename[b]] = rename[block[table[s]]], accepts[s]
    step = np.zeros((len(order), 256), dtype=np.uint16)
    for k, g in enumerate(groups):
        step[:, g] = small[:, [k]]
    return Automaton(step.ravel(), small_accepts)


class Scanner:
    """All rules at once. Spans are byte offsets in the text."""

    LANES, BLOCK = 4096, 8 << 20

    def __init__(self, rules: tuple[SecretRule, ...] = RULES):
        self.rules = rules
        self.all = compile_rules([r.pattern for r in rules], search=True)
        self.each = [compile_rules([r.pattern], search=False) for r in rules]
        self.keep = [re.compile(r.keep.encode()) if r.keep else None for r in rules]
        table = self.all.step.reshape(-1, 256)
        self.resets = (table == 0).all(axis=0)
        if not self.resets[0]:
            raise ValueError("a rule accepts byte 0, which parts the texts")
        self.lists = None

    def _states(self, buf: np.ndarray) -> np.ndarray:
        """The automaton's state after each byte of ``buf``, which ends in a reset byte."""
        n, step = len(buf), self.all.step
        out = np.zeros(n, dtype=np.uint16)
        marks = np.flatnonzero(self.resets[buf])
        cuts = np.unique(marks[np.searchsorted(marks, np.linspace(0, n - 1, min(self.LANES, n // 64 + 1) + 1)[1:-1].astype(np.int64))] + 1)
        starts = np.concatenate([[0], cuts[cuts < n]])
        length = np.diff(np.concatenate([starts, [n]]))
        order = np.argsort(-length, kind="stable")
        pos, left = starts[order], length[order]
        state, k = np.zeros(len(pos), dtype=np.int64), len(pos)
        for i in range(int(left[0])):
            while k and left[k - 1] <= i:
                k -= 1
            if k < 12:  # few long lanes are left: plain loops are faster for them
                break
            at = pos[:k]
            state[:k] = step[(state[:k] << 8) + buf[at]]
            out[at] = state[:k]
            at += 1
        else:
            return out
        self.lists = self.lists or [row.tolist() for row in step.reshape(-1, 256)]
        for lane in range(k):
            s, p, end, rows = int(state[lane]), int(pos[lane]), int(starts[order[lane]] + left[lane]), self.lists
            for q in range(p, end, 1 << 20):
                seen = []
                for b in buf[q : min(end, q + (1 << 20))].tobytes():
                    s = rows[s][b]
                    seen.append(s)
                out[q : q + len(seen)] = seen
        return out

    def _longest(self, k: int, data: bytes, at: int) -> int:
        """End of the longest match of rule k that begins at ``at``, or -1."""
        a, s, end = self.each[k], 0, -1
        step, accepts, dead = a.step, a.accepts, self._dead(k)
        for i in range(at, len(data)):
            s = int(step[(s << 8) + data[i]])
            if s == dead:
                break
            if accepts[s]:
                end = i + 1
        return end

    @lru_cache(maxsize=None)  # noqa: B019  a scanner lives as long as its worker
    def _dead(self, k: int) -> int:
        a = self.each[k]
        t = a.step.reshape(-1, 256)
        return next((s for s in range(a.n_states) if (t[s] == s).all() and not a.accepts[s]), -1)

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (rule, start, end): leftmost longest non-overlapping matches per rule."""
        out: list[list[tuple[int, int, int]]] = []
        block, size = [], 0
        for t in texts:
            block.append(t)
            size += len(t)
            if size >= self.BLOCK:
                out += self._scan_block(block)
                block, size = [], 0
        return out + self._scan_block(block) if block else out

    def _scan_block(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        buf = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        states = self._states(buf)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        hits = np.flatnonzero(self.all.accepts[states])
        if not len(hits):
            return found
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        masks, owner = self.all.accepts[states[hits]], np.searchsorted(bounds, hits, side="right") - 1
        for d in np.unique(owner):
            first = int(bounds[d])
            own = slice(*np.searchsorted(owner, [d, d + 1]))
            for k in range(len(self.rules)):
                ends = hits[own][(masks[own] >> k & 1).astype(bool)] - first
                i, done = 0, 0
                while i < len(ends):
                    e = int(ends[i])
                    lo = e
                    while lo > done and states[first + lo - 1]:
                        lo -= 1
                    for s in range(lo, e + 1):
                        if (end := self._longest(k, texts[d], s)) >= 0:
                            if not self.keep[k] or self.keep[k].fullmatch(texts[d], s, end):
                                found[d].append((k, s, end))
                            done = end
                            break
                    i = max(i + 1, int(np.searchsorted(ends, done)))
        for spans in found:
            spans.sort(key=lambda x: (x[1], x[0]))
        return found


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as spans of code points."""
    if not spans or data.isascii():
        return spans
    starts = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
    at = np.searchsorted(starts, [x for s in spans for x in s[1:]]).tolist()
    return [(k, at[2 * i], at[2 * i + 1]) for i, (k, _, _) in enumerate(spans)]


def scan_documents(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """doc_id and ``spans`` array<struct<kind, start, end, base>> (code points, end exclusive, by
    start, then kind as listed) for every row. The automaton is built once on the driver."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))  # its size depends on the rules only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner.value
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            spans = [[{"kind": rules[k].kind, "start": s, "end": e, "base": rules[k].base} for k, s, e in in_code_points(t, x)] for t, x in zip(texts, own.scan(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, type=SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def digest_columns(spans: DataFrame, kinds: list[str]) -> DataFrame:
    """doc_id, a count of base spans for each of ``kinds``, base_sha256, spans (as text)."""
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return spans.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


