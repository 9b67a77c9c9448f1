"""Token counts of a byte-level BPE tokenizer by compiled finite-state
transducers.

Two deterministic machines annotate transitions with emitted-token counts:

* The *splitter* cuts a text into pre-tokens. Whether a character starts a
  pre-token depends on four characters before and three after it only, so the
  machine is definite and its boundaries are computed for all positions at
  once with array operations.
* The *counter* reads the bytes of one pre-token. Its state after a prefix is
  what the rest can still change: the vocabulary prefixes that end here, with
  the token before each of them and that token's count relative to now. A
  transition emits the change of the token count. States are compiled when
  first met, as lazy regular-expression automata do, and kept per worker up
  to a bound.

A long text is cut into chunks. A chunk's *state map* takes any entering
counter state to a count and a leaving state: the bytes before the chunk's
first boundary (they continue the entering state), the count of what lies
between boundaries, and the state reached after the last boundary. Maps
compose associatively, and a logarithmic tree scan composes the chunks of a
text.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows
and repeated ids give one result row each; an empty table gives an empty
result; further columns of the input are not read, so their names cannot
clash. Texts of any length are read whole.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from basketry.llm.words import slices

CHUNK_CHARS = 1 << 16
#: Characters handled by one round of array operations.
ROUND_CHARS = 1 << 20
#: Compiled counter states kept by a worker before it starts afresh.
MAX_STATES = 300_000
#: Transitions kept for the byte-by-byte path.
RECENT = 50_000
#: Pre-tokens above this many bytes are stepped one by one.
LONG_BYTES = 96
NEVER = 1 << 30

#: Fixed values of the tokenizer's pattern: white space, and the suffixes
#: after an apostrophe that make a pre-token of their own.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_SUFFIXES = "stmd"
LONG_SUFFIXES = ("re", "ve", "ll")

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
BACK, AHEAD = 4, 3


# ---- compiling on the driver ------------------------------------------------

def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies spell bytes: printable
    Latin-1 characters stand for themselves, the rest for 256, 257, ..."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Merges as byte pairs, special strings, and letters or numbers that the
    library knows beyond this Python's Unicode tables."""
    import regex
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spell = byte_alphabet()
    raw = lambda s: bytes(spell[c] for c in s)
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    splitter = Tokenizer.from_file(path).pre_tokenizer
    unassigned = "".join(ch for ch in map(chr, range(0x110000)) if unicodedata.category(ch) == "Cn")
    newer: dict[int, int] = {}
    for ch in regex.findall(r"[\p{L}\p{N}]", unassigned):
        starts = {at[0] for _, at in splitter.pre_tokenize_str(f"a{ch}1")}
        if not {1, 2} <= starts:
            newer[ord(ch)] = NUMBER if 1 in starts else LETTER
    return {"merges": [(raw(a), raw(b)) for a, b in merges], "special": [t["content"] for t in spec.get("added_tokens", [])],
            "newer": newer}


# ---- the splitter -----------------------------------------------------------

def class_table(newer: dict[int, int]) -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for c, k in newer.items():
        table[c] = k
    table[WHITE_SPACE] = SPACE
    return table


def boundaries(cp: np.ndarray, first: np.ndarray, last: np.ndarray, table: np.ndarray) -> np.ndarray:
    """True where a pre-token starts. ``first``/``last`` flag the characters
    at the start/end of a text (no context beyond them)."""
    n = len(cp)
    cls = table[cp]
    space = cls == SPACE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = OTHER, cls[:-1]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = cp[:-1] == 32
    next_solid = np.zeros(n, bool)
    next_solid[:-1] = ~space[1:]
    next_solid &= ~last
    start = np.where(space, (before != SPACE) | next_solid, (before != cls) & ~blank_before)
    start |= first
    # A contraction: an apostrophe that starts a pre-token, with its suffix.
    for i in np.flatnonzero(start & (cp == 39)):
        end = i + 1
        while end < n and end < i + 3 and not last[end - 1]:
            end += 1
        tail = "".join(map(chr, cp[i + 1:end]))
        size = 2 if tail[:1] and tail[0] in SHORT_SUFFIXES else 3 if tail in LONG_SUFFIXES else 0
        if size:
            start[i + 1:i + size] = False
            if i + size < n and not last[i + size - 1]:
                start[i + size] = True
    return start


# ---- the counter ------------------------------------------------------------

class Counter:
    """Lazily compiled transducer over bytes: ``step(state, byte)`` gives the
    next state and the change of the token count."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
        self.parts: dict[int, tuple[int, int]] = {}
        ids = {t: i for i, t in enumerate(tokens)}
        self.pair = {}
        for r, (a, b) in enumerate(merges):
            self.pair[ids[a], ids[b]] = r
            self.parts[256 + r] = (ids[a], ids[b])
        # Trie of the vocabulary; node 0 is the empty string.
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.open = [True]
        for i, t in enumerate(tokens):
            node = 0
            for b in t:
                self.open[node] = True
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.open.append(False)
                node = nxt
            self.token[node] = i
        self.fits_known: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        # A state is its entries (trie node, token before it, that token's
        # count relative to now), packed as three 32-bit numbers each.
        start = array("i", (0, -1, 0)).tobytes()
        self.states = [start]
        self.number = {start: 0}
        self.keys = np.zeros(0, np.int64)  # state << 8 | byte, sorted
        self.goes = np.zeros(0, np.int32)
        self.adds = np.zeros(0, np.int8)
        self.recent: dict[int, tuple[int, int]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and its parts down one side, each with the rank of the
        merge that uses it up (NEVER for the token itself)."""
        out, used = [], NEVER
        while True:
            out.append((token, used))
            if token < 256:
                return out
            used, token = token - 256, self.parts[token][side]

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow ``a``: no merge joins a right-hand
        part of ``a`` with a left-hand part of ``b`` before either is used up
        inside its own token."""
        known = self.fits_known.get(a << 20 | b)
        if known is None:
            known = not any((r := self.pair.get((x, y), NEVER)) < ux and r <= uy
                            for x, ux in self._spine(a, 1) for y, uy in self._spine(b, 0))
            if len(self.fits_known) > MAX_STATES:
                self.fits_known.clear()
            self.fits_known[a << 20 | b] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte, compiled if it is new."""
        entries = array("i")
        entries.frombytes(self.states[state])
        moved, now = [], None
        for k in range(0, len(entries), 3):
            node = self.child.get(entries[k] << 8 | byte)
            if node is None:
                continue
            before, t = entries[k + 1], self.token[node]
            if now is None and t >= 0 and (before < 0 or self.fits(before, t)):
                now = (t, entries[k + 2] + 1)
            if self.open[node]:
                moved.append((node, before, entries[k + 2]))
        token, change = now
        packed = array("i")
        for node, before, ago in moved:
            packed.extend((node, before, ago - change))
        packed.extend((0, token, 0))
        key = packed.tobytes()
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        return number, change

    def run(self, data: bytes, state: int = 0) -> tuple[int, int]:
        """Leaving state and emitted count of a byte string."""
        count = 0
        for b in data:
            edge = self.recent.get(state << 8 | b)
            if edge is None:
                if len(self.recent) > RECENT:
                    self.recent.clear()
                edge = self.recent[state << 8 | b] = self.step(state, b)
            state, count = edge[0], count + edge[1]
        return state, count

    def _learn(self, missing: np.ndarray) -> None:
        new = np.unique(missing)
        out = [self.step(int(k) >> 8, int(k) & 255) for k in new]
        at = np.searchsorted(self.keys, new)
        self.keys = np.insert(self.keys, at, new)
        self.goes = np.insert(self.goes, at, [o[0] for o in out])
        self.adds = np.insert(self.adds, at, [o[1] for o in out])

    def counts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Token counts of many pre-tokens (byte ranges of ``data``), stepped
        together one byte at a time."""
        total = np.zeros(len(starts), np.int64)
        for i in np.flatnonzero(sizes > LONG_BYTES):
            total[i] = self.run(data[starts[i]:starts[i] + sizes[i]].tobytes())[1]
        order = np.argsort(-np.where(sizes > LONG_BYTES, 0, sizes), kind="stable")
        size = np.where(sizes > LONG_BYTES, 0, sizes)[order]
        at, state, count = starts[order], np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for j in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -j, side="left"))  # sizes above j
            keys = state[:live] << 8 | data[at[:live] + j]
            k = np.searchsorted(self.keys, keys)
            k[k == len(self.keys)] = 0
            unknown = np.ones(live, bool) if not len(self.keys) else self.keys[k] != keys
            if unknown.any():
                self._learn(keys[unknown])
                k = np.searchsorted(self.keys, keys)
            state[:live] = self.goes[k]
            count[:live] += self.adds[k]
        total[order] += count
        return total


# ---- chunk state maps -------------------------------------------------------

@dataclass
class StateMap:
    """What a chunk does to any entering counter state. ``head`` continues the
    entering state; if ``cut``, ``inner`` tokens lie between boundaries and
    the chunk leaves ``state`` after ``open`` tokens since its last boundary."""

    head: bytes
    cut: bool
    inner: int = 0
    state: int = 0
    open: int = 0


def compose(a: StateMap, b: StateMap, counter: Counter) -> StateMap:
    if not a.cut:
        return StateMap(a.head + b.head, b.cut, b.inner, b.state, b.open)
    state, more = counter.run(b.head, a.state)
    if not b.cut:
        return StateMap(a.head, True, a.inner, state, a.open + more)
    return StateMap(a.head, True, a.inner + a.open + more + b.inner, b.state, b.open)


def scan(maps: list[StateMap], counter: Counter) -> int:
    """Token count of a text from its chunks' maps, composed as a tree."""
    while len(maps) > 1:
        maps = [compose(maps[i], maps[i + 1], counter) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    m = maps[0]
    return counter.run(m.head)[1] + m.inner + m.open


class TokenCounter:
    def __init__(self, vocabulary: dict):
        self.table = class_table(vocabulary["newer"])
        self.counter = Counter(vocabulary["merges"])
        self.special = vocabulary["special"]

    def texts(self, texts: list[str], chunk: int = CHUNK_CHARS) -> np.ndarray:
        """Token counts of whole texts."""
        total = np.zeros(len(texts), np.int64)
        todo: list[tuple[int, str, int, int]] = []  # text, piece of it, from, to
        maps: list[StateMap] = []  # of the piece that is under way

        def settle() -> None:
            for (i, piece, _, hi), done in zip(todo, self._round(todo), strict=True):
                if isinstance(done, int):
                    total[i] += done
                    continue
                maps.append(done)
                if hi == len(piece):
                    total[i] += scan(maps, self.counter)
                    maps.clear()
            todo.clear()

        waiting = 0
        if len(self.counter.states) > MAX_STATES:  # no state is held between calls
            self.counter.reset()
        for i, text in enumerate(texts):
            pieces = [text]
            for s in self.special:
                pieces = [p for x in pieces for p in x.split(s)]
            total[i] += len(pieces) - 1  # every cut is one special token
            for piece in pieces:
                for lo in range(0, len(piece), chunk):
                    todo.append((i, piece, lo, min(len(piece), lo + chunk)))
                    waiting += todo[-1][3] - lo
                    if waiting >= ROUND_CHARS:
                        settle()
                        waiting = 0
        if todo:
            settle()
        return total

    def _round(self, todo: list[tuple[int, str, int, int]]) -> list:
        """For each chunk its token count, if it is a whole piece, or else its
        state map."""
        padded, core, first, last, at = [], [], [], [], 0
        for _, piece, lo, hi in todo:
            a, b = max(0, lo - BACK), min(len(piece), hi + AHEAD)
            padded.append(piece[a:b])
            core.append((at + lo - a, at + hi - a))
            if a == 0:
                first.append(at)
            if b == len(piece):
                last.append(at + b - a - 1)
            at += b - a
        text = "".join(padded)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(text.encode(), np.uint8)
        is_first, is_last, edge = np.zeros(at, bool), np.zeros(at, bool), np.zeros(at + 1, np.int8)
        is_first[first], is_last[last] = True, True
        for a, b in core:
            edge[a] += 1
            edge[b] -= 1
        start = boundaries(cp, is_first, is_last, self.table) & (np.cumsum(edge, dtype=np.int8)[:-1] > 0)
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(width)])
        # A pre-token reaches to the next boundary or to the end of its chunk.
        begin, stop = np.flatnonzero(start), np.array([b for _, b in core], np.int64)
        own = np.searchsorted(stop, begin, side="right")
        end = np.minimum(np.append(begin[1:], at), stop[own]) if len(begin) else begin
        counts = self._distinct(data, offset[begin], offset[end])
        sums = np.concatenate([[0], np.cumsum(counts)])
        cut = np.searchsorted(own, np.arange(len(todo) + 1))
        out: list = []
        for k, (_, piece, lo, hi) in enumerate(todo):
            a, b, (c0, c1) = cut[k], cut[k + 1], core[k]
            if hi - lo == len(piece):
                out.append(int(sums[b] - sums[a]))
            elif a == b:
                out.append(StateMap(data[offset[c0]:offset[c1]].tobytes(), False))
            else:
                state, n = self.counter.run(data[offset[begin[b - 1]]:offset[c1]].tobytes())
                out.append(StateMap(data[offset[c0]:offset[begin[a]]].tobytes(), True, int(sums[b - 1] - sums[a]), state, n))
        return out

    def _distinct(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Token counts of byte ranges; equal ones run through the counter once."""
        if not len(lo):
            return np.zeros(0, np.int64)
        if (hi[:-1] == lo[1:]).all():
            cuts = np.append(lo, hi[-1]).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        else:
            words = pa.array([data[x:y].tobytes() for x, y in zip(lo, hi)], pa.binary())
        coded = words.dictionary_encode()
        _, offsets, chars = coded.dictionary.buffers()
        bounds = np.frombuffer(offsets, np.int32)[:len(coded.dictionary) + 1].astype(np.int64)
        counts = self.counter.counts(np.frombuffer(chars, np.uint8), bounds[:-1], np.diff(bounds))
        return counts[coded.indices.to_numpy()]


_COUNTERS: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``path`` is the tokenizer's JSON file, read on the driver only; workers
    get its merges (bounded by the vocabulary) as a broadcast and compile the
    transducers once.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[path] = TokenCounter(vocabulary.value)
        for batch in slices(batches):
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n = _COUNTERS[path].texts([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n)], ["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(work, f"id {rows.schema[0].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
