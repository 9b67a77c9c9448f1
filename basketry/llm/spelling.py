"""Spelling variants by dynamic programming over the sorted vocabulary.

Two words are near if one edit (an inserted, deleted or replaced code point)
makes one the other. The vocabulary is sorted, once forwards and once by its
reversed words, and cut into chunks of neighbouring words. An edit lies in
the first or the second half of a word, so the other half stands unchanged:
every word is looked up among the words that share its first half (forwards)
and among those that share its second half (reversed).

A look-up scans the range of the sorted list that shares the half, prefix by
prefix. It keeps the band of three cells of the edit matrix around the
diagonal; a row belongs to a prefix and is computed once for all words that
share it (adjacent words share their longest common prefix, LCP), and a range
whose shared prefix has no cell of at most one edit is skipped whole. All
look-ups of a chunk advance together, one code point at a time.

A chunk holds a bounded number of words, and the words looked up in it go
there in batches of bounded size: a half that a third of all words share is
many chunks and batches. A word goes only to the chunks whose range holds its
half and whose own shared prefix is within one edit of the word.

Words: maximal runs of ASCII letters and U+00C0 to U+00FF, A-Z lower-cased;
from one run in ``NOISE`` of a document (by a hash of document and run) one
code point is deleted. Words have at least ``MIN_LENGTH`` code points and
occur ``MIN_COUNT`` times. A word's form is its near word of the largest
count (ties: the smallest), if that is at least ``RATIO`` times its own;
its root is where following the forms ends.

Edge cases: null and empty texts have no words; the words of a document
without an id keep all their code points; repeated rows count again; an
empty table gives an empty result; further columns are not read. Texts and
words of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm.words import slices
from basketry.session import materialize

MIN_LENGTH, MIN_COUNT, RATIO, NOISE = 5, 3, 2, 97
#: Words of a chunk at least; there are at most MAX_CHUNKS chunks.
CHUNK, MAX_CHUNKS = 8192, 20_000
#: Words looked up in a chunk at a time, and (word, prefix) pairs in hand at a time.
BATCH, FRONTIER = 4096, 1 << 18
#: Code points of a chunk's first word and shared prefix that a route looks at.
ROUTED = 32
GATHERED = 200_000
MAX_ROUNDS = 64

_FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0xC0 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WIDE = re.compile("[^\\x00-\\xff]+")
BEYOND = "\U0010ffff"


# ---- words ------------------------------------------------------------------

def words_of(text: str, doc_id, min_length: int = MIN_LENGTH) -> Counter:
    """The words of a text, in Latin-1, and how often they occur."""
    runs = Counter(_WIDE.sub(" ", text).encode("latin-1").translate(_FOLD).split())
    out: Counter = Counter()
    start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        if len(run) < min_length:
            continue
        if start is not None:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % NOISE == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < min_length:
                    continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the words that occur often enough."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    found.update(words_of(text, doc_id, min_length))
                if len(found) > GATHERED:
                    yield passed()
        yield passed()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- the sorted list --------------------------------------------------------

def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points end to end, and where each word starts (one more at the end)."""
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), starts


def shared(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


class SortedList:
    """Sorted different words with what the scan needs: for each depth the
    borders between words whose LCP is that deep."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes, self.starts = _codes(words)
        self.lengths = np.diff(self.starts)
        lcp = np.array([shared(a, b) for a, b in zip(words, words[1:])], np.int64)
        order = np.argsort(lcp, kind="stable")
        self.border_at, self.border_depth = order + 1, lcp[order]

    def borders(self, depth: int) -> np.ndarray:
        """Positions at which a word and the one before share ``depth`` code points exactly."""
        a, b = np.searchsorted(self.border_depth, [depth, depth + 1])
        return self.border_at[a:b]

    def char(self, word: np.ndarray, depth: int) -> np.ndarray:
        """The code point at ``depth`` of words that are longer."""
        return self.codes[self.starts[word] + depth]

    def near(self, queries: list[str], kept: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, word) one edit apart that share the query's first
        ``kept`` code points, in parts. The queries are sorted by ``kept``."""
        q_codes, q_starts = _codes(queries)
        q_len = np.diff(q_starts)
        low = [bisect_left(self.words, q[:k]) for q, k in zip(queries, kept)]
        high = [bisect_left(self.words, q[:k] + BEYOND, lo=lo) for q, k, lo in zip(queries, kept, low)]

        def code(q: np.ndarray, j: np.ndarray) -> np.ndarray:
            """The query's code point j, or 0 beyond its ends."""
            inside = (j >= 0) & (j < q_len[q])
            return np.where(inside, q_codes[np.where(inside, q_starts[q] + j, 0)], 0)

        # Look-ups wait, by the depth of their shared half, until the scan is there.
        lows, highs, depths = (np.array(x, np.int64) for x in (low, high, kept))
        some = np.flatnonzero(lows < highs)
        for cut in range(0, len(some), 512):
            own = some[cut:cut + 512]
            stack = [(int(d), own[depths[own] == d], None) for d in np.unique(depths[own])[::-1]]
            stack = [(d, q, lows[q], highs[q], np.stack([np.ones_like(q), np.zeros_like(q), np.ones_like(q)])) for d, q, _ in stack]
            while stack:
                depth, q, lo, hi, band = stack.pop()
                # The word that ends here, if there is one, is the first of its range.
                ends = np.flatnonzero(self.lengths[lo] == depth)
                if len(ends):
                    off = q_len[q[ends]] - depth + 1
                    ok = (off >= 0) & (off <= 2)
                    cell = band[np.clip(off, 0, 2), ends]
                    hit = ends[ok & (cell == 1)]
                    if len(hit):
                        yield q[hit], lo[hit]
                    lo = lo.copy()
                    lo[ends] += 1
                live = lo < hi
                q, lo, hi, band = q[live], lo[live], hi[live], band[:, live]
                if not len(q):
                    continue
                # Ranges of the next code point: cut at borders of this depth.
                border = self.borders(depth)
                a, b = np.searchsorted(border, lo, side="right"), np.searchsorted(border, hi, side="left")
                parts = b - a + 1
                parent = np.repeat(np.arange(len(q)), parts)
                nth = np.arange(len(parent)) - np.repeat(np.cumsum(parts) - parts, parts)
                inner = np.concatenate([border, [0]])
                first = np.where(nth == 0, lo[parent], inner[np.minimum(a[parent] + nth - 1, len(border))])
                last = np.where(nth == parts[parent] - 1, hi[parent], inner[np.minimum(a[parent] + nth, len(border))])
                row, band = q[parent], band[:, parent]
                c = self.char(first, depth)
                before, on, after = (code(row, np.full_like(row, depth + k)) for k in (-1, 0, 1))
                left = np.minimum(band[0] + (before != c), band[1] + 1)
                left[depth > q_len[row]] = 2
                mid = np.minimum(np.minimum(band[1] + (on != c), band[2] + 1), left + 1)
                mid[depth + 1 > q_len[row]] = 2
                right = np.minimum(band[2] + (after != c), mid + 1)
                right[depth + 2 > q_len[row]] = 2
                new = np.minimum(np.stack([left, mid, right]), 2)
                keep = np.flatnonzero(new.min(axis=0) <= 1)
                for at in range(0, len(keep), FRONTIER):
                    k = keep[at:at + FRONTIER]
                    stack.append((depth + 1, row[k], first[k], last[k], new[:, k]))


def within_one(prefix: str, word: str, kept: int) -> bool:
    """Whether some word that starts with ``prefix`` may be one edit from
    ``word`` and share its first ``kept`` code points."""
    at = shared(prefix, word)
    if at == len(prefix):
        return True
    if at < kept:
        return at == len(word) and kept <= at
    rest = prefix[at + 1:]
    return (word[at + 1:at + 1 + len(rest)] == rest  # replaced
            or word[at:at + len(rest)] == rest  # inserted
            or word[at + 1:at + 2 + len(rest)] == prefix[at:])  # deleted


# ---- chunks and routes ------------------------------------------------------

def _chunks(words: DataFrame, size: int) -> DataFrame:
    """``first, prefix, words, counts``: neighbouring words of the sorted list."""
    total = words.count()
    parts = max(1, -(-total // (8 * size)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = [], []

        def chunk(n: int) -> pa.RecordBatch:
            own, own_n = held[:n], counts[:n]
            del held[:n], counts[:n]
            prefix = own[0][:min(ROUTED, shared(own[0], own[-1]))]
            return pa.RecordBatch.from_arrays([pa.array([own[0]]), pa.array([prefix]), pa.array([own], pa.list_(pa.string())), pa.array([own_n], pa.list_(pa.int64()))],
                                              ["first", "prefix", "words", "counts"])

        for batch in batches:
            held += batch.column(0).to_pylist()
            counts += batch.column(1).to_pylist()
            while len(held) >= size:
                yield chunk(size)
        if held:
            yield chunk(len(held))

    return words.repartitionByRange(parts, "key").sortWithinPartitions("key").select("key", "n").mapInArrow(work, "first string, prefix string, words array<string>, counts array<bigint>")


def _routes(words: DataFrame, chunks: list[tuple[str, str]], reverse: bool) -> DataFrame:
    """``chunk, query``: the chunks that each word is looked up in. ``chunks``
    has the (cut) first words and shared prefixes of the chunks, sorted."""
    firsts = [c[0] for c in chunks]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, row = [], []
            for r, w in enumerate(batch.column(0).to_pylist()):
                kept = len(w) - len(w) // 2 if reverse else len(w) // 2
                half = w[:min(kept, ROUTED)]
                a, b = max(0, bisect_left(firsts, half) - 1), bisect_right(firsts, half + BEYOND)
                for c in range(a, b):
                    if b - a < 3 or within_one(chunks[c][1], w, kept):
                        chunk.append(c)
                        row.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), batch.column(0).take(pa.array(row, pa.int64()))], ["chunk", "query"])

    return words.select("key").mapInArrow(work, "chunk int, query string")


def _near(words: DataFrame, reverse: bool, size: int) -> DataFrame:
    """``word, n_near, form, form_n`` for each word and chunk with near words:
    their number and the one of the largest count."""
    keyed = words.select(F.reverse("word").alias("key") if reverse else F.col("word").alias("key"), "n")
    name = "reversed" if reverse else "forwards"
    chunks = materialize(_chunks(keyed, size), f"spelling-{name}")
    cut = chunks.select(F.substring("first", 1, ROUTED).alias("cut"), "prefix", "first")
    # At most MAX_CHUNKS rows of bounded size, as a chunk grows with the vocabulary.
    table = sorted((r["cut"], r["prefix"], r["hash"]) for r in cut.select("cut", "prefix", F.xxhash64("first").alias("hash")).collect())
    routes = materialize(_routes(keyed, [(t[0], t[1]) for t in table], reverse), f"spelling-routes-{name}")
    sizes = {r["chunk"]: r["n"] for r in routes.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = words.sparkSession
    numbers = spark.createDataFrame([(i, t[2], -(-sizes.get(i, 0) // BATCH)) for i, t in enumerate(table)], "chunk int, hash bigint, batches int")
    spread = routes.join(F.broadcast(numbers.where("batches > 0")), "chunk").withColumn("batch", F.pmod(F.xxhash64("query"), F.col("batches")))
    batches = spread.groupBy("chunk", "hash", "batch").agg(F.collect_list("query").alias("queries"))
    both = batches.join(chunks.withColumn("hash", F.xxhash64("first")), "hash").select("queries", "words", "counts")

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in range(batch.num_rows):
                list_ = SortedList(batch.column(1)[r].as_py())
                counts = batch.column(2)[r].values.to_numpy()
                # Among equal counts the smallest word wins: its place among the words as they are read.
                plain = [w[::-1] for w in list_.words] if reverse else list_.words
                place = np.empty(len(plain), np.int64)
                place[sorted(range(len(plain)), key=plain.__getitem__)] = np.arange(len(plain))
                queries = batch.column(0)[r].as_py()
                kept = [len(q) - len(q) // 2 if reverse else len(q) // 2 for q in queries]
                pairs = list(list_.near(queries, kept))
                if not pairs:
                    continue
                q, w = (np.concatenate(x) for x in zip(*pairs))
                if reverse:  # what also shares the first half has been found forwards
                    new = np.fromiter((plain[b][:len(queries[a]) // 2] != queries[a][::-1][:len(queries[a]) // 2] for a, b in zip(q, w)), bool, len(q))
                    q, w = q[new], w[new]
                order = np.lexsort((place[w], -counts[w], q))
                q, w = q[order], w[order]
                first = np.flatnonzero(np.diff(q, prepend=-1))
                if not len(first):
                    continue
                n_near = np.diff(np.append(first, len(q)))
                word = [queries[i][::-1] if reverse else queries[i] for i in q[first]]
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n_near), pa.array([plain[i] for i in w[first]]), pa.array(counts[w[first]])],
                                                 ["word", "n_near", "form", "form_n"])

    return materialize(both.mapInArrow(work, "word string, n_near bigint, form string, form_n bigint"), f"spelling-near-{name}")


# ---- forms and roots --------------------------------------------------------

def near_words(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``word, n, n_near, best, best_n`` of every word of ``word, n``: how
    many near words it has, and the one of the largest count."""
    size = max(chunk, -(-words.count() // (MAX_CHUNKS // 2)))
    parts = _near(words, False, size).unionByName(_near(words, True, size))
    # The largest count, then the smallest word.
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("word")))
    found = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return (words.join(found, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every row of ``word, form``: where following the forms
    ends. Each round doubles the steps taken."""
    step = materialize(forms.select("word", F.col("form").alias("root")), "spelling-steps")
    for _ in range(MAX_ROUNDS):
        following = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = materialize(step.join(following, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-steps")
        step = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            return step
    raise RuntimeError("the forms did not end")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``."""
    words = materialize(vocabulary(docs, id_col, text_col), "spelling-words")
    known = materialize(near_words(words, chunk), "spelling-known")
    enough = F.col("best_n") >= RATIO * F.col("n")
    named = known.select("word", "n", "n_near", F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"))
    ends = roots(named.where(F.col("form").isNotNull()).select("word", "form"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
