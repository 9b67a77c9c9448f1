"""Ranked lexical search over bit-sliced Bloom signatures.

Terms are maximal runs of digits, ASCII letters and anything beyond ASCII,
with A-Z lower-cased. A document scores, summed over an item's terms with
repeats, ``w * ((10^9 tf) div (1000 tf + 12 m))`` with the term's weight
``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and the document's length
factor ``m = 75 + (25 n N) div L``, in 64-bit integers.

Index: documents stand in blocks, and each block is a matrix of bits with one
column per document and one row (slice) per position of a Bloom signature. A
document sets the positions of every entry (term, level); it has an entry for
each level of ``LEVELS`` that the term's count reaches. The width of a block
fits its documents' entries. Exact document frequencies and document lengths
are kept beside the slices.

Search: the slices of a term's entries, and-ed, give the rows that may hold
the term that often; they hold every row that does, and a few more. The
weight times the greatest score that the level allows, summed over an item's
terms, is an upper bound on each document's score. The ``SEEDS`` documents of
the highest bounds are scored exactly; the k-th of their scores is a
threshold, and all documents whose bound reaches it are scored exactly from
their whole texts. All others are provably not among the k best.

Items go over the index in blocks of at most ``BLOCK_TERMS`` different terms
(one item, if it alone has more). Texts that need an exact score are found by
a join; a bitmap of fixed size lets only texts near it into the shuffle.

Edge cases: null and empty texts, and those without a term, are not counted
and never found; null ids take part, ordered last; repeated rows of the
documents each take a place; repeated rows of the items (same id and text)
are one item, rows of one id with different texts are items of their own; an
item without known terms has no result; empty tables give an empty result;
further columns are not read. Texts of any length are read whole; a term
longer than others is a term like any other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.llm.words import scramble, slices
from basketry.session import materialize

K = 20
#: A term's count sets one entry for each of these that it reaches.
LEVELS = np.array([1, 2, 3, 4, 6, 9, 14, 21, 32, 64, 128], np.int64)
HASHES = 4
#: Signature bits per entry, at least; widths are powers of two up to MAX_WIDTH
#: (beyond it signatures fill up: bounds grow, results stay).
BITS_PER_ENTRY = 16
MIN_WIDTH, MAX_WIDTH = 1 << 8, 1 << 20
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 22
#: Terms whose document frequencies a worker gathers before it passes them on.
GATHERED, PASSED = 200_000, 20_000
#: Documents scored for the threshold, as a multiple of k.
SEEDS = 2
BLOCK_TERMS = 1 << 16
#: (item, term) pairs summed at a time.
PAIRS = 4096
#: Bits of the map that keeps texts out of the shuffle.
MAP_BITS = 1 << 20
_CACHE: dict[bytes, int] = {}
CACHE_TERMS = 400_000

#: A-Z lower-cased, ASCII other than letters and digits blank.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_SALTS = np.array([xxhash.xxh3_64_intdigest(f"level:{n}") for n in range(len(LEVELS))], np.uint64)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _hashes(terms) -> np.ndarray:
    if len(_CACHE) > CACHE_TERMS:
        _CACHE.clear()
    out = np.empty(len(terms), np.uint64)
    get, digest = _CACHE.get, xxhash.xxh3_64_intdigest
    for i, t in enumerate(terms):
        h = get(t)
        if h is None:
            h = _CACHE[t] = digest(t)
        out[i] = h
    return out


def _positions(entries: np.ndarray, width: int) -> np.ndarray:
    """The signature positions of entries, one row each."""
    x = scramble(entries)
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return ((a[..., None] + b[..., None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(width - 1)).astype(np.int64)


# ---- index ------------------------------------------------------------------

@dataclass(frozen=True)
class Index:
    """The written index: blocks of slices, document frequencies, totals."""
    blocks: DataFrame
    frequencies: DataFrame
    n_docs: int
    n_terms: int


class _Block:
    """A block that is being filled."""

    def __init__(self, width: int, rows: int):
        self.width = width
        self.room = min(rows, max(8, BLOCK_BYTES * 8 // width))
        self.bits = np.zeros((width, -(-self.room // 8)), np.uint8)
        self.ids, self.keys, self.sizes = [], [], []

    def add(self, entries: np.ndarray, doc_id, key: int, size: int) -> bool:
        """Whether the block is full now."""
        r = len(self.ids)
        at = _positions(entries, self.width).ravel()
        self.bits[at, r >> 3] |= np.uint8(1 << (r & 7))
        self.ids.append(doc_id)
        self.keys.append(key)
        self.sizes.append(size)
        return r + 1 == self.room

    def packed(self) -> bytes:
        return np.ascontiguousarray(self.bits[:, :-(-len(self.ids) // 8)]).tobytes()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, max_width: int = MAX_WIDTH) -> Index:
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    names = ["width", "ids", "keys", "sizes", "bits", "terms", "dfs"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Block] = {}
        df: Counter = Counter()
        id_type = None

        def row(width=None, ids=None, keys=None, sizes=None, bits=None, terms=None, dfs=None) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((width, ids, keys, sizes, bits, terms, dfs), kinds)], names)

        def passed() -> Iterator[pa.RecordBatch]:
            terms, counts = list(df), list(df.values())
            for lo in range(0, len(terms), PASSED):
                yield row(terms=terms[lo:lo + PASSED], dfs=counts[lo:lo + PASSED])
            df.clear()

        def full(b: _Block) -> pa.RecordBatch:
            return row(b.width, b.ids, b.keys, b.sizes, b.packed())

        for batch in slices(batches):
            id_type = batch.schema.field(0).type
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                words = terms_of(text)
                if not words:
                    continue
                tf = Counter(words)
                df.update(tf.keys())
                levels = np.searchsorted(LEVELS, np.fromiter(tf.values(), np.int64, len(tf)), side="right")
                total = int(levels.sum())
                level = np.arange(total) - np.repeat(np.cumsum(levels) - levels, levels)
                entries = np.repeat(_hashes(tf), levels) ^ _SALTS[level]
                width = min(max_width, max(MIN_WIDTH, 1 << (BITS_PER_ENTRY * total - 1).bit_length()))
                block = blocks.get(width) or blocks.setdefault(width, _Block(width, block_rows))
                if block.add(entries, doc_id, key, len(words)):
                    yield full(blocks.pop(width))
                if len(df) > GATHERED:
                    yield from passed()
        for b in blocks.values():
            yield full(b)
        yield from passed()

    kind = rows.schema[0].dataType.simpleString()
    written = materialize(rows.mapInArrow(work, f"width int, ids array<{kind}>, keys array<bigint>, sizes array<bigint>, bits binary, terms array<binary>, dfs array<bigint>"), "lexical-index")
    pairs = written.where("width IS NULL").select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select("t.terms", "t.dfs")
    frequencies = materialize(pairs.groupBy(F.col("terms").alias("term")).agg(F.sum("dfs").alias("df")), "lexical-frequencies")
    blocks = written.where("width IS NOT NULL").drop("terms", "dfs")
    n, total = blocks.agg(F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s))).first()
    return Index(blocks, frequencies, n or 0, total or 0)


# ---- items ------------------------------------------------------------------

def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, item_key, term, times``: the terms of every different item."""
    rows = items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = [Counter(terms_of(t)) for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, c in enumerate(counts) for _ in c], pa.int64())
            keys = pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), keys.take(at), pa.array([t for c in counts for t in c], pa.binary()),
                                              pa.array([n for c in counts for n in c.values()], pa.int64())], ["item_id", "item_key", "term", "times"])

    return rows.mapInArrow(work, f"item_id {rows.schema[0].dataType.simpleString()}, item_key bigint, term binary, times bigint")


def _query_blocks(weighed: DataFrame) -> Iterator[list]:
    """The items' terms in blocks of at most BLOCK_TERMS rows (or one item)."""
    sizes = materialize(weighed.groupBy("item_id", "item_key").agg(F.count(F.lit(1)).alias("n")), "lexical-items")
    blocks = 1
    of = lambda: F.pmod(F.xxhash64("item_id", "item_key"), F.lit(blocks))
    while sizes.groupBy(of().alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where((F.col("n") > BLOCK_TERMS) & (F.col("k") > 1)).limit(1).count():
        blocks *= 2
    for b in range(blocks):
        rows = weighed.where(of() == b).collect()
        if rows:
            yield rows


def _factor(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 75 + (25 * sizes * n_docs) // n_terms


class Queries:
    """A block of items: their terms, weights and counts."""

    def __init__(self, rows: list, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.items = list(dict.fromkeys((r["item_id"], r["item_key"]) for r in rows))
        number = {item: i for i, item in enumerate(self.items)}
        df = {bytes(r["term"]): r["df"] for r in rows}
        self.terms = sorted(df)
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in self.terms], np.int64)
        at = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((number[r["item_id"], r["item_key"]], at[bytes(r["term"])], r["times"]) for r in rows)
        self.item, self.term, self.times = (np.array(c, np.int64) for c in zip(*pairs))
        self.hashes = _hashes(self.terms)

    def bounds(self, width: int, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """For every item and document of an index block an upper bound on the score."""
        m, rows = _factor(sizes, self.n_docs, self.n_terms), len(sizes)
        most = np.concatenate([np.minimum(LEVELS[1:, None] - 1, sizes[None]), sizes[None]])
        allowed = np.concatenate([np.zeros((1, rows), np.int64), (10 ** 9 * most) // (1000 * most + 12 * m[None])])
        out = np.zeros((len(self.items), rows), np.int64)
        column = np.arange(rows)
        for lo in range(0, len(self.term), PAIRS):
            used, pair = np.unique(self.term[lo:lo + PAIRS], return_inverse=True)
            reached = np.zeros((len(used), rows), np.int8)
            alive, still = np.arange(len(used)), None
            for salt in _SALTS:
                held = np.bitwise_and.reduce(bits[_positions(self.hashes[used[alive]] ^ salt, width)], axis=1)
                still = held if still is None else still & held
                some = still.any(axis=1)
                alive, still = alive[some], still[some]
                if not len(alive):
                    break
                reached[alive] += np.unpackbits(still, axis=1, count=rows, bitorder="little").astype(np.int8)
            best = allowed[reached, column] * self.weight[used][:, None]
            item, times = self.item[lo:lo + PAIRS], self.times[lo:lo + PAIRS]
            first = np.flatnonzero(np.diff(item, prepend=-1))
            out[item[first]] += np.add.reduceat(best[pair] * times[:, None] if (times > 1).any() else best[pair], first, axis=0)
        return out

    def weights(self) -> list[list[tuple[bytes, int]]]:
        """Of every item the terms with their weight times their count."""
        out: list[list] = [[] for _ in self.items]
        for i, t, n in zip(self.item.tolist(), self.term.tolist(), self.times.tolist()):
            out[i].append((self.terms[t], int(self.weight[t]) * n))
        return out


# ---- search -----------------------------------------------------------------

def _bounded(index: Index, queries: Queries, threshold: np.ndarray | None, seeds: int) -> DataFrame:
    """``item, id, key, bound``: each task's ``seeds`` documents of the highest
    bounds for every item, or all that reach the item's threshold."""
    rows = index.blocks.select("width", "ids", "keys", "sizes", "bits")
    id_kind = rows.schema["ids"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(queries.items)
        best, code = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
        ids, keys, start, id_type = [], [], 0, None

        def found(item: np.ndarray, ids_: pa.Array, keys_: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), ids_, pa.array(keys_), pa.array(bound)], ["item", "id", "key", "bound"])

        for batch in batches:
            for b in range(batch.num_rows):
                width, sizes = batch.column(0)[b].as_py(), batch.column(3)[b].values.to_numpy()
                bits = np.frombuffer(batch.column(4)[b].as_buffer(), np.uint8).reshape(width, -1)
                bound = queries.bounds(width, sizes, bits)
                own_ids, own_keys = batch.column(1)[b].values, batch.column(2)[b].values.to_numpy()
                if threshold is not None:
                    item, at = np.nonzero(bound >= threshold[:, None])
                    if len(item):
                        yield found(item, own_ids.take(pa.array(at)), own_keys[at], bound[item, at])
                    continue
                both = np.concatenate([best, bound], axis=1)
                codes = np.concatenate([code, np.broadcast_to(start + np.arange(len(sizes)), bound.shape)], axis=1)
                if both.shape[1] > seeds:
                    pick = np.argpartition(both, -seeds, axis=1)[:, -seeds:]
                    both, codes = np.take_along_axis(both, pick, 1), np.take_along_axis(codes, pick, 1)
                best, code = both, codes
                ids.append(own_ids)
                keys.append(own_keys)
                start, id_type = start + len(sizes), own_ids.type
        if start and threshold is None:
            item, at = np.nonzero(best > 0)
            rows_ = code[item, at]
            yield found(item, pa.concat_arrays(ids).cast(id_type).take(pa.array(rows_)), np.concatenate(keys)[rows_], best[item, at])

    return rows.mapInArrow(work, f"item int, id {id_kind}, key bigint, bound bigint")


def _near_map(key: Column, wanted: DataFrame) -> tuple[DataFrame, Column]:
    """A one-row frame with a bitmap of the wanted keys, of fixed size, and the
    test of a key against it."""
    slot = lambda k: F.pmod(k, F.lit(MAP_BITS))
    word, bit = lambda k: F.floor(slot(k) / 64).cast("int"), lambda k: (slot(k) % 64).cast("int")
    one = F.lit(1).cast("long")
    set_bits = wanted.select(word(F.col("key")).alias("w"), bit(F.col("key")).alias("b")).distinct()
    words = [0] * (MAP_BITS // 64)
    for r in set_bits.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).collect():
        words[r["w"]] = r["v"]
    frame = wanted.sparkSession.createDataFrame([(words,)], "__map array<bigint>").coalesce(1)
    return F.broadcast(frame), F.call_function("shiftright", F.get("__map", word(key)), bit(key)).bitwiseAND(one) == 1


def _exact(docs: DataFrame, wanted: DataFrame, queries: Queries, id_col: str, text_col: str) -> DataFrame:
    """``item, id, key, score`` of the wanted (item, id, key), from whole texts."""
    pairs = wanted.groupBy("id", "key").agg(F.collect_set("item").alias("items")).select(F.col("id").alias("__id"), F.col("key").alias("__key"), "items")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    bitmap, test = _near_map(F.col("key"), wanted)
    near = rows.join(bitmap, test).drop("__map")
    joined = near.join(pairs, F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))).select("id", "key", F.col("text").cast("binary").alias("text"), "items")
    n_docs, n_terms, weights = queries.n_docs, queries.n_terms, queries.weights()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}  # the last short texts and their scores: copies are scored once
        for batch in slices(batches):
            pick, item, score = [], [], []
            for r, (text, items) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if text not in seen:
                    if len(seen) >= 64:
                        seen.clear()
                    words = terms_of(text)
                    tf, m = Counter(words), 75 + 25 * len(words) * n_docs // n_terms
                    one = {t: 10 ** 9 * c // (1000 * c + 12 * m) for t, c in tf.items()}, {}
                    if len(text) < 100_000:
                        seen[text] = one
                else:
                    one = seen[text]
                part, known = one
                for i in items:
                    if i not in known:
                        known[i] = sum(w * part.get(t, 0) for t, w in weights[i])
                    pick.append(r)
                    item.append(i)
                    score.append(known[i])
            at = pa.array(pick, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array(score, pa.int64())],
                                             ["item", "id", "key", "score"])

    return joined.mapInArrow(work, f"item int, id {dict(rows.dtypes)['id']}, key bigint, score bigint")


def _highest(rows: DataFrame, n: int, by: list[Column], salts: int = 64) -> DataFrame:
    """The ``n`` first rows of every item, first within salted parts of it."""
    parts = rows.withColumn("__salt", F.pmod(F.xxhash64("key", "id"), F.lit(salts)))
    own = Window.partitionBy("item", "__salt").orderBy(*by)
    first = parts.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= n).drop("__n", "__salt")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= n)


def search(index: Index, docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, item_key, rank, doc_id, score``: of every item the k
    documents of the highest scores above 0, equal ones by document id.
    ``index`` is the index of ``docs``."""
    spark = docs.sparkSession
    id_kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id_col]
    weighed = materialize(item_terms(items, item_id_col, item_text_col).join(index.frequencies, "term"), "lexical-queries")
    order = [F.desc("score"), F.col("id").asc_nulls_last(), F.col("key")]
    out = spark.createDataFrame([], f"item_id {item_kind}, item_key bigint, rank int, doc_id {id_kind}, score bigint")
    for rows in _query_blocks(weighed):
        queries = Queries(rows, index.n_docs, index.n_terms)
        top = _highest(_bounded(index, queries, None, SEEDS * k), SEEDS * k, [F.desc("bound"), F.col("key")])
        seeds = materialize(top.select("item", "id", "key"), "lexical-seeds")
        known = _highest(_exact(docs, seeds, queries, id_col, text_col), k, order).where(F.col("rank") == k).select("item", "score").collect()
        threshold = np.ones(len(queries.items), np.int64)
        for r in known:
            threshold[r["item"]] = max(1, r["score"])
        wanted = materialize(_bounded(index, queries, threshold, 0).select("item", "id", "key"), "lexical-candidates")
        ranked = _highest(_exact(docs, wanted, queries, id_col, text_col).where("score > 0"), k, order)
        named = spark.createDataFrame([(n, *item) for n, item in enumerate(queries.items)], f"item int, item_id {item_kind}, item_key bigint")
        found = ranked.join(F.broadcast(named), "item").select("item_id", "item_key", "rank", F.col("id").alias("doc_id"), "score")
        out = out.unionByName(materialize(found, "lexical-found"))
    return out


#: The twenty best documents of every item of ``benchmark`` in DuckDB SQL.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t
  FROM documents WHERE text IS NOT NULL),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(t)) AS BIGINT) AS nt FROM d WHERE len(t) > 0),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, nd),
m AS (SELECT r, doc_id, 75 + (25 * len(t) * nd) // nt AS m FROM d, s WHERE len(t) > 0),
b AS (SELECT row_number() OVER () AS item, item_id,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t
      FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(t) AS term FROM b) GROUP BY item, item_id, term),
p AS (
  SELECT q.item, q.item_id, f.r, m.doc_id, CAST(sum(times * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * m.m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m ON m.r = f.r GROUP BY q.item, q.item_id, f.r, m.doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, r) AS INT) AS rank FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""
