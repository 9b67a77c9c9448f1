"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs of letters and digits; in scripts written without
spaces each character is a word. A seed hashes the words at
the positions of a fixed mask and ignores those between, so a substituted
word under a gap does not change it. The four masks together hit every
window of 13 words with up to two substitutions, and every one of 8 words
with one (no qualifying window is missed).

Items under 8 words match exactly, as a run of the document's words: each
emits one seed, a hash of all its words, and documents the seeds of the
lengths that occur (``short_items=False`` leaves such items out). One word can be an item, and then every
document that holds it overlaps.

Test and training seeds are joined by hash. Each hit fixes how the two texts
line up; along that line the words around the hit are compared, and an
overlap counts if some window of 13 words has at least 11 equal (items of 8
to 12 words: all but one, over the whole item). An overlap is a longest run
of such windows that overlap or adjoin; each pair reports the one with the
most equal words.

Documents emit only the seeds that a filter of the benchmark's seeds lets
through, with the words around them. The filter is built only if the
benchmark has at most ``MAX_FILTER`` seeds; beyond that all seeds go into the
join. Either way a document's hits go out in pieces of bounded length, with
the words that any window around them can reach, and what the pieces find on
one line is put together afterwards: results are the same for pieces of any
length, with or without the filter.

Edge cases: a null text counts as empty; benchmark items without a word
never match; repeated rows of either table collapse to
one result row per (document id, item id); rows with a null id take part and
give a null id; empty tables give an empty result, or all documents kept;
further columns are not read and pass through ``clean``. Texts of any length
are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from basketry.llm.words import HashFilter, odd_multipliers, scramble, slices, word_hashes
from basketry.session import materialize

#: Letters and signs of scripts without spaces: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = ("\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u1000-\u103f\u1050-\u108f\u1780-\u17d3\u3005-\u3007\u3041-\u3096\u309d-\u309f"
            "\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 4, 6), (0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 5, 6))
WINDOW, WINDOW_EQUAL = 13, 11
SHORTEST = 8
#: Benchmark seeds that a worker's filter may hold (16 MB of hashes).
MAX_FILTER = 2_000_000
#: Hits in one piece of a document.
PIECE_HITS = 1024

ITEM = "item_id {id}, item_key bigint, words array<bigint>, seeds array<struct<h:bigint,p:int>>"
PIECE = "doc_id {id}, text_key bigint, piece bigint, start int, words array<bigint>, seeds array<struct<h:bigint,p:int>>"
SEED = pa.struct([("h", pa.int64()), ("p", pa.int32())])


def masks_for(lengths: Sequence[int]) -> dict[int, tuple[int, ...]]:
    """The masks by their salt: the spaced ones, and a full one for each short length."""
    return dict(enumerate(MASKS)) | {len(MASKS) + n: tuple(range(n)) for n in lengths}


def seeds_of(words: np.ndarray, masks: dict[int, tuple[int, ...]]) -> list[np.ndarray]:
    """For each mask the seed hash at every position where the mask fits."""
    out = []
    for n, mask in masks.items():
        m = len(words) - mask[-1]
        if m <= 0:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.zeros(m, np.uint64)
        for at, by in zip(mask, odd_multipliers(len(mask), n)):
            h += words[at:at + m] * by
        out.append(scramble(h))
    return out


def _seed_list(hashes: np.ndarray, at: np.ndarray) -> list[dict]:
    return [{"h": int(h), "p": int(p)} for h, p in zip(hashes.view(np.int64), at)]


def items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", short_items: bool = True) -> DataFrame:
    """The benchmark's items with their word hashes and seeds."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, words, seeds = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = word_hashes(t or "", WORD)
                if len(w) < (1 if short_items else SHORTEST):
                    continue
                masks = masks_for(()) if len(w) >= SHORTEST else {k: m for k, m in masks_for([len(w)]).items() if k >= len(MASKS)}
                ids.append(i)
                keys.append(xxhash.xxh3_64_intdigest(w.tobytes()) - (1 << 63))
                words.append(w.view(np.int64))
                seeds.append([s for h in seeds_of(w, masks) for s in _seed_list(h, np.arange(len(h)))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(seeds, pa.list_(SEED))],
                ["item_id", "item_key", "words", "seeds"])

    return materialize(rows.mapInArrow(work, ITEM.format(id=rows.schema[0].dataType.simpleString())).distinct(), "decontam-items")


def _seed_filter(test: DataFrame) -> HashFilter | None:
    n = test.agg(F.sum(F.size("seeds"))).first()[0] or 0
    if n > MAX_FILTER:
        return None
    hashes = test.select(F.explode("seeds.h").alias("h")).distinct().collect()
    return HashFilter(np.array([r[0] for r in hashes], np.int64).view(np.uint64))


def _short_lengths(test: DataFrame) -> list[int]:
    """Which lengths under ``SHORTEST`` the items have."""
    return sorted(r[0] for r in test.select(F.size("words").alias("n")).where(F.col("n") < SHORTEST).distinct().collect())


def pieces(docs: DataFrame, known: HashFilter | None, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = ()) -> DataFrame:
    """The parts of documents around seeds that may be the benchmark's."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    shared, masks = spark.sparkContext.broadcast(known), masks_for(lengths)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [word_hashes(t or "", WORD) for t in batch.column(2).to_pylist()]
            ends = np.cumsum([len(w) for w in words])
            flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
            hit_at, hit_h, hit_end = [], [], []
            for mask, h in zip(masks.values(), seeds_of(flat, masks)):
                at = np.arange(len(h)) if shared.value is None else shared.value.find(h)[0]
                # A seed must not reach into the next document.
                at = at[np.searchsorted(ends, at, side="right") == np.searchsorted(ends, at + mask[-1], side="right")]
                hit_at.append(at)
                hit_h.append(h[at])
                hit_end.append(at + mask[-1])
            at, h, end = map(np.concatenate, (hit_at, hit_h, hit_end))
            order = np.argsort(at, kind="stable")
            at, h, end = at[order], h[order], end[order]
            doc = np.searchsorted(ends, at, side="right")
            fresh = np.flatnonzero((np.diff(at) > 2 * WINDOW) | (np.diff(doc) > 0)) + 1
            cuts = [0, *fresh.tolist(), len(at)]
            out: dict[str, list] = {n: [] for n in ("doc", "piece", "start", "words", "seeds")}
            for a, b in zip(cuts, cuts[1:]):
                for lo in range(a, b, PIECE_HITS):
                    hi, d = min(b, lo + PIECE_HITS), int(doc[lo])
                    first = int(ends[d]) - len(words[d])
                    x, y = max(first, int(at[lo]) - WINDOW), min(int(ends[d]), int(end[lo:hi].max()) + 1 + WINDOW)
                    w = flat[x:y]
                    out["doc"].append(d)
                    out["piece"].append(xxhash.xxh3_64_intdigest(w.tobytes(), d) - (1 << 63))
                    out["start"].append(x - first)
                    out["words"].append(w.view(np.int64))
                    out["seeds"].append(_seed_list(h[lo:hi], at[lo:hi] - x))
            pick = pa.array(out["doc"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(out["piece"], pa.int64()), pa.array(out["start"], pa.int32()),
                 pa.array(out["words"], pa.list_(pa.int64())), pa.array(out["seeds"], pa.list_(SEED))],
                ["doc_id", "text_key", "piece", "start", "words", "seeds"])

    return materialize(rows.mapInArrow(work, PIECE.format(id=rows.schema[0].dataType.simpleString())), "decontam-pieces")


def _runs(words: np.ndarray, item: np.ndarray, at: int) -> list[tuple[int, int, np.ndarray]]:
    """Compare along a line (``at``: document word under the item's first).
    First word, end and unequal words of every run of qualifying windows."""
    low, high = max(0, -at), min(len(item), len(words) - at)
    width = min(WINDOW, len(item))
    if high - low < width:
        return []
    same = item[low:high] == words[low + at:high + at]
    equal = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(equal[width:] - equal[:-width] >= (WINDOW_EQUAL if width == WINDOW else width - 1 if width >= SHORTEST else width))
    if not len(good):
        return []
    cut = np.flatnonzero(np.diff(good) > width) + 1
    unequal = np.flatnonzero(~same)
    out = []
    for run in np.split(good, cut):
        a, b = int(run[0]), int(run[-1]) + width
        out.append((low + at + a, low + at + b, unequal[(unequal >= a) & (unequal < b)] + low + at))
    return out


LINE = ["doc_id", "text_key", "item_id", "item_key", "line"]


def _verified(lined: DataFrame) -> DataFrame:
    """The runs of qualifying windows in each piece, counted from the document's first word."""
    ids = dict(lined.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            found, pick = [], []
            for k in range(batch.num_rows):
                words, item = (np.asarray(cols[n][k].values) for n in ("words", "item_words"))
                at, start = cols["at"][k].as_py(), cols["start"][k].as_py()
                for a, b, unequal in _runs(words, item, at):
                    pick.append(k)
                    found.append((start + at, start + a, start + b, len(item), unequal + start))
            rows = pa.array(pick, pa.int64())
            numbers = [pa.array([f[j] for f in found], pa.int32()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([cols[n].take(rows) for n in LINE[:4]] + numbers + [pa.array([f[4] for f in found], pa.list_(pa.int32()))],
                                             [*LINE, "first", "end", "item_words", "unequal"])

    rows = lined.select("doc_id", "text_key", "item_id", "item_key", "start", "words", "item_words", "at")
    return rows.mapInArrow(work, f"doc_id {ids['doc_id']}, text_key bigint, item_id {ids['item_id']}, item_key bigint, line int, first int, end int, item_words int, unequal array<int>")


def _joined(runs: DataFrame) -> DataFrame:
    """Runs of one line that overlap or adjoin, as one."""
    own = Window.partitionBy(*LINE, "item_words").orderBy("first", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.distinct().withColumn("fresh", F.when(F.col("first") <= before, 0).otherwise(1))
    grouped = marked.withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return (grouped.groupBy(*LINE, "item_words", "run")
            .agg(F.min("first").alias("start_word"), F.max("end").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("unequal")))).alias("n_unequal"))
            .withColumn("n_words", F.col("end") - F.col("start_word")).withColumn("n_equal", F.col("n_words") - F.col("n_unequal"))
            .select("doc_id", "text_key", "item_id", "n_words", "n_equal", "start_word", "item_words"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_id_col: str = "item_id", item_text_col: str = "text", short_items: bool = True) -> DataFrame:
    """``doc_id, text_key, item_id, n_words, n_equal, start_word, item_words``
    for every run of qualifying windows on every line-up."""
    test = items(benchmark, item_id_col, item_text_col, short_items)
    train = pieces(docs, _seed_filter(test), id_col, text_col, _short_lengths(test))
    seeds = lambda t, *own: t.select(*own, F.explode("seeds").alias("s"))
    lines = (seeds(train, "piece").select("piece", F.col("s.h").alias("h"), F.col("s.p").alias("p"))
             .join(seeds(test, "item_key").select("item_key", F.col("s.h").alias("h"), F.col("s.p").alias("q")), "h")
             .select("piece", "item_key", (F.col("p") - F.col("q")).alias("at")).distinct())
    lined = (lines.join(train.drop("seeds"), "piece")
             .join(test.select("item_id", "item_key", F.col("words").alias("item_words")), "item_key"))
    return _joined(_verified(lined))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_items: bool = True) -> DataFrame:
    """One row per document and benchmark item that overlap, with the longest overlap."""
    found = overlaps(docs, benchmark, id_col, text_col, short_items=short_items)
    best = F.max(F.struct("n_equal", "n_words", (-F.col("start_word")).alias("first"), "item_words"))
    return (found.groupBy("doc_id", "item_id").agg(best.alias("b"))
            .select(F.col("doc_id").alias(id_col), "item_id", F.col("b.n_equal").alias("n_equal"), F.col("b.n_words").alias("n_words"),
                    (-F.col("b.first")).alias("start_word"), F.col("b.item_words").alias("item_words")))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_items: bool = True) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item."""
    bad = overlaps(docs, benchmark, id_col, text_col, short_items=short_items).select(F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key")).distinct()
    bad = materialize(bad, "decontam-found")
    keyed = docs.withColumn("__key", F.xxhash64(text_col))
    return keyed.join(bad, F.col(id_col).eqNullSafe(F.col("__bad_id")) & (F.col("__key") == F.col("__bad_key")), "left_anti").drop("__key")
