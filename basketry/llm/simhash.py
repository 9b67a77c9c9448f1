"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: words are split at ASCII white space after lower-casing A-Z;
every run of four words (the whole sequence if shorter) is hashed with XXH64;
a fingerprint bit is set if it is set in over half of the hashes.

Search: each of the 64 bits gets a non-zero vector of RADIUS + 1 bits, and
each non-zero vector v makes a table whose mask holds the bits with an odd
inner product with v. RADIUS differing bits span a space of lower dimension,
so some v is orthogonal to all of them: every pair within the radius agrees
on that mask and meets in that table (covering, no pair is missed).

Only distinct fingerprints go into the tables, so exact copies are one row
whatever their number. A bucket of two gives its pair; one of up to
``BUCKET`` compares its members in place; members of larger buckets are
linked exactly without pairs: two fingerprints within four bits share a
midpoint within two bits of both, so each is sent to its 2,081 neighbours
and linked to the smallest that arrives at the same one.

Links become components by the large-star, small-star rounds, written to the
shared folder each time.

Edge cases: a null text counts as empty; texts without words get fingerprint
0 and link like any other; repeated rows each give a row; rows with a null id
take part but never name a component unless all its ids are null; an empty
table gives an empty result; further columns are not read. Texts of any
length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from basketry.session import materialize

WIDTH = 4
RADIUS = 4
SEED = 42
BITS = 64
#: Members that a bucket may compare in place; larger ones go over midpoints.
BUCKET = 64
MAX_ROUNDS = 60
#: Shingle hashes summed at a time.
SLICE = 1 << 15


# ---- fingerprints -----------------------------------------------------------

def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(joined, seed)]
    else:
        ends = list(accumulate(map(len, words), lambda end, size: end + 1 + size))
        starts = [0, *(e + 1 for e in ends)]
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1:])]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), SLICE):
        part = np.ascontiguousarray(h[lo:lo + SLICE]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``id, key, fp``: one row per row of ``docs``; ``fp`` is the fingerprint
    as a signed number, ``key`` a hash of the text (it tells rows of one id apart)."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["id", "key", "fp"])

    return rows.mapInArrow(work, f"id {rows.schema[0].dataType.simpleString()}, key bigint, fp bigint")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- links ------------------------------------------------------------------

def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask per non-zero vector of radius + 1 bits; bit i of the
    fingerprint carries vector i mod (2^(radius+1) - 1) + 1."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() & 1) for v in range(1, vectors + 1)]


def midpoint_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """All flips of up to half the radius."""
    return [sum(1 << i for i in c) for n in range(radius // 2 + 1) for c in combinations(range(bits), n)]


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffle: the tables here follow the input, and files of sorted
    numbers are so small beside their rows that the planner takes them for
    small ones and gathers them on the driver to broadcast them."""
    return left.join(right.hint("merge"), on, how)


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b`` (a < b): pairs of distinct fingerprints that connect
    everything within the radius. ``distinct`` has the column ``fp``."""
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    placed = distinct.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("t", "k"))
    buckets = materialize(
        placed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "simhash-buckets")
    twos = buckets.where("n = 2").where(_apart(F.col("a"), F.col("b")) <= radius).select("a", "b")

    crowded = _met(placed, buckets.where("n > 2").select("t", "k", "n"), ["t", "k"])
    crowded = materialize(crowded.select("t", "k", "n", "fp"), "simhash-crowded")
    small = crowded.where(F.col("n") <= BUCKET).groupBy("t", "k").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = F.transform("fps", lambda a: F.transform(
        F.filter("fps", lambda b: (b > a) & (_apart(a, b) <= radius)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    compared = small.select(F.explode(F.flatten(near)).alias("l")).select("l.a", "l.b")

    hot = crowded.where(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.array(*[F.lit(_signed(m)) for m in midpoint_masks(radius)])
    sent = hot.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    met = sent.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b")
    over = _met(sent, met.select("mid", "a"), "mid").where("fp > a").select("a", F.col("fp").alias("b"))
    return twos.unionByName(compared).unionByName(over).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``fp, root`` for every end of an edge: the smallest member reachable.

    Large-star links the larger neighbours of every node to its smallest one,
    small-star the smaller ones; both keep connectivity, and together they
    end in stars around the smallest members.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        # Written, so that the joins below shuffle it by itself and Spark can split a hot center.
        return materialize(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "simhash-smallest")

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())

    pairs = materialize(edges.select("a", "b"), "simhash-links")
    known = state(pairs)
    for _ in range(MAX_ROUNDS):
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _met(both.where("v > u"), smallest(both), "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        large = materialize(large, "simhash-large")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = smallest(down)
        small = (_met(down, least, "u").where("v > m").select(F.col("m").alias("a"), F.col("v").alias("b"))
                 .union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct())
        pairs = materialize(small, "simhash-small")
        now = state(pairs)
        if now == known:
            return pairs.select(F.col("b").alias("fp"), F.col("a").alias("root")).union(pairs.select(F.col("a").alias("fp"), F.col("a").alias("root")).distinct())
        known = now
    raise RuntimeError("the components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``id, key, fp, component, keep_id, keep_key`` per row of ``docs``:
    ``component`` is the smallest id of its component; (``keep_id``,
    ``keep_key``) name the row that stays when one of each component does."""
    prints = materialize(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    keep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    distinct = materialize(prints.groupBy("fp").agg(keep.alias("keep")), "simhash-distinct")
    roots = components(links(distinct, radius))
    rooted = materialize(_met(distinct, roots, "fp", "left").select("fp", "keep", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    groups = materialize(rooted.groupBy("root").agg(F.min("keep").alias("keep")), "simhash-groups")
    named = materialize(_met(rooted.select("fp", "root"), groups, "root").select("fp", "keep"), "simhash-named")
    return _met(prints, named, "fp").select("id", "key", "fp", F.col("keep.id").alias("component"),
                                           F.col("keep.id").alias("keep_id"), F.col("keep.key").alias("keep_key"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component (the one of the smallest id)."""
    kept = near_duplicates(docs, id_col, text_col, width, radius)
    kept = kept.where(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key")))
    kept = materialize(kept.select(F.col("id").alias("__keep_id"), F.col("key").alias("__keep_key")).distinct(), "simhash-kept")
    keyed = docs.withColumn("__key", F.xxhash64(text_col))
    own = _met(keyed, kept, F.col(id_col).eqNullSafe(F.col("__keep_id")) & (F.col("__key") == F.col("__keep_key")), "left_semi")
    return own.dropDuplicates([id_col, "__key"]).drop("__key")
