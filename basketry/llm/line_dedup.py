"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line without white space at both ends, A-Z lower-cased;
the empty key is never counted. The state has two written tables, both
sharded by the key's hash:

* reference counts: every key seen and the number of documents that hold it;
* cuckoo filters: per shard the keys whose count has reached the threshold.

``insert`` adds documents to the counts and ``delete`` takes documents away
again. Only keys whose count crosses the threshold, in either direction, go
to the filters: a cuckoo filter forgets a key as exactly as it has learnt it,
so inserting and deleting the same documents leaves the state as it was. Each
call returns a new state and leaves the old one usable.

``apply`` drops lines. The filters never miss a frequent key and may claim a
few others; those claims are looked up in the reference counts, and what is
not frequent there is denied. Filters and denied keys go to all tasks while
they are below ``MAX_SENT`` bytes and ``MAX_DENIED`` keys; beyond that the keys of the lines are
joined to the counts by shard instead, with the same result.

Keys are 128-bit hashes. A shard's filter is a chain of equal tables, so that
no number of keys overflows it; if shards hold more than ``SHARD_KEYS`` keys
on average, all filters are made anew over more shards from the counts.

Edge cases: a null or empty text is one empty line; every row is a document,
repeated rows too; null ids take part; an empty table gives an empty result;
further columns are kept by ``apply`` (its own columns replace others of
their names). Texts and lines of any length are read whole. Deleting more
than was inserted raises an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.llm.words import slices
from basketry.session import materialize

MIN_DOCS = 10
SHARDS = 64
#: Slots of a bucket, moves before a table counts as full, buckets of a table.
SLOTS, MOVES, BUCKETS = 4, 200, 256
#: Average keys of a shard from which there are more shards.
SHARD_KEYS = 512
#: Bytes of filters, and denied keys, that are sent to every task at most.
MAX_SENT, MAX_DENIED = 64 << 20, 100_000
#: Keys whose counts a worker gathers before it passes them on.
GATHERED = 200_000

REFS = "key binary, n bigint"
FILTERS = "shard int, tables array<binary>"


def keys_of(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys."""
    lines = text.split(b"\n")
    return lines, [line.strip(b" \t\n\x0b\x0c\r").lower() for line in lines]


def key_hash(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


# ---- cuckoo filters ---------------------------------------------------------

def _mixed(x):
    """A 64-bit mix of numbers or an array of them."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def places(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shard, bucket hash, fingerprint (never 0) and the fingerprint's own
    hash of 16-byte keys (an array of n x 2 uint64)."""
    a, b = hashes[:, 0], hashes[:, 1]
    print_ = (a >> np.uint64(48)).astype(np.uint16)
    print_[print_ == 0] = 1
    return (b % np.uint64(shards)).astype(np.int64), _mixed(b), print_, _mixed(print_.astype(np.uint64))


def _as_hashes(keys: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


class CuckooFilter:
    """A chain of cuckoo tables of one size. A key stands in one of two buckets
    of one table as its fingerprint; either bucket follows from the other and
    the fingerprint, so that a fingerprint can move without its key. Keys of
    one fingerprint and pair of buckets are alike in all tables, so that
    forgetting one of them, wherever it stands, leaves the others."""

    def __init__(self, buckets: int = BUCKETS, blobs: Iterable[bytes] = ()):
        self.buckets = buckets
        self.tables = [np.frombuffer(b, np.uint16).reshape(-1, SLOTS).copy() for b in blobs]

    def pack(self) -> list[bytes]:
        return [t.tobytes() for t in self.tables]

    def insert(self, bucket: int, print_: int, other: int) -> None:
        if not self.tables or not self._placed(self.tables[-1], bucket, print_, other):
            self.tables.append(np.zeros((self.buckets, SLOTS), np.uint16))
            self._placed(self.tables[-1], bucket, print_, other)

    @staticmethod
    def _placed(table: np.ndarray, bucket: int, print_: int, other: int) -> bool:
        buckets = len(table)
        at, moved = bucket % buckets, []
        for step in range(MOVES):
            for b in (at, at ^ other % buckets) if step == 0 else (at,):
                free = np.flatnonzero(table[b] == 0)
                if len(free):
                    table[b, free[0]] = print_
                    return True
            slot = step % SLOTS
            moved.append((at, slot))
            print_, table[at, slot] = int(table[at, slot]), print_
            at ^= int(_mixed(np.array([print_], np.uint64))[0]) % buckets
        for at, slot in reversed(moved):  # full: the table holds what it held before
            print_, table[at, slot] = int(table[at, slot]), print_
        return False

    def delete(self, bucket: int, print_: int, other: int) -> None:
        for table in self.tables:
            for b in (bucket % self.buckets, (bucket ^ other) % self.buckets):
                held = np.flatnonzero(table[b] == print_)
                if len(held):
                    table[b, held[0]] = 0
                    return
        raise ValueError("the key is not in the filter")


class Lookup:
    """Which of many keys the filters of all shards claim."""

    def __init__(self, filters: dict[int, list[bytes]], shards: int, buckets: int = BUCKETS):
        self.shards, self.buckets = shards, np.uint64(buckets)
        chains = {s: CuckooFilter(buckets, b).tables for s, b in filters.items()}
        self.levels = []
        for level in range(max(map(len, chains.values()), default=0)):
            own = [s for s, tables in chains.items() if level < len(tables)]
            start = np.full(shards, -1, np.int64)
            start[own] = np.arange(len(own)) * buckets
            self.levels.append((start, np.concatenate([chains[s][level] for s in own])))

    def claims(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        shard, bucket, print_, other = places(hashes, self.shards)
        for start, table in self.levels:
            own = start[shard]
            for b in (bucket, bucket ^ other):
                at = np.maximum(own, 0) + (b % self.buckets).astype(np.int64)
                out |= (own >= 0) & (table[at] == print_[:, None]).any(axis=1)
        return out


# ---- state ------------------------------------------------------------------

@dataclass(frozen=True)
class State:
    """The written tables of reference counts and filters."""
    refs: DataFrame
    filters: DataFrame
    min_docs: int
    shards: int
    shard_keys: int
    buckets: int


def empty_state(spark: SparkSession, min_docs: int = MIN_DOCS, shards: int = SHARDS, shard_keys: int = SHARD_KEYS, buckets: int = BUCKETS) -> State:
    """No documents yet. ``buckets`` (of a table) is a power of two."""
    return State(spark.createDataFrame([], REFS), spark.createDataFrame([], FILTERS), min_docs, shards, shard_keys, buckets)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``key, n``: in how many documents each key stands, in parts by task."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(map(key_hash, found), pa.binary()), pa.array(found.values(), pa.int64())], ["key", "n"])
            found.clear()
            return out

        held = 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                own = set(keys_of(text)[1])
                own.discard(b"")
                found.update(own)
                held += len(text)
                if len(found) > GATHERED or held > 32 << 20:
                    yield passed()
                    held = 0
        yield passed()

    return _texts(docs, text_col).mapInArrow(work, REFS)


def _shards_for(state: State, changes: DataFrame) -> int:
    frequent, shards = changes.where(F.col("n") >= state.min_docs).count(), state.shards
    while frequent > shards * state.shard_keys:
        shards *= 2
    return shards


def _crossed(state: State, changes: DataFrame, shards: int) -> DataFrame:
    """The filters after the keys whose count has crossed the threshold; over
    another number of shards, filters of all frequent keys."""
    buckets, now, before = state.buckets, F.col("n") >= state.min_docs, F.col("old") >= state.min_docs
    if shards == state.shards:
        crossing, filters = changes.where(now != before).select("key", now.alias("up")), state.filters
    else:
        crossing, filters = changes.where(now).select("key", F.lit(True).alias("up")), state.filters.limit(0)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, bucket, print_, other = places(_as_hashes(batch.column(0).to_pylist()), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(bucket.view(np.int64)), pa.array(print_.astype(np.int32)),
                                              pa.array(other.view(np.int64)), batch.column(1)], ["shard", "bucket", "print", "other", "up"])

    def update(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        filter_ = CuckooFilter(buckets, old["tables"].iloc[0] if len(old) else [])
        # Deletions first, in a fixed order: the result does not hang on how rows arrive.
        new = new.sort_values(["up", "bucket", "print"], kind="stable")
        for up, bucket, print_, other in zip(new["up"], new["bucket"], new["print"], new["other"]):
            (filter_.insert if up else filter_.delete)(int(bucket) & (1 << 64) - 1, int(print_), int(other) & (1 << 64) - 1)
        return pd.DataFrame({"shard": [key[0]], "tables": [filter_.pack()]})

    moves = crossing.mapInArrow(keyed, "shard int, bucket bigint, print int, other bigint, up boolean")
    return materialize(filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(update, FILTERS), "line-dedup-filters")


def _changed(state: State, docs: DataFrame, text_col: str, sign: int) -> State:
    delta = counts(docs, text_col).select("key", F.lit(0).cast("long").alias("old"), (F.col("n") * sign).alias("delta"))
    both = state.refs.select("key", F.col("n").alias("old"), F.lit(0).cast("long").alias("delta")).unionByName(delta)
    summed = both.groupBy("key").agg(F.sum("old").alias("old"), F.sum("delta").alias("delta"))
    changes = materialize(summed.select("key", "old", (F.col("old") + F.col("delta")).alias("n")), "line-dedup-refs")
    if sign < 0 and changes.where("n < 0").limit(1).count():
        raise ValueError("documents were deleted that had not been inserted")
    shards = _shards_for(state, changes)
    return replace(state, refs=changes.where("n <> 0").select("key", "n"), filters=_crossed(state, changes, shards), shards=shards)


def insert(state: State, docs: DataFrame, text_col: str = "text") -> State:
    """The state with ``docs`` counted."""
    return _changed(state, docs, text_col, 1)


def delete(state: State, docs: DataFrame, text_col: str = "text") -> State:
    """The state without ``docs``, which must have been inserted."""
    return _changed(state, docs, text_col, -1)


# ---- dropping lines ---------------------------------------------------------

def _sent_filters(state: State) -> Lookup | None:
    """The filters if they are small enough to send, else None."""
    size = state.filters.agg(F.sum(F.aggregate("tables", F.lit(0).cast("long"), lambda a, t: a + F.length(t)))).first()[0] or 0
    if size > MAX_SENT:
        return None
    return Lookup({r["shard"]: [bytes(t) for t in r["tables"]] for r in state.filters.collect()}, state.shards, state.buckets)


def _denied(state: State, docs: DataFrame | None, lookup: Lookup, text_col: str) -> set[bytes] | None:
    """Keys that the filters claim and the counts don't hold as frequent: of
    ``docs``, or of all counted documents; None if they are too many to send."""
    def claimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(lookup.claims(_as_hashes(batch.column(0).to_pylist())), pa.bool_()))

    frequent = F.col("n") >= state.min_docs
    if docs is None:
        denied = state.refs.where(~frequent).select("key").mapInArrow(claimed, "key binary")
    else:
        seen = counts(docs, text_col).select("key").mapInArrow(claimed, "key binary").distinct()
        denied = seen.join(state.refs.where(frequent), "key", "left_anti")
    denied = materialize(denied, "line-dedup-denied")
    return None if denied.count() > MAX_DENIED else {bytes(r["key"]) for r in denied.collect()}


def _by_join(state: State, docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the frequent keys that each holds, found by joins on keys."""
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [sorted({key_hash(k) for k in keys_of(t)[1] if k}) for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, s in enumerate(sets) for _ in s], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([k for s in sets for k in s], pa.binary())], ["__text", "key"])

    keyed = docs.withColumn("__text", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    keyed = keyed.withColumn("__text", F.concat_ws(":", "__text", F.length(text_col)))
    pairs = keyed.select("__text", F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(own, "__text string, key binary").distinct()
    frequent = state.refs.where(F.col("n") >= state.min_docs).select("key")
    held = pairs.join(frequent, "key").groupBy("__text").agg(F.collect_list("key").alias("__keys"))
    return keyed.join(held, "__text", "left").drop("__text")


def apply(state: State, docs: DataFrame, text_col: str = "text", inserted: bool = False) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (the text without
    its frequent lines). ``inserted`` says that all of ``docs`` are counted in
    the state, which spares a look at their keys."""
    made = ("n_lines", "n_dropped", "kept")
    docs = docs.drop(*(c for c in made if c != text_col))
    lookup = _sent_filters(state)
    denied = None if lookup is None else _denied(state, None if inserted else docs, lookup, text_col)
    sent = lookup is not None and denied is not None
    rows = docs if sent else _by_join(state, docs, text_col)
    passed = [c for c in docs.columns]
    rows = rows.select(*passed, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__whole"),
                       *([] if sent else [F.col("__keys")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = len(passed)
            parts = [keys_of(t) for t in batch.column(n).to_pylist()]
            hashes = [key_hash(k) for _, keys in parts for k in keys]
            if sent:
                drop = lookup.claims(_as_hashes(hashes))
                if denied:
                    for i in np.flatnonzero(drop):
                        drop[i] = hashes[i] not in denied
            else:
                frequent = [set(f or ()) for f in batch.column(n + 1).to_pylist()]
                drop = np.fromiter((key_hash(k) in f for f, (_, keys) in zip(frequent, parts) for k in keys), bool, len(hashes))
            n_lines, n_dropped, kept, at = [], [], [], 0
            for lines, keys in parts:
                own = drop[at:at + len(lines)].tolist()
                at += len(lines)
                stay = [line for line, key, d in zip(lines, keys, own) if not d or not key]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                                             [*passed, *made])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(work, f"{schema}, n_lines bigint, n_dropped bigint, kept string")


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``apply`` with a state of exactly ``docs``."""
    state = insert(empty_state(docs.sparkSession, min_docs), docs, text_col)
    return apply(state, docs, text_col, inserted=True)


#: The lines that stay in ``documents``, in DuckDB SQL.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT r, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
o AS (SELECT k.r, count(*) AS n_lines, count(f.key) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '') AS kept
      FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM o JOIN d USING (r)
"""
