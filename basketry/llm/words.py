"""Word hashes shared by the operators that work on hashed words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_CACHE: dict[str, int] = {}
#: Words kept per worker before the cache starts afresh (bounds its memory).
CACHE_WORDS = 400_000


#: Rows that a worker takes out of an Arrow batch at a time.
SLICE_ROWS = 1_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, so that what is made of a part (words,
    hashes, masks) stays small beside the batch itself."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(lo, SLICE_ROWS)


def word_hashes(text: str, pattern: re.Pattern) -> np.ndarray:
    """64-bit hashes (uint64) of the pattern's matches in the lower-cased text, in order."""
    words = pattern.findall(text.lower())
    if len(_CACHE) > CACHE_WORDS:
        _CACHE.clear()
    out = np.empty(len(words), dtype=np.uint64)
    get, digest = _CACHE.get, xxhash.xxh3_64_intdigest
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = _CACHE[w] = digest(w)
        out[i] = h
    return out


def odd_multipliers(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers for position-dependent hashing."""
    return np.array([xxhash.xxh3_64_intdigest(f"{salt}:{i}") | 1 for i in range(n)], dtype=np.uint64)


def scramble(h: np.ndarray) -> np.ndarray:
    """Mix the high bits of a sum of products into the low bits."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class HashFilter:
    """Membership test for a sorted uint64 array: a bit table first, then a
    binary search for the few survivors."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(np.asarray(keys, dtype=np.uint64))
        bits = max(16, min(26, int(len(self.keys) * 64).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[(self.keys & self.mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are members, and their index among the keys."""
        at = np.flatnonzero(self.table[(h & self.mask).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == h[at]
        return at[hit], k[hit]
