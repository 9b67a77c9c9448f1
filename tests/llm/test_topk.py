import math
import random

import pytest
from pyspark.sql import functions as F

from basketry.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score string, dims string"


def _plain(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {(i, tuple(v)) for i, v in ok if i % 100 == 0}
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != q and len(w) == len(v))
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def _rows():
    rnd = random.Random(6)
    centres = [[rnd.gauss(0, 0.2) for _ in range(16)] for _ in range(8)]
    rows = [(i, [c + rnd.gauss(0, 0.05) for c in rnd.choice(centres)]) for i in range(1500)]
    rows += [(2000, None), (2001, [0.1] * 15 + [None]), (2100, [float("nan")] * 16), (2101, [float("inf")] * 16), (None, [0.1] * 16), (2200, []), (2201, []),
             (2300, [0.5, -0.5]), (2301, [0.5, 0.25]), (-100, [0.0] * 16), (0, rows[0][1]), (7, rows[7][1]), (7, rows[7][1]), (3000, rows[3][1]), (3001, rows[3][1])]
    return rows


@pytest.mark.parametrize("block", [2048, 8])
def test_exact_results(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "CANDIDATES", 200)
    monkeypatch.setattr(topk, "FIRST_LOOK", 4)
    rows = _rows()
    frame = spark.createDataFrame([(i, v, "s", "d") for i, v in rows], SCHEMA)
    got = topk.top_k(frame, F.col("vec_id") % 100 == 0, 10).collect()
    assert sorted(map(tuple, got)) == _plain(rows, 10)


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0 ** 40 * (i + 1) + i, -(2.0 ** 12) * i]) for i in range(30)]
    frame = spark.createDataFrame([(i, v, "s", "d") for i, v in rows], SCHEMA)
    got = sorted(map(tuple, topk.top_k(frame, F.col("vec_id") == 0, 5).collect()))
    top = (1 << 63) - 1
    exact = [(q, r, j, max(-top - 1, min(top, s))) for q, r, j, s in _plain(rows, 30) if q == 0]
    want = sorted((-s, j) for _, _, j, s in exact)[:5]
    assert [(-s, j) for _, _, j, s in got] == want


def test_elimination_skips_candidates(monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(0)
    v = np.concatenate([rnd.normal(c * 200, 5, (400, 8)) for c in range(6)]).astype(np.int64)
    looked = []
    plain = topk._products
    monkeypatch.setattr(topk, "_products", lambda q, x, e: looked.append(len(x)) or plain(q, x, e))
    d = topk._distances(v, v[::400].astype(float))
    block = topk.Block(np.arange(5), np.arange(5), v[:5], d[:5], 10)
    block.look(np.arange(len(v)), v, d)
    assert sum(looked) < 5 * len(v) / 2


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(frame, F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("size", [1e6, 3e6, 1e7, 1e9, 1e12])
def test_long_finite_vectors_keep_the_bound_sound(spark, size):
    rnd = random.Random(int(size) % 97)
    centres = [[rnd.gauss(0, 0.3) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rnd.gauss(0, 0.0008) for c in centres[i % 12]]) for i in range(1, 900)]
    rows += [(1000 + 50 * i, [size * rnd.gauss(0, 1) for _ in range(8)]) for i in range(3)]
    rows = [(i * 25, v) for i, v in rows]
    frame = spark.createDataFrame([(i, v, "s", "d") for i, v in rows], SCHEMA).coalesce(2)
    got = sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 100 == 0, 10).collect()))
    top = (1 << 63) - 1
    assert got == [(q, r, j, max(-top - 1, min(top, s))) for q, r, j, s in _plain(rows, 10)]
