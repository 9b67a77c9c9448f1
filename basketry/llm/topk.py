"""Exact top-k search by inner product with pivot-table elimination.

Vectors are scaled to integers, ``floor(SCALE * x)``, and every vector's
distances to many pivots are computed once and written beside it. For a query
q and a candidate x the triangle inequality gives a lower bound on their
distance from each pivot, the greatest of which is

    d(q, x) >= max over pivots p of |d(q, p) - d(x, p)|,

and so an upper bound on the inner product ``(|q|^2 + |x|^2 - d^2) / 2``.
Distances are doubles, and every gap is lowered by the rounding error of its
own two distances before the greatest is taken, so that the bound also holds
beside vectors that are many orders of magnitude longer than the others.
Each task looks at its candidates in the order of that bound and stops, for
every query, once the k-th score found is above the next bound; what it has
not evaluated cannot be among the k best. Scores themselves are exact.

Queries go over the table in blocks of bounded size, each a broadcast with a
proven bound; tasks return k rows per query, and a window merges them.

Edge cases: rows without an id, without a vector, or whose vector holds a
null or non-finite component take no part; vectors meet only vectors of their
own length; repeated query rows (same id and vector) are one query, repeated
candidate rows each take a place; candidates with the query's own id are left
out; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.session import materialize

SCALE = 1024
PIVOTS = 16
#: Rows from which the pivots are chosen (farthest first).
PIVOT_SAMPLE = 1024
QUERY_BLOCK = 2048
#: Candidates bounded at a time by a task.
CANDIDATES = 1024
FIRST_LOOK = 64

TABLE = "vec_id bigint, dims int, vec binary, dist binary"
FOUND = "query_id bigint, query_no int, vec_id bigint, score bigint"


def usable(vec: Column) -> Column:
    """Whether a vector has only finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vec.isNotNull() & F.forall(vec, fine)


def scaled(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, vec``: usable rows with integer components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).where("vec_id IS NOT NULL")
    return rows.where(usable(F.col("vec"))).select("vec_id", F.transform("vec", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("vec"))


def choose_pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, far-apart pivots out of a bounded sample (by hash of the id)."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    by_dims: dict[int, list] = {}
    for r in sample:
        by_dims.setdefault(len(r["vec"]), []).append(r["vec"])
    out = {}
    for dims, vecs in by_dims.items():
        v = np.array(vecs, np.float64).reshape(len(vecs), dims)
        chosen = [0]
        near = np.sqrt(((v - v[0]) ** 2).sum(1))
        while len(chosen) < min(PIVOTS, len(v)):
            chosen.append(int(near.argmax()))
            near = np.minimum(near, np.sqrt(((v - v[chosen[-1]]) ** 2).sum(1)))
        out[dims] = v[chosen]
    return out


def _distances(v: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    if pivots is None:  # a length that the sample does not hold: no bound
        return np.zeros((len(v), 0))
    return np.sqrt(((v[:, None, :].astype(np.float64) - pivots[None]) ** 2).sum(2))


def _rounding(dims: int) -> float:
    """A bound on the relative rounding error of a sum of ``dims`` squares."""
    return (dims + 8) * 2.0 ** -52


def _error(dist: np.ndarray, norm: np.ndarray, dims: int) -> np.ndarray:
    """How far each distance may be off: components lose bits of their own
    size and of the pivot's, which is at most the distance and the norm."""
    return 2 * _rounding(dims) * (dist + np.sqrt(norm)[:, None])


def pivot_table(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Every vector with its distances to the pivots, written once."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = batch.column(0), batch.column(1)
            sizes = vecs.value_lengths().to_numpy(zero_copy_only=False)
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                v = flat[(ends[at] - dims)[:, None] + np.arange(dims)[None]].reshape(len(at), int(dims))
                for lo in range(0, len(at), CANDIDATES):
                    part = v[lo:lo + CANDIDATES]
                    d = _distances(part, pivots.get(int(dims)))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at[lo:lo + CANDIDATES])), pa.array(np.full(len(part), dims, np.int32)),
                         pa.array([x.tobytes() for x in part], pa.binary()), pa.array([x.tobytes() for x in d], pa.binary())],
                        ["vec_id", "dims", "vec", "dist"])

    return materialize(rows.mapInArrow(work, TABLE), "topk-pivots")


def _matrix(column, dims: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1) if len(column) and column[0] else np.zeros((len(column), dims), dtype)


def _products(q: np.ndarray, x: np.ndarray, exact_float: bool) -> np.ndarray:
    """Exact integer inner products of one query with many candidates."""
    if exact_float:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    p = [sum(a * b for a, b in zip(q.tolist(), row)) for row in x.tolist()]
    return np.clip(np.array(p, object), -(1 << 63), (1 << 63) - 1).astype(np.int64) if p else np.zeros(0, np.int64)


class Block:
    """A block of queries of one length, and the best found for them so far."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, vecs: np.ndarray, dist: np.ndarray, k: int):
        self.ids, self.numbers, self.vecs, self.dist, self.k = ids, numbers, vecs, dist, k
        self.norm = (vecs.astype(np.float64) ** 2).sum(1)
        self.error = _error(dist, self.norm, vecs.shape[1])
        self.top = max(1.0, float(np.abs(vecs).max(initial=0)))
        self.scores = [np.zeros(0, np.int64) for _ in ids]
        self.found = [np.zeros(0, np.int64) for _ in ids]

    def look(self, ids: np.ndarray, vecs: np.ndarray, dist: np.ndarray) -> None:
        """Bring some candidates in."""
        norm = (vecs.astype(np.float64) ** 2).sum(1)
        exact = self.top * max(1.0, float(np.abs(vecs).max(initial=0))) * max(1, vecs.shape[1]) < 2.0 ** 53
        error = _error(dist, norm, vecs.shape[1])
        gap = np.zeros((len(self.ids), len(ids)))
        for p in range(min(dist.shape[1], self.dist.shape[1])):
            own = np.abs(self.dist[:, p, None] - dist[None, :, p])
            own -= self.error[:, p, None] + error[None, :, p]
            np.maximum(gap, own, out=gap)
        both = self.norm[:, None] + norm[None]
        # The slack covers the rounding of the norms and of this line.
        bound = (both - np.square(gap)) / 2 + 1 + 8 * _rounding(vecs.shape[1]) * both
        bound[self.ids[:, None] == ids[None]] = -np.inf
        for i in range(len(self.ids)):
            full = len(self.scores[i]) == self.k
            may = np.flatnonzero(bound[i] >= (self.scores[i][-1] if full else -1.7e308))
            order = may[np.argsort(-bound[i][may], kind="stable")]
            done, width = 0, FIRST_LOOK
            while done < len(order):
                if len(self.scores[i]) == self.k and bound[i][order[done]] < self.scores[i][-1]:
                    break  # no later candidate can reach the k-th score
                part = order[done:done + width]
                s = np.concatenate([self.scores[i], _products(self.vecs[i], vecs[part], exact)])
                n = np.concatenate([self.found[i], ids[part]])
                best = np.lexsort((n, -s.astype(object) if not exact else -s))[: self.k]
                self.scores[i], self.found[i] = s[best], n[best]
                done, width = done + width, width * 2

    def rows(self) -> pa.RecordBatch:
        size = [len(s) for s in self.scores]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, size)), pa.array(np.repeat(self.numbers, size).astype(np.int32)),
             pa.array(np.concatenate(self.found)), pa.array(np.concatenate(self.scores))],
            ["query_id", "query_no", "vec_id", "score"])


def _search(table: DataFrame, queries: list, k: int) -> DataFrame:
    """Each task's k best candidates for every query of a block."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = {}
        for dims in {q["dims"] for q in queries}:
            own = [(n, q) for n, q in enumerate(queries) if q["dims"] == dims]
            blocks[dims] = Block(np.array([q["vec_id"] for _, q in own], np.int64), np.array([n for n, _ in own]),
                                 _matrix([bytes(q["vec"]) for _, q in own], dims, np.int64),
                                 _matrix([bytes(q["dist"]) for _, q in own], 0, np.float64), k)
        for batch in batches:
            dims_of = batch.column(1).to_numpy()
            for dims, block in blocks.items():
                at = np.flatnonzero(dims_of == dims)
                for lo in range(0, len(at), CANDIDATES):
                    part = batch.take(pa.array(at[lo:lo + CANDIDATES]))
                    block.look(part.column(0).to_numpy(), _matrix(part.column(2).to_pylist(), dims, np.int64),
                               _matrix(part.column(3).to_pylist(), 0, np.float64))
        for block in blocks.values():
            yield block.rows()

    return table.mapInArrow(work, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of every
    query (the rows for which ``is_query``, over ``vec_id``, holds)."""
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, vec_col)
    table = pivot_table(rows, choose_pivots(rows))
    queries = table.where(is_query).distinct()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    fullest = lambda: queries.groupBy(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks))).count().agg(F.max("count")).first()[0]
    while blocks > 1 and fullest() > QUERY_BLOCK:
        blocks *= 2
    if blocks > 1:
        queries = materialize(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks))), "topk-queries")
    parts = []
    for b in range(blocks):
        own = (queries.where(F.col("block") == b).drop("block") if blocks > 1 else queries).collect()
        own.sort(key=lambda q: (q["vec_id"], bytes(q["vec"])))
        best = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
        found = _search(table, own, k) if own else spark.createDataFrame([], FOUND)
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(ranked if blocks == 1 else materialize(ranked, "topk-found"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The ten best of every query over ``embeddings`` in DuckDB SQL.
ORACLE_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
