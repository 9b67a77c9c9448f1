"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and
skip-grams.

Features of a text are the 64-bit hashes of its words, word pairs, and pairs
with one or two words skipped (binary). Training runs on a bounded sample of
the labelled rows (``MAX_TRAIN`` rows, chosen by hash), split by hash into
shards; each shard fits its own model with per-coordinate learning rates and
L1 sparsity, and the shards' weights are averaged. The result is a short list
of hashes and weights, at most ``MAX_WEIGHTS``, that is broadcast to score
every text. A fifth of the sample is kept from the shards; on it the averaged
model's margin is calibrated, both classes weighing the same, so that the
threshold does not hang on how far averaging shrinks the weights.

Edge cases: a null text counts as empty and scores by the bias alone; rows
with a null id are scored, never held out, and not trained on; repeated
labels of one id count once (toxic wins); without usable labels of both kinds
every score is the share of toxic labels (0 if there are none); an empty
table gives an empty result; further columns are not read and pass through
``reject``. Texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from basketry.llm.words import HashFilter, odd_multipliers, scramble, slices, word_hashes
from basketry.session import materialize

WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.7
#: Labelled rows that training may read, and rows per shard.
MAX_TRAIN = 12_000
SHARD_ROWS = 2_400
#: One sampled row in so many calibrates instead of training.
CALIBRATE = 5
MAX_WEIGHTS = 1 << 18
EPOCHS = 6
#: FTRL-proximal: learning rate, smoothing, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 0.1
#: A feature must occur in this many of a shard's texts.
MIN_TEXTS = 3
#: Distances of the word pairs: neighbours, one skipped, two skipped.
PAIRS = (1, 2, 3)
_BY = odd_multipliers(2 * len(PAIRS), 4)
BIAS = 0  # the bias is stored as feature 0


def features_at(words: np.ndarray) -> list[np.ndarray]:
    """Feature hashes by kind: words, then pairs at each distance (shorter at the end)."""
    out = [words]
    for n, d in enumerate(PAIRS):
        out.append(scramble(words[:-d] * _BY[2 * n] + words[d:] * _BY[2 * n + 1]) if len(words) > d else words[:0])
    return out


# ---- training ---------------------------------------------------------------

def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``shard, order, y, text`` of at most about ``MAX_TRAIN`` labelled rows;
    shard -1 calibrates."""
    usable = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    usable = materialize(usable, "toxicity-labels")
    n = usable.count()
    shards = max(1, min(MAX_TRAIN, n) * (CALIBRATE - 1) // CALIBRATE // SHARD_ROWS)
    share = 1_000_000 if n <= MAX_TRAIN else MAX_TRAIN * 1_000_000 // n
    sample = materialize(usable.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < share), "toxicity-sample")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The sample is bounded by MAX_TRAIN, so its broadcast is.
    return (rows.join(F.broadcast(sample), "id")
            .select(F.when(F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(CALIBRATE)) == 0, -1)
                    .otherwise(F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards))).cast("int").alias("shard"),
                    F.xxhash64("id", F.lit("order")).alias("order"), "y", "text"))


def ftrl(texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Features (hashes), their weights, and the bias of one shard."""
    rows = [np.unique(np.concatenate(features_at(t))) for t in texts]
    every, times = np.unique(np.concatenate(rows), return_counts=True) if rows else (np.zeros(0, np.uint64), np.zeros(0, int))
    every = every[times >= MIN_TEXTS]
    index = []
    for r in rows:
        k = np.searchsorted(every, r)
        k[k == len(every)] = 0
        index.append((k[every[k] == r] if len(every) else k[:0]) + 1)
    z, n = np.zeros(len(every) + 1), np.zeros(len(every) + 1)  # 0 is the bias

    def weights(zi: np.ndarray, ni: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for k, target in zip(index, y):
            k = np.append(k, 0)
            l1 = np.full(len(k), L1)
            l1[-1] = 0.0
            w = weights(z[k], n[k], l1)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - target
            z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / ALPHA * w
            n[k] += g * g
    w = weights(z, n, np.append(0.0, np.full(len(every), L1)))
    some = np.flatnonzero(w[1:])
    return every[some], w[1:][some], float(w[0])


def calibration(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of y on x, classes weighing the
    same and targets smoothed by their counts."""
    ones, zeros = int((y == 1).sum()), int((y == 0).sum())
    if not ones or not zeros:
        return 1.0, 0.0
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    weight = np.where(y == 1, 0.5 / ones, 0.5 / zeros)
    fit_, rows = np.array([1.0, 0.0]), np.stack([x, np.ones(len(x))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(fit_ @ rows, -500, 500)))
        slope = rows @ (weight * (p - target)) + 1e-6 * fit_
        curve = (rows * (weight * p * (1 - p))) @ rows.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 2 / max(1e-12, float(np.abs(step).max())))
        fit_ = fit_ - step
        if np.abs(step).max() < 1e-9:
            break
    return (float(fit_[0]), float(fit_[1])) if fit_[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> "Model":
    rows = materialize(training_rows(docs, labels, id_col, text_col, label_col), "toxicity-rows")

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["order", "text"], kind="stable")
        keys, w, bias = ftrl([word_hashes(t, WORD) for t in frame["text"]], frame["y"].to_numpy())
        return pd.DataFrame({"feature": np.append(keys.view(np.int64), BIAS), "weight": np.append(w, bias),
                             "toxic": np.append(np.zeros(len(keys), int), int(frame["y"].sum())), "n": np.append(np.zeros(len(keys), int), len(frame))})

    fitted = materialize(rows.where("shard >= 0").groupBy("shard").applyInPandas(shard, "feature bigint, weight double, toxic bigint, n bigint"), "toxicity-shards")
    shards, toxic, n = fitted.where(F.col("n") > 0).agg(F.count(F.lit(1)), F.sum("toxic"), F.sum("n")).first()
    if not n or toxic in (0, n):
        share = (toxic or 0) / n if n else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    mean = (fitted.groupBy("feature").agg((F.sum("weight") / shards).alias("weight"))
            .orderBy(F.desc(F.when(F.col("feature") == BIAS, float("inf")).otherwise(F.abs("weight"))), "feature").limit(MAX_WEIGHTS).collect())
    bias = next((r["weight"] for r in mean if r["feature"] == BIAS), 0.0)
    rest = sorted((r["feature"] & (1 << 64) - 1, r["weight"]) for r in mean if r["feature"] != BIAS)
    model = Model(np.array([k for k, _ in rest], np.uint64), np.array([w for _, w in rest]), bias)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.margin(batch.column(1).to_pylist())), batch.column(0)], ["x", "y"])

    # At most about MAX_TRAIN / CALIBRATE numbers.
    seen = rows.where("shard < 0").select("y", "text").mapInArrow(margins, "x double, y int").orderBy("x", "y").collect()
    model.slope, model.offset = calibration(np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen]))
    return model


# ---- scoring ----------------------------------------------------------------

class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.filter, self.weights, self.bias = HashFilter(keys), weights, bias
        self.slope, self.offset = 1.0, 0.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(texts) + self.offset, -500, 500)))

    def margin(self, texts: list[str | None]) -> np.ndarray:
        words = [word_hashes(t or "", WORD) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        logit = np.full(len(texts), self.bias)
        seen_doc, seen_key = [], []
        for reach, h in zip((0, *PAIRS), features_at(flat)):
            at, key = self.filter.find(h)
            doc = np.searchsorted(ends, at, side="right")
            inside = doc == np.searchsorted(ends, at + reach, side="right")  # pairs end in the same text
            seen_doc.append(doc[inside])
            seen_key.append(key[inside])
        pair = np.unique(np.stack([np.concatenate(seen_doc), np.concatenate(seen_key)], axis=1), axis=0)
        np.add.at(logit, pair[:, 0], self.weights[pair[:, 1]])
        return logit


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()))], ["id", "score"])

    scored = rows.mapInArrow(work, f"id {rows.schema[0].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``THRESHOLD`` or more; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = shared.value.score(batch.column(at).to_pylist()) < THRESHOLD
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(work, docs.schema)
