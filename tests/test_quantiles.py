"""Quantiles by brackets equal those of sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from basketry.functions.quantiles import quantiles

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.98, 1.0]


def _plain(values, q):
    values = sorted(values)
    p = q * (len(values) - 1)
    a, b = math.floor(p), math.ceil(p)
    return values[a] if a == b else (b - p) * values[a] + (p - a) * values[b]


@pytest.mark.parametrize("limit", [10_000, 3])
def test_groups_of_any_shape(spark, limit):
    rnd = random.Random(6)
    groups = {"even": [float(i) for i in range(700)], "skewed": [math.exp(rnd.gauss(0, 12)) for _ in range(600)], "ties": [rnd.choice([1.0, 2.0, 9.5]) for _ in range(300)],
              "one": [4.0], "same": [7.0] * 50, "signs": [rnd.uniform(-1e-9, 1e-9) for _ in range(200)] + [-1e18, 1e18], None: [3.0, 1.0, 2.0, 8.0, 5.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    names = [f"q{i}" for i in range(len(QS))]
    got = {r["g"]: r for r in quantiles(df, F.col("v"), ["g"], QS, names, limit, 8).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert [got[g][n] for n in names] == pytest.approx([_plain(vs, q) for q in QS], rel=1e-12), g
    every = [v for vs in groups.values() for v in vs]
    whole = quantiles(df, F.col("v"), [], QS, names, limit, 8).collect()
    assert len(whole) == 1 and list(whole[0]) == pytest.approx([_plain(every, q) for q in QS], rel=1e-12)
    assert quantiles(df.limit(0), F.col("v"), ["g"], QS, names, limit).count() == 0
