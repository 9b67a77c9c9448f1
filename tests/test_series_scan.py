"""Chained exponential means over blocks, against a plain loop."""

import numpy as np
import pytest

from basketry.operators.series import chained_ema


def _loop(values, n, k):
    out, head, s = [], [], None
    for v in values:
        if v is not None and s is None:
            head.append(v)
            if len(head) == n:
                s = sum(head) / n
                out.append(s)
                continue
        elif v is not None:
            s = k * v + (1 - k) * s
        out.append(s if v is not None else None)
    return out


@pytest.mark.parametrize("block", [1, 7, 256])
def test_blocks_equal_one_long_fold(spark, block):
    rng = np.random.default_rng(4)
    series = {"long": [float(x) for x in rng.normal(size=400)], "gaps": [None if i % 5 in (0, 1) else float(x) for i, x in enumerate(rng.normal(50, 9, size=300))],
              "short": [1.0, 2.0, 3.0], "empty": [None, None], None: [float(x) for x in rng.normal(size=40)]}
    rows = [(s, i, v, "x") for s, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "symbol string, dt int, `v-1` double, _further string").repartition(5)
    got = chained_ema(df, "v-1", 3, 0.4, ["a", "b", "c"], block=block)
    assert got.columns == [*df.columns, "a", "b", "c"]
    rows = got.collect()
    for s, vs in series.items():
        own = sorted((r for r in rows if r["symbol"] == s), key=lambda r: r["dt"])
        assert [r["v-1"] for r in own] == vs
        want = vs
        for name in ("a", "b", "c"):
            want = _loop(want, 3, 0.4)
            have = [r[name] for r in own]
            assert [x is None for x in have] == [x is None for x in want]
            assert np.allclose([x for x in have if x is not None], [x for x in want if x is not None], rtol=1e-10, atol=1e-12)


def test_empty_series(spark):
    df = spark.createDataFrame([], "symbol string, dt int, v double")
    assert chained_ema(df, "v", 3, 0.4, ["a"]).count() == 0
