import collections
import random

import pytest
from pyspark.sql import functions as F

from basketry.llm import mixing

from .brute import mix_targets, multiplier

SCHEMA = "doc_id long, text string, source string, size int, copies string"


def _docs(spark, seed=1, n=700):
    rnd = random.Random(seed)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 20, 20, 80, 900])) + "\n", rnd.choice(["a", "b", "b", "b", "c", "é", None, "Z"]), 0, "c") for i in range(n)]
    rows += [(None, "x y", "a", 0, "c"), (5000, None, "only-null", 0, "c"), (5001, "\t \x0b", "only-null", 0, "c"), (7, "r r r", "b", 0, "c"), (7, "r r r", "b", 0, "c"),
             (8000, "long " * 30_000, "c", 0, "c")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_targets_rates_and_copies(spark):
    docs, rows = _docs(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split(None))
    by = collections.defaultdict(list)
    for _, t, s, *_ in rows:
        by[s].append(size(t))
    want = mix_targets({s: sum(x) for s, x in by.items()})
    for s, sizes in by.items():
        own = [r for r in got if r["source"] == s]
        assert sorted(r["size"] for r in own) == sorted(sizes)
        assert {r["source_size"] for r in own} == {sum(sizes)}
        assert all(r["target"] == pytest.approx(want[s], rel=1e-9, abs=1e-9) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(sizes)
        if 0 < want[s] < 2 * sum(sizes) * (1 - 1e-9):
            lam, mean = multiplier(sizes, want[s]), max(1.0, sum(sizes) / len(sizes))
            lam *= mean / (sum(sizes) / len(sizes))
            for r in own:
                assert r["rate"] == pytest.approx(2 / (1 + 2.718281828459045 ** (-lam * r["size"] / mean)), abs=1e-6)
    assert all(0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] for r in got)
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda rs: sorted(str(tuple(r)) for r in rs)
    assert key(got) == key(again)


def test_expansion_repeats_rows(spark):
    docs, _ = _docs(spark, 2, 200)
    docs = docs.withColumnRenamed("copies", "copy_no")
    out = mixing.expand(docs)
    assert out.columns == [*docs.columns, "_copy_no"]
    taken = collections.Counter((r["doc_id"], r["source"]) for r in out.collect())
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    assert taken == +want


def test_caps_fill_like_resharing(spark):
    for sizes in ({"a": 100, "b": 1, "c": 1}, {"a": 1, "b": 100, "c": 1, "d": 50}, {"a": 0, "b": 3, None: 2}, {"a": 5}):
        rows = [(i, "w " * n, s, 0, "") for i, (s, n) in enumerate(sizes.items())]
        sized = spark.createDataFrame(rows, SCHEMA).select("source", mixing.word_count(F.col("text")).alias("size"))
        got = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
        assert got == pytest.approx(mix_targets(sizes))


def test_empty_table(spark):
    docs, _ = _docs(spark, 1, 5)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.expand(docs.limit(0)).count() == 0


def test_an_unsolved_dual_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NEWTON_STEPS", 1)
    with pytest.raises(RuntimeError):
        mixing.mix(_docs(spark)[0]).collect()
