import random

import pytest

from basketry.llm import simhash
from basketry.session import materialize

from .brute import component_ids, fingerprint


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, fp int, component string")


def _check(spark, rows):
    got = simhash.near_duplicates(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = [fingerprint(t) for _, t in rows]
    want = sorted((i is None, i or 0, f, c is None, c or 0) for (i, _), f, c in zip(rows, prints, component_ids([i for i, _ in rows], prints)))
    assert sorted((r["id"] is None, r["id"] or 0, r["fp"] & (1 << 64) - 1, r["component"] is None, r["component"] or 0) for r in got) == want


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks()
    rnd = random.Random(5)
    assert len(masks) == 31
    for _ in range(20_000):
        flip = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(m & flip == 0 for m in masks)


def test_fingerprints_and_components(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "ONE two"), (5, "É É é e f"), (None, "one two"), (7, "x" * 50_000), (7, "x" * 50_000)]
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((10 + i, " ".join(w)))
    rows += [(100 + i, " ".join(rnd.choice(words) for _ in range(50))) for i in range(40)]
    rows.append((200, " ".join(rnd.choice(words) for _ in range(70_000))))
    _check(spark, rows)


@pytest.mark.parametrize("bucket", [2, 5])
def test_large_buckets_go_over_midpoints(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(2)
    prints = {sum(1 << b for b in rnd.sample(range(20), rnd.randint(0, 5))) for _ in range(60)} | {rnd.getrandbits(64) for _ in range(40)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    roots = {r["fp"] & (1 << 64) - 1: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    group = component_ids(list(range(len(prints))), prints)
    for i, a in enumerate(prints):
        for j, b in enumerate(prints):
            same = i == j or (roots.get(a) is not None and roots.get(a) == roots.get(b))
            assert same == (group[i] == group[j])


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d e"), (1, "A b c d e"), (1, "A b c d e"), (None, "a b c d E"), (9, "z y x w v"), (None, "only here now"), (None, "only here now"), (5, None), (4, "")]
    docs = _docs(spark, rows)
    out = simhash.keep_one(docs)
    assert out.schema.names == docs.schema.names
    assert sorted((r["doc_id"] or -1, r["text"]) for r in out.collect()) == [(-1, "only here now"), (1, "A b c d e"), (4, ""), (9, "z y x w v")]


def test_empty_table(spark):
    assert simhash.near_duplicates(_docs(spark, [(1, "a")]).limit(0)).count() == 0
    assert simhash.keep_one(_docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_no_table_is_gathered_to_be_broadcast(spark, monkeypatch):
    """Every join names the shuffle: no size, guessed or measured, makes it a broadcast."""
    plans = []

    def written(df, *args):
        plans.append(df)
        return materialize(df, *args)
    monkeypatch.setattr(simhash, "materialize", written)
    rows = [(i, f"a b c d e{i // 3}") for i in range(30)]
    plans.append(simhash.keep_one(_docs(spark, rows)))
    joins = [line for df in plans for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(joins) >= 8 and all("strategy=merge" in line for line in joins)
