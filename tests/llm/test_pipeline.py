import os
import random

import pytest

from basketry.llm import mixing, pii, toxicity

from .brute import base_spans, component_ids, fingerprint, mix_targets, overlap

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(11)
    words, bad = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(900)], ["vile", "grim", "foul", "rank"]
    passage = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, " ".join(passage(30))) for i in range(6)]
    rows, labels = [], []
    for i in range(420):
        w = passage(rnd.randint(10, 150))
        if i % 5 == 0:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        if i % 17 == 1:
            w += rnd.choice(items)[1].split()
        if i % 13 == 2:
            w.insert(3, rnd.choice(["a.b@c.org", "10.1.2.3", "4111111111111111", "+49 (30) 123456"]))
        rows.append((i, " ".join(w), rnd.choice(["en", None]), rnd.choice(["s0", "s0", "s1", "s2", None])))
        labels.append((i, int(i % 5 == 0)))
    for i in range(40):
        rows.append((1000 + i, rows[i * 3 + 1][1] + ("" if i % 2 else " "), "en", "s1"))
    rows += [(2000, None, "en", "s0"), (2001, "", None, None), (None, "odd one out here", "en", "s2"), (3, rows[3][1], "en", "s0")]
    rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(os.path.join(folder, "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    return folder, rows, items


def test_stages_equal_brute_force(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    key = lambda rs: sorted((r[0] is None, r[0] or 0, r[1] or "", str(r[2:])) for r in rs)

    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = model.score([r[1] for r in rows])
    clean = [r for r, s in zip(rows, score) if s < toxicity.THRESHOLD]
    assert sum(r[0] is not None and r[0] < 420 and r[0] % 5 == 0 for r in clean) < 10 and len(clean) > 330
    out = stage["toxicity"](spark, docs, folder)
    assert out.columns == docs.columns and key(out.collect()) == key(clean)

    prints = [fingerprint(r[1]) for r in clean]
    group = component_ids(list(range(len(clean))), prints)
    best = {}
    for r, g in zip(clean, group):
        order = (r[0] is None, r[0] or 0)
        if g not in best or order < best[g][0]:
            best[g] = (order, r)
    single = [r for _, r in best.values()]
    out = stage["simhash_near_dedup"](spark, spark.createDataFrame(clean, SCHEMA), folder)
    assert out.columns == docs.columns
    assert sorted((r[0] is None, r[0] or 0) for r in out.collect()) == sorted((r[0] is None, r[0] or 0) for r in single)

    fresh = [r for r in single if not any(overlap(r[1], t) for _, t in items)]
    out = stage["benchmark_decontamination"](spark, spark.createDataFrame(single, SCHEMA), folder)
    assert out.columns == docs.columns and key(out.collect()) == key(fresh) and len(fresh) < len(single)

    out = stage["pii"](spark, spark.createDataFrame(fresh, SCHEMA), folder)
    assert out.columns == docs.columns
    masked = [tuple(r) for r in out.collect()]
    assert len(masked) == len(fresh) and not any(base_spans(r[1]) for r in masked) and any("[EMAIL]" in (r[1] or "") for r in masked)
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in masked)

    out = stage["mixing"](spark, spark.createDataFrame(masked, SCHEMA), folder).collect()
    size = lambda t: len((t or "").split())
    sums, most = {}, {}
    for r in masked:
        sums[r[3]] = sums.get(r[3], 0) + size(r[1])
        most[r[3]] = max(most.get(r[3], 0), size(r[1]))
    for s, target in mix_targets(sums).items():
        assert abs(sum(size(r["text"]) for r in out if r["source"] == s) - target) <= most[s]


def test_run_and_empty_documents(spark, tables, tmp_path):
    folder, rows, _ = tables
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy_no"]
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len([r for r in out.collect()]) and max(ids.count(i) for i in set(ids)) <= 2
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert pii.KINDS[:4] == pii.BASE_KINDS and mixing.MOST == 2
