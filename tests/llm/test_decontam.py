import itertools
import random

import pytest

from basketry.llm import decontam

from .brute import best_overlap, overlap

ITEMS = "item_id long, text string, words string"
DOCS = "doc_id long, text string, item_id int, words int"


def test_masks_hit_every_qualifying_window():
    def hit(n, bad):
        return any(not any((b - at) in m for b in bad) for m in decontam.MASKS for at in range(n - m[-1]))

    assert all(hit(13, bad) for bad in itertools.combinations(range(13), 2))
    assert all(hit(8, (b,)) for b in range(8))


def _tables(spark):
    rnd = random.Random(3)
    vocabulary = [f"wort{i}" for i in range(60)]
    passage = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(passage(n))) for i, n in enumerate([40, 25, 13, 12, 8, 7, 60])]
    items += [(20, None), (21, ""), (0, items[0][1]), (None, " ".join(passage(20)))]
    docs = [(0, None), (1, ""), (2, "short"), (None, " ".join(passage(30)) + " " + items[1][1])]
    for n, (_, text) in enumerate(items):
        w = (text or "").split()
        if not w:
            continue
        for k in (0, 1, 2, 3, 6):
            c = list(w)
            for at in rnd.sample(range(len(c)), min(k, len(c))):
                c[at] = "other"
            docs.append((100 + 10 * n + k, " ".join(passage(20)) + ". " + ", ".join(x.upper() for x in c) + "! " + " ".join(passage(20))))
        docs.append((100 + 10 * n + 9, " ".join(passage(5) + w[: len(w) // 2] + passage(1) + w[len(w) // 2:])))
    docs += [(500 + i, " ".join(passage(200))) for i in range(20)]
    docs += [(600, "pad " * 30_000 + items[6][1] + " pad" * 30_000), (600, items[6][1]), (600, items[6][1])]
    return spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS), spark.createDataFrame([(i, t, 1, 2) for i, t in docs], DOCS), items, docs


def _want(items, docs):
    return {(d, i) for d, t in docs for i, x in items if overlap(t, x)}


def test_matches_brute_force(spark):
    bench, frame, items, docs = _tables(spark)
    got = decontam.contaminated(frame, bench).collect()
    want = _want(items, docs)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert len(want) > 20 and all(r["n_equal"] <= r["n_words"] for r in got)
    kept = decontam.clean(frame, bench)
    bad = {(d, t) for d, t in docs if any(overlap(t, x) for _, x in items)}
    assert kept.schema.names == frame.schema.names
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == sorted((d or -1, t or "") for d, t in docs if (d, t) not in bad)


def _best(items, docs):
    out = {}
    for d, t in docs:
        for i, x in items:
            best = best_overlap(t, x)
            if best and ((d, i) not in out or (best[0], best[1], -best[2]) > (out[d, i][0], out[d, i][1], -out[d, i][2])):
                out[d, i] = best
    return out


@pytest.mark.parametrize("filtered", [True, False])
@pytest.mark.parametrize("hits", [decontam.PIECE_HITS, 7])
def test_overlaps_are_whole(spark, monkeypatch, filtered, hits):
    """Sizes and starts of overlaps of any length, in pieces of any length,
    with the filter and without."""
    rnd = random.Random(12)
    word = lambda: f"w{rnd.randrange(4000)}"
    items, docs = [], []
    for i, n in enumerate((1, 2, 7, 8, 12, 13, 40, 900, 2500)):
        w = [word() for _ in range(n)]
        items.append((i, " ".join(w)))
        docs.append((10 * i, " ".join([word() for _ in range(30)] + w + [word() for _ in range(30)])))
        c = list(w)
        for at in range(6, n, 20):
            c[at] = "changed"
        docs.append((10 * i + 1, " ".join(c)))
        c = list(w)
        c[n // 3:n // 3 + n // 8] = ["gap"] * (n // 8)  # two runs on one line
        docs.append((10 * i + 2, " ".join(["x"] * 5 + c)))
        docs.append((10 * i + 3, " ".join(w[: n // 2] + ["more"] + w[n // 2:] + w[n // 4:])))
    items.append((50, "again and " * 12))
    docs += [(500, "again and " * 30), (None, items[7][1][:3000])]
    if not filtered:
        monkeypatch.setattr(decontam, "MAX_FILTER", 0)
        docs = [d for d in docs if d[0] is None or d[0] not in range(80, 90)]
    monkeypatch.setattr(decontam, "PIECE_HITS", hits)
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], DOCS)
    got = decontam.contaminated(frame, spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_equal"], r["n_words"], r["start_word"]) for r in got} == _best(items, docs)
    if filtered:
        assert {r["n_words"] for r in got} >= {900, 2500, 13, 1}


def test_empty_tables(spark):
    bench, frame, _, _ = _tables(spark)
    assert decontam.contaminated(frame.limit(0), bench).count() == 0
    assert decontam.contaminated(frame, bench.limit(0)).count() == 0
    assert decontam.clean(frame, bench.limit(0)).count() == frame.count()


def test_short_and_unspaced_items_match_exactly(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from basketry.llm import queries

    items = [(1, "What is the capital of France?"), (2, "日本の首都はどこですか"), (3, "东京在哪里"), (4, "..."), (5, "Paris"), (6, None)]
    docs = [(10, "Quiz: what is THE capital of France, then?"), (11, "what is the main capital of France"), (12, "昔、日本の首都はどこですかと聞かれた"),
            (13, "日本の首都はここですか"), (14, "请问东京在哪里呢"), (15, "东京在那里"), (16, "in Paris, in paris"), (17, None), (18, "France is the capital of what"),
            (None, "paris"), (19, "capital of France"), (20, "日本の都はここでした")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(10, 1), (12, 2), (13, 2), (14, 3), (16, 5), (None, 5)}
    for most in (decontam.MAX_FILTER, 2):
        monkeypatch.setattr(decontam, "MAX_FILTER", most)
        got = queries.op2_decontamination(spark, str(tmp_path)).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
        assert {r["item_id"]: (r["n_equal"], r["n_words"], r["start_word"]) for r in got if r["doc_id"] in (10, 12, 14, 16)} == {
            1: (6, 6, 1), 2: (11, 11, 1), 3: (5, 5, 2), 5: (1, 1, 1)}
    kept = corpus_pipeline.drop_contaminated(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert {r["doc_id"] for r in kept} == {11, 15, 17, 18, 19, 20}
