import random
import zlib

from basketry.llm import toxicity

DOCS = "doc_id long, text string, score double, y int"
LABELS = "doc_id long, toxic int, text string"


def _tables(spark, n=1000):
    rnd = random.Random(4)
    words, bad = [f"w{i}x".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(500)], ["vile", "grim", "foul", "rank"]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(5, 120))]
        toxic = i % 4 == 0
        for _ in range(rnd.randint(2, 5) if toxic else 0):
            w.insert(rnd.randrange(len(w) + 1), rnd.choice(bad) + rnd.choice(["", "!", ",", "***"]))
        docs.append((i, " ".join(w), 0.0, 1))
        labels.append((i, int(toxic), "t"))
    docs += [(n, None, 0.0, 1), (n + 1, "", 0.0, 1), (None, "vile foul grim", 0.0, 1), (n + 2, "w " * 60_000, 0.0, 1), (0, docs[0][1], 0.0, 1)]
    labels += [(0, 0, "again"), (None, 1, "n"), (n + 1, None, "n")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(spark):
    docs, labels = _tables(spark)
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 1000]
    caught = sum(r["predicted"] == 1 for r in held if r["doc_id"] % 4 == 0)
    assert caught >= 0.9 * sum(r["doc_id"] % 4 == 0 for r in held)
    assert sum(r["predicted"] == 1 for r in held if r["doc_id"] % 4) <= 0.02 * len(held)
    assert [r["predicted"] for r in rows if r["doc_id"] is None] == [1]
    kept = toxicity.reject(docs, toxicity.fit(docs, labels))
    assert kept.schema.names == docs.schema.names
    assert kept.count() == sum(r["predicted"] == 0 for r in rows)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = _tables(spark, 200)
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    score = lambda ls: sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.score(docs, toxicity.fit(docs, ls)).collect())
    assert score(labels) == score(other)


def test_without_usable_labels(spark):
    docs, labels = _tables(spark, 60)
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0}
    none_toxic = toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).collect()
    assert max(r["score"] for r in none_toxic) < 1e-6
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).count() == 0
