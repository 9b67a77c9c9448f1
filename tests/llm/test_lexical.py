import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from basketry.llm import lexical

SCHEMA = "doc_id long, text string, item_id string, score string"


def _terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _plain(docs, items, k=20):
    bags = [(i, Counter(w), len(w)) for i, w in ((i, _terms(t)) for i, t in docs) if w]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, tf, _ in bags for t in tf)
    out = []
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    for item, text in set(items):
        scored, times = [], [(t, k) for t, k in Counter(_terms(text)).items() if t in df]
        for doc, tf, size in bags:
            m = 75 + 25 * size * n // total
            s = sum(k * weight[t] * (10 ** 9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, k in times if t in tf)
            scored.append((-s, doc is None, doc, s))
        best = sorted(x for x in scored if x[3] > 0)[:k]
        out += [(item, r + 1, doc, s) for r, (_, _, doc, s) in enumerate(best)]
    return sorted(out, key=str)


def _tables():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeéß漢1") for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    pick = lambda n: " ".join(rnd.choice(words[:int(3 + 297 * rnd.random() ** 3)]) for _ in range(n))
    docs = [(i, pick(rnd.randint(1, 200)).upper() if i % 7 == 0 else pick(rnd.randint(1, 200))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)] + [(5, docs[5][1])] * 3 + [(None, docs[6][1]), (None, "a b c d e é"), (2000, None), (2001, ""), (2002, " ,;\x00\n"),
                                                           (2003, " ".join(f"w{i}" for i in range(30_000)) + " abc"), (2004, "z" * 200_000)]
    items = [(f"i{i}", pick(rnd.randint(1, 40))) for i in range(30)]
    items += [("i1", items[1][1]), ("i2", "a a a b"), (None, "a"), ("none", None), ("empty", ""), ("unknown", "qqqqqq"), ("copies", docs[5][1]), ("long", docs[-2][1]), ("run", "Z" * 200_000)]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, full signatures, many blocks of queries, a map that lets everything by
        for name, value in {"BLOCK_TERMS": 400, "MAP_BITS": 64}.items():
            monkeypatch.setattr(lexical, name, value)
    docs, items = _tables()
    if small:  # an item of more terms than a block would make a block of every other item
        items = [i for i in items if i[0] != "long"]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA).repartition(3)
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int")
    got = lexical.search(lexical.build_index(frame, **{"block_rows": 16, "max_width": 1 << 9} if small else {}), frame, queries).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == _plain(docs, items)


def test_bounds_hold_and_exclude(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PAIRS", 32)
    docs, items = _tables()
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    weighed = lexical.item_terms(spark.createDataFrame(items[:30], "item_id string, text string")).join(index.frequencies, "term")
    q = lexical.Queries(weighed.collect(), index.n_docs, index.n_terms)
    weights, texts, pairs, close = q.weights(), dict(docs[:400]), 0, 0
    for row in index.blocks.collect():
        bits = np.frombuffer(row["bits"], np.uint8).reshape(row["width"], -1)
        bound = q.bounds(row["width"], np.array(row["sizes"]), bits)
        for r, doc in enumerate(row["ids"]):
            if doc is None or doc >= 400:
                continue
            words = _terms(texts[doc])
            m, tf = 75 + 25 * len(words) * index.n_docs // index.n_terms, Counter(t.encode() for t in words)
            for i, own in enumerate(weights):
                s = sum(w * (10 ** 9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, w in own if t in tf)
                assert bound[i, r] >= s
                pairs, close = pairs + 1, close + (bound[i, r] <= 1.25 * s + 1)
    assert close > 0.8 * pairs


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", "b")], "item_id string, text string")
    assert lexical.search(lexical.build_index(docs), docs, items).count() == 0
    some = spark.createDataFrame([(1, "b", "", "")], SCHEMA)
    assert lexical.search(lexical.build_index(some), some, items.limit(0)).count() == 0
    assert [tuple(r)[2:] for r in lexical.search(lexical.build_index(some), some, items).collect()] == [(1, 1, 287 * (10 ** 9 // (1000 + 1200)))]
