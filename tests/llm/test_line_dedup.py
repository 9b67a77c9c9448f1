import random
from collections import Counter

import numpy as np
import pytest

from basketry.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, kept string, n long"
BLANK = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def _frequent(texts, least):
    n = Counter(k for t in texts for k in {_key(x) for x in (t or "").split("\n")} if k)
    return {k for k, c in n.items() if c >= least}


def _plain(texts, frequent):
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if _key(x) not in frequent]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def _texts(n=300, seed=4):
    rnd = random.Random(seed)
    common = ["Share this page", " share THIS page\t", "Éa all rights reserved", "éa all rights reserved", "\x0b", "  ", "", "x", " x"] + [f"menu {i}" for i in range(40)]
    out = []
    for i in range(n):
        out.append("\n".join(rnd.choice(common) if rnd.random() < 0.5 else f"line {rnd.randrange(10 ** 6)}" for _ in range(rnd.randint(0, 12))))
    return out + [None, "", "\n", "same\r\nsame", "x" * 300_000 + "\nmenu 1\n" * 5000]


def _frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i if i % 50 else None, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)


def _got(frame):
    return sorted((r["text"] or "", r["n_lines"], r["n_dropped"], r["kept"]) for r in frame.collect())


def _want(texts, frequent):
    return sorted((t or "", *p) for t, p in zip(texts, _plain(texts, frequent)))


def test_equals_brute_force_on_both_ways(spark, monkeypatch):
    texts = _texts()
    docs = _frame(spark, texts + texts[:30])
    want = _want(texts + texts[:30], _frequent(texts + texts[:30], 10))
    out = ld.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "n", "n_lines", "n_dropped", "kept"]
    assert _got(out) == want
    monkeypatch.setattr(ld, "MAX_SENT", 0)
    assert _got(ld.dedup_lines(docs)) == want


def test_insertions_and_deletions_are_reversible(spark):
    a, b, c = _texts(120, 1), _texts(90, 2), _texts(60, 3)
    frames = {n: _frame(spark, t) for n, t in zip("abc", (a, b, c))}
    state = ld.insert(ld.empty_state(spark, 6, 2, 6, 4), frames["a"])
    one = {bytes(r["key"]): r["n"] for r in state.refs.collect()}
    more = ld.insert(ld.insert(state, frames["b"]), frames["c"])
    less = ld.delete(more, frames["a"])
    back = ld.delete(ld.delete(more, frames["b"]), frames["c"])
    assert more.shards > 2
    assert {bytes(r["key"]): r["n"] for r in back.refs.collect()} == one
    for s, texts in ((state, a), (more, a + b + c), (less, b + c), (back, a)):
        frequent = _frequent(texts, 6)
        filled = ld._sent_filters(s)
        assert filled.claims(ld._as_hashes(ld.key_hash(k.encode()) for k in frequent)).all()
        held = sum(int((np.frombuffer(t, np.uint16) > 0).sum()) for r in s.filters.collect() for t in r["tables"])
        assert held == len(frequent)
        # documents that were counted, and others
        assert _got(ld.apply(s, frames["a"])) == _want(a, frequent)
        assert _got(ld.apply(s, frames["c"])) == _want(c, frequent)
    with pytest.raises(ValueError):
        ld.delete(back, frames["c"])


@pytest.mark.parametrize("few", [False, True])
def test_false_claims_are_denied(spark, monkeypatch, few):
    if few:
        monkeypatch.setattr(ld, "MAX_DENIED", 0)
    texts = ["\n".join(f"common {i}" for i in range(d, d + 400)) for d in range(0, 400, 20)] + ["\n".join(f"rare {i}" for i in range(d, d + 500)) for d in range(0, 5000, 500)]
    frequent, docs = _frequent(texts, 10), _frame(spark, texts)
    state = ld.insert(ld.empty_state(spark, 10, 1, 10_000, 2), docs)
    lookup = ld._sent_filters(state)
    rare = {k for t in texts for k in t.split("\n")} - frequent
    claimed = lookup.claims(ld._as_hashes(ld.key_hash(k.encode()) for k in rare)).sum()
    assert claimed > 3 and len(frequent) > 100
    for inserted in (True, False):
        denied = ld._denied(state, None if inserted else docs, lookup, "text")
        assert denied is None if few else len(denied) == claimed
        assert _got(ld.apply(state, docs, inserted=inserted)) == _want(texts, frequent)


def test_cuckoo_filter_against_a_multiset():
    rnd, f, held = random.Random(0), ld.CuckooFilter(16), []
    for _ in range(3000):
        if held and rnd.random() < 0.45:
            f.delete(*held.pop(rnd.randrange(len(held))))
        else:
            p = rnd.randint(1, 40)
            key = (rnd.randrange(64), p, int(ld._mixed(np.array([p], np.uint64))[0]))
            held.append(key)
            f.insert(*key)
        f = ld.CuckooFilter(16, f.pack())
    assert sum(int((t > 0).sum()) for t in f.tables) == len(held)
    for bucket, p, other in held:
        assert any((t[b] == p).any() for t in f.tables for b in (bucket % 16, (bucket ^ other) % 16))
    with pytest.raises(ValueError):
        ld.CuckooFilter().delete(0, 1, 1)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert ld.dedup_lines(docs).collect() == []
    only = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert _got(ld.dedup_lines(only)) == [("", 1, 0, ""), ("", 1, 0, "")]
