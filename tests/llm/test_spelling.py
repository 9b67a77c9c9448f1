import random
import re
import zlib
from collections import Counter

import pytest

from basketry.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string"


def _plain_words(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = 1 if doc is None else zlib.crc32(f"{doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _plain(words):
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(out)


def _docs(seed=2):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 9))) for _ in range(120)] + ["ththe" + "a" * i for i in range(6)] + ["aaaaa", "aaaaaa", "ÿÿÿÿÿÿ", "×÷àéî"]
    base += ["x" * 300, "x" * 301, "y" + "x" * 300, "x" * 150 + "y" + "x" * 149]
    pick = lambda: rnd.choice(base[: 1 + int(len(base) * rnd.random() ** 2)])
    rows = []
    for i in range(150):
        words = [pick() for _ in range(rnd.randint(0, 120))]
        rows.append((i, "".join((w.upper() if rnd.random() < 0.1 else w) + rnd.choice([" ", "-", "1", "漢", "\n", "’"]) for w in words)))
    return rows + [(None, " ".join(base * 3)), (200, None), (201, ""), (202, "12 漢字 -"), rows[0], rows[0], (203, "zebra " * 100_000 + "zebru " * 9)]


@pytest.mark.parametrize("chunk", [spelling.CHUNK, 7])
def test_equals_brute_force(spark, chunk):
    rows = _docs()
    frame = spark.createDataFrame([(i, t, "w", "n") for i, t in rows], SCHEMA)
    got = spelling.variants(frame, chunk=chunk)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = _plain(_plain_words(rows))
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[2] not in (r[0], r[1]) for r in want) and any(r[4] == 0 for r in want)


def test_scan_finds_all_and_skips():
    rnd = random.Random(7)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(5, 8))) for _ in range(3000)})
    list_ = spelling.SortedList(words)
    for kept in (0, 2):
        queries = rnd.sample(words, 200) + ["abcabcabca", "zzzzz"]
        got = {(int(a), int(b)) for q, w in list_.near(queries, [kept] * len(queries)) for a, b in zip(q, w)}
        assert got == {(i, j) for i, q in enumerate(queries) for j, w in enumerate(words) if w[:kept] == q[:kept] and _near(q, w)}


def test_routes_leave_no_chunk_out():
    rnd = random.Random(8)
    for _ in range(20_000):
        word = "".join(rnd.choice("ab") for _ in range(rnd.randint(5, 7)))
        prefix = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6)))
        kept = rnd.randint(0, len(word))
        alphabet = "abc"
        near = {word[:i] + c + word[i + k:] for i in range(len(word) + 1) for c in (*alphabet, "") for k in (0, 1)}
        if any(w.startswith(prefix) and w[:kept] == word[:kept] and _near(w, word) for w in near):
            assert spelling.within_one(prefix, word, kept)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "one two", "", "")], SCHEMA)).collect() == []
    assert [tuple(r) for r in spelling.variants(spark.createDataFrame([(1, "alone " * 3, "", "")], SCHEMA)).collect()] == [("alone", None, "alone", 3, 0, None)]
