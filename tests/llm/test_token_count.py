import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from basketry.llm import token_count  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "b", "'", "s", "re", "ll", " ", "  ", "\n", "\t", "1", "23", "!", "!!", "é", "ü", "漢", "\u00a0", "😀", "<|endoftext|>", "the", " and",
            "'ve", "'S", "---", "aaaa", "\u0301", "ing", "T", "\x00", "\u1c89", "Ⅳ", "²", "\u2028"]


@pytest.fixture(scope="module")
def counter():
    return token_count.TokenCounter(token_count.load_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda texts: np.array([len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)])


def _random_texts(n, seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    ranges = [(32, 126), (160, 0x24F), (0x3000, 0x9FFF), (0x1F300, 0x1F6FF), (0, 31), (0x370, 0x5FF)]
    return texts + ["".join(chr(rnd.randint(*rnd.choice(ranges))) for _ in range(rnd.randint(1, 200))) for _ in range(n // 4)]


def test_counts_equal_the_library(counter, library):
    texts = _random_texts(4000, 1)
    assert (counter.texts(texts) == library(texts)).all()


@pytest.mark.parametrize("chunk", [4, 7, 16, 61])
def test_chunk_maps_compose(counter, library, chunk):
    texts = _random_texts(800, chunk)
    assert (counter.texts(texts, chunk) == library(texts)).all()


def test_long_texts(counter, library):
    texts = ["a" * 200_000, "ab" * 100_000, " " * 80_000, "x y" * 60_000, "-" * 5000 + "=" * 7000, "it's " * 50_000 + "<|endoftext|>" * 9]
    assert (counter.texts(texts) == library(texts)).all()


def test_states_start_afresh_beyond_their_bound(counter, library, monkeypatch):
    monkeypatch.setattr(token_count, "MAX_STATES", 50)
    texts = _random_texts(200, 9)
    for _ in range(2):
        assert (counter.texts(texts) == library(texts)).all()


def test_operator(spark, library):
    texts = [None, "", "Hello world", "é" * 2000, "x" * 100_000, "Hello world"]
    docs = spark.createDataFrame([(i % 5, t, 7, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, id string")
    rows = token_count.count_tokens(docs, PATH).collect()
    want = library([t or "" for t in texts])
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == sorted(
        (i % 5, len((t or "").encode()), int(n), bool(n > 1024)) for i, (t, n) in enumerate(zip(texts, want)))
    assert token_count.count_tokens(docs.limit(0), PATH).count() == 0
