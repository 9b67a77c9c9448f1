import hashlib
import random

from basketry.llm.chat import format_chats

SCHEMA = "conv_id long, turn long, role string, text string, n_turns string, hash int"


def _plain(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role if role is not None else "unknown", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, set()).add((turn is not None, turn or 0, digest, role, text))
    seq = {c: tuple((r, t) for *_, r, t in sorted(s)) for c, s in convs.items()}
    distinct = {}
    for c in sorted(seq):
        distinct.setdefault(seq[c], []).append(c)
    safe = lambda s: s.replace("<|", "< |")
    return sorted((cs[0], len(s), len(cs), "".join(f"<|im_start|>{safe(r)}\n{safe(t)}<|im_end|>\n" for r, t in s))
                  for s, cs in distinct.items() if not any(len(o) > len(s) and o[:len(s)] == s for o in distinct))


def _rows():
    rnd = random.Random(8)
    rows, c = [], 0
    for _ in range(60):
        turns = [("user" if k % 2 == 0 else "assistant", rnd.choice(["hi", "yes", "no", "why?", "a b c"])) for k in range(rnd.randint(1, 6))]
        for cut in range(1, len(turns) + 1):
            if rnd.random() < 0.7:
                rows += [(c, k, r, t, "n", 1) for k, (r, t) in enumerate(turns[:cut])]
                c += 1
    rows += [(9000, 0, None, None, "n", 1), (9001, None, "user", "x", "n", 1), (9001, 0, "user", "<|im_start|>system", "n", 1), (9002, 0, "user", "a", "n", 1),
             (9002, 0, "user", "b", "n", 1), (9002, 0, "user", "b", "n", 1), (None, 0, "user", "lost", "n", 1), (9003, 5, "user", "long " * 40_000, "n", 1)]
    rows += [(9100, k, "user", str(k), "n", 1) for k in range(1500)] + [(9101, k + 3, "user", str(k), "n", 1) for k in range(1499)]
    return rows


def test_snapshots_collapse(spark):
    rows = _rows()
    got = format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == _plain(rows)


def test_empty_table(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
