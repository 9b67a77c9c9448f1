"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re

import xxhash

PII_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PII_BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                  "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def base_sha256(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text)).encode()).hexdigest()


def fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(ids: list, prints: list[int], radius: int = 4) -> list:
    n = len(ids)
    group = list(range(n))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    best: dict[int, object] = {}
    for i in range(n):
        r = find(i)
        if ids[i] is not None and (best.get(r) is None or ids[i] < best[r]):
            best[r] = ids[i]
    return [best.get(find(i)) for i in range(n)]


def words_of(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def overlap_runs(text: str | None, item: str | None) -> list[tuple[int, int, int]]:
    """Equal words, words and first word of every longest run of qualifying
    windows, on every line."""
    a, b = words_of(text), words_of(item)
    width = min(13, len(b))
    need = 11 if width == 13 else width - 1 if width >= 8 else width
    out = []
    for at in range(-len(b), len(a)) if b else ():
        lo, hi = max(0, -at), min(len(b), len(a) - at)
        same = [a[at + j] == b[j] for j in range(lo, hi)]
        runs = []
        for i in range(len(same) - width + 1):
            if sum(same[i:i + width]) >= need:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + width
                else:
                    runs.append([i, i + width])
        out += [(sum(same[i:j]), j - i, at + lo + i) for i, j in runs]
    return out


def overlap(text: str | None, item: str | None) -> int:
    """Equal words of the best qualifying overlap, 0 if there is none."""
    return max((r[0] for r in overlap_runs(text, item)), default=0)


def best_overlap(text: str | None, item: str | None) -> tuple[int, int, int] | None:
    """Equal words, words and first word of the best overlap."""
    return max(overlap_runs(text, item), key=lambda r: (r[0], r[1], -r[2]), default=None)


def mix_targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2) -> dict:
    """Reshare what stands above a cap until nothing does."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        open_ -= set(over)
    return {s: out.get(s, 0) for s in order}


def multiplier(sizes: list[int], target: float, most: int = 2) -> float:
    """The dual's solution by bisection."""
    mean = sum(sizes) / len(sizes)
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        got = sum(s * most / (1 + math.exp(max(-700, min(700, -mid * s / mean)))) for s in sizes)
        lo, hi = (mid, hi) if got < target else (lo, mid)
    return (lo + hi) / 2
