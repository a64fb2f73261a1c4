"""The operators' results in plain Python, for comparison on small tables."""

from __future__ import annotations

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, width: int) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_components(docs: dict[int, str | None], width: int, similarity: int = 80) -> dict[int, int]:
    """Smallest id reachable over links, by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(i for i in docs if sets[i]), 2):
        x, y = sets[a], sets[b]
        if 100 * min(len(x), len(y)) < similarity * max(len(x), len(y)):
            continue
        both = len(x & y)
        if 100 * both >= similarity * (len(x) + len(y) - both):
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    return {i: top(i) for i in docs}
