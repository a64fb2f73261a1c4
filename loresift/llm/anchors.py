"""Anchor points that cover all bit patterns, for joins by Hamming distance.

A fingerprint is cut into parts. Each part has a covering code: as many perfect
[15, 11] Hamming codes as fit side by side, and the bits left over as they are.
Every pattern of a part lies within the code's covering radius, one bit for
each Hamming code, of exactly one nearest anchor, its home. Two fingerprints
that differ in at most d bits differ in at most d // parts bits of some part;
there, one of them lies within radius plus d // parts bits of the other's home.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

_BLOCK = 15


class Part:
    """The covering code of ``width`` bits; ``reach`` is how far fingerprints may lie apart here."""

    def __init__(self, shift: int, width: int, reach: int):
        self.shift, self.width = shift, width
        self.blocks = width // _BLOCK
        self.radius = self.blocks
        # a bit's place in its block, from 1: codewords are the patterns whose places cancel out
        places = np.arange(1 << _BLOCK, dtype=np.uint16)
        self.syndromes = np.zeros(1 << _BLOCK, np.uint64)
        for bit in range(_BLOCK):
            self.syndromes ^= np.where(places >> bit & 1, np.uint64(bit + 1), np.uint64(0))
        flips = np.array(
            [sum(1 << b for b in bits) for k in range(self.radius + reach + 1) for bits in combinations(range(width), k)],
            np.uint64,
        )
        owner = self.syndrome(flips).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        self.flips = flips[order]
        self.begin = np.searchsorted(owner[order], np.arange(16**self.blocks + 1))

    def syndrome(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.uint64)
        for block in range(self.blocks):
            inside = values >> np.uint64(_BLOCK * block) & np.uint64((1 << _BLOCK) - 1)
            out |= self.syndromes[inside.astype(np.int64)] << np.uint64(4 * block)
        return out

    def anchors(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All anchors within radius plus reach: the fingerprint's number, the anchor, and whether it is its home."""
        values = fingerprints >> np.uint64(self.shift) & np.uint64((1 << self.width) - 1)
        syndrome = self.syndrome(values).astype(np.int64)
        counts = (self.begin[1:] - self.begin[:-1])[syndrome]
        row = np.repeat(np.arange(len(values)), counts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        flips = self.flips[self.begin[syndrome][row] + nth]
        # fewer flips come first: the first anchor is the nearest
        return row, values[row] ^ flips, nth == 0


def cover(distance: int, parts: int) -> list[Part]:
    """The parts of 64 bits that fingerprints at most ``distance`` bits apart have to be compared in."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [Part(a, b - a, distance // parts) for a, b in zip(cuts, cuts[1:], strict=False)]


def anchor_rows(fingerprints: np.ndarray, code: list[Part]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all parts: the fingerprint's number, a key for part and anchor, and whether it is the home."""
    found = [part.anchors(fingerprints) for part in code]
    keys = [anchors | np.uint64(i << 56) for i, (_, anchors, _) in enumerate(found)]
    return np.concatenate([f[0] for f in found]), np.concatenate(keys).view(np.int64), np.concatenate([f[2] for f in found])
