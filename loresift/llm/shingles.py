"""Word shingles of whole texts as 64-bit numbers, a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M = (1 << 64) - 1
#: An odd multiplier, and its inverse modulo 2**64, so that word hashes are differences of running sums.
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them well, for each seed another one."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & _M)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < count:
        out = np.full(max(count, 1 << 18), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:count]


#: Texts are hashed in windows of about this many bytes, ended at a blank.
_WINDOW = 1 << 20


def _window_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words in lower-cased ``data``; a word also ends at each of ``cuts``."""
    size = len(data)
    solid = ~_BLANK[data]
    first = np.empty(size + 1, bool)
    first[0], first[1:-1], first[-1] = solid[0], solid[1:] & ~solid[:-1], False
    last = np.empty(size + 1, bool)  # one past a word's end
    last[0], last[1:-1], last[-1] = False, solid[:-1] & ~solid[1:], solid[-1]
    run_on = cuts[solid[cuts] & solid[cuts - 1]]
    first[run_on] = last[run_on] = True
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_P, size), out=sums[1:])
    inverse = _powers(_P_INVERSE, size)[starts]
    return mix((sums[stops] - sums[starts]) * inverse + (stops - starts).astype(np.uint64)), starts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one more than texts).

    Words are runs of bytes other than blank, tab to carriage return; A to Z count as a to z.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    base, size = ends[0], ends[-1] - ends[0]
    ends = ends - base
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[base : base + size]
    cuts = np.unique(ends[(ends > 0) & (ends < size)])
    hashes, starts, at = [], [], 0
    while at < size:
        stop = min(size, at + _WINDOW)
        while stop < size and not _BLANK[data[stop]]:
            blank = np.flatnonzero(_BLANK[data[stop : stop + _WINDOW]])
            stop = stop + blank[0] if len(blank) else min(size, stop + _WINDOW)
        inside = cuts[np.searchsorted(cuts, at, "right") : np.searchsorted(cuts, stop, "left")] - at
        found, begun = _window_words(_LOWER[data[at:stop]], inside)
        hashes.append(found)
        starts.append(begun + at)
        at = stop
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within the text, and where each text's begin.

    A text with fewer than ``width`` words has its whole sequence as its one
    shingle, one without words has none.
    """
    words, at = word_hashes(texts)
    counts = np.diff(at)
    shingle_count = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), shingle_count)
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(shingle_count, out=begin[1:])
    place = np.arange(begin[-1]) - begin[owner] + at[owner] if len(owner) else np.zeros(0, np.int64)
    length = np.minimum(counts[owner], width)
    made = mix(length.astype(np.uint64), 1)
    for k in range(width):
        held = k < length
        made[held] = mix(made[held] * np.uint64(_P) + words[place[held] + k])
    order = np.lexsort((made, owner))
    made, owner = made[order], owner[order]
    keep = np.ones(len(made), bool)
    keep[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
    made, owner = made[keep], owner[keep]
    return made, np.searchsorted(owner, np.arange(len(counts) + 1))


def similarity_sketch(values: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketches of many sets at once: rows of ``size`` 64-bit coordinates.

    In round i every element draws a bin and a value that counts i first; a bin
    keeps its least value. A set is done after the round that filled its last
    bin. From round ``size`` on, round i puts all elements into bin i - size,
    so every coordinate of a non-empty set is filled after 2 * size rounds at
    most. Equal coordinates come with the Jaccard similarity's probability.
    Rows of empty sets hold the largest number.
    """
    sets = len(begin) - 1
    empty = np.uint64(_M)
    sketch = np.full(sets * size, empty, np.uint64)
    active = np.flatnonzero(np.diff(begin))
    for turn in range(2 * size):
        if not len(active):
            break
        counts = (begin[1:] - begin[:-1])[active]
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        drawn = mix(values[inner + np.repeat(begin[active], counts)], turn + 2)
        if turn < size:
            bins = ((drawn >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            bins = np.full(len(drawn), turn - size)
        # the round in front, then value bits that the bin does not depend on
        value = (np.uint64(turn) << np.uint64(52)) | (mix(drawn, 1) >> np.uint64(12))
        np.minimum.at(sketch, np.repeat(active * size, counts) + bins, value)
        active = active[(sketch.reshape(sets, size)[active] == empty).any(axis=1)]
    return sketch.reshape(sets, size)
