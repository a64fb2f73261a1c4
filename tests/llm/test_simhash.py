from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loresift.llm import simhash
from loresift.llm.anchors import anchor_rows, cover
from tests.llm import plain
from tests.llm.conftest import ODD


def fingerprint(text, width=4):
    words = plain.WORD.findall(plain.lower(text or ""))
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, distance):
    """Smallest number reachable, by comparing all pairs."""
    top = list(range(len(prints)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            low, high = sorted((find(i), find(j)))
            top[high] = low
    return [find(i) for i in range(len(prints))]


def components(rows, distance=4):
    ids = [i for i, _ in rows]
    of = linked([fingerprint(t) for _, t in rows], distance)
    least = {}
    for i, c in zip(ids, of, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, f"{fingerprint(t):016x}", least.get(c)) for (i, t), c in zip(rows, of, strict=True)), key=str)


@pytest.mark.parametrize(("distance", "parts"), [(4, 3), (3, 2), (0, 3), (5, 2)])
def test_pairs_within_the_distance_meet_at_a_home(distance, parts):
    draw = random.Random(distance)
    code = cover(distance, parts)
    for _ in range(60):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), distance):
            b ^= 1 << bit
        rows, keys, homes = anchor_rows(np.array([a, b], np.uint64), code)
        of = [set(keys[rows == i].tolist()) for i in (0, 1)]
        own = [set(keys[(rows == i) & homes].tolist()) for i in (0, 1)]
        assert own[0] & of[1] and own[1] & of[0] and all(len(o) == parts for o in own)


def test_every_pattern_has_a_home_within_the_radius():
    for part in cover(4, 3):
        values = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
        row, anchor, home = part.anchors(values)
        inside = values >> np.uint64(part.shift) & np.uint64((1 << part.width) - 1)
        far = np.bitwise_count(inside[row] ^ anchor)
        assert far.max() <= part.radius + 1 and far[home].max() <= part.radius
        assert not part.syndrome(anchor).any() and home.sum() == len(values)


def family(draw, count, words, changes):
    base = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(count):
        text = list(base)
        for _ in range(draw.randrange(changes)):
            text[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("block", [simhash.BLOCK, 5])
def test_components_equal_all_pairs(spark, docs, block):
    draw = random.Random(4)
    texts = family(draw, 150, 400, 9) + family(draw, 60, 60, 3) + family(draw, 40, 3000, 40)
    texts += [f"only {i}" for i in range(80)] + ["", "  \n", "Same Words here", "same words  HERE"] + texts[:20]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    found = simhash.near_duplicates(docs(*rows, partitions=4), block=block).collect()
    expected = components(rows)
    assert sorted((tuple(r) for r in found), key=str) == expected
    assert len({c for *_, c in expected}) < len(rows) - 100


def test_blocks_report_forests_not_pairs():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    nodes = np.unique(base ^ np.array([(1 << int(a)) | (1 << int(b)) for a, b in draw.integers(0, 63, (900, 2))], np.uint64))
    block = simhash._Block(4)
    every = np.ones(len(nodes), bool)
    half = len(nodes) // 2
    edges = [*block.meet(nodes[:half], nodes[:half].view(np.int64), every[:half], True)]
    edges += block.meet(nodes[half:], nodes[half:].view(np.int64), every[half:], False)
    pairs = [(int(a), int(b)) for x, y in edges for a, b in zip(x, y, strict=True)]
    assert len(pairs) <= 3 * len(nodes)
    top = {int(n): int(n) for n in nodes}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        top[find(a)] = find(b)
    whole = linked([int(n) for n in nodes], 4)
    assert len({find(int(n)) for n in nodes}) == len(set(whole)) == 1


def test_odd_rows(spark, docs, odd):
    found = simhash.near_duplicates(odd).collect()
    assert sorted((tuple(r) for r in found), key=str) == components(ODD)
    assert simhash.near_duplicates(odd.where("false")).collect() == []
    nameless = simhash.near_duplicates(docs((None, "nobody has a name here"))).collect()
    assert [r.component_id for r in nameless] == [None]


def test_rows_of_anchors_are_not_broadcast(spark):
    # few bytes by the planner's guess, dozens of rows a node in truth
    nodes = spark.range(100).select(F.xxhash64("id").alias("node"))
    plan = simhash._pivot_links(nodes, 4, simhash.PARTS)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan
