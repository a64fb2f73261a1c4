from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from loresift.llm import near_dedup
from loresift.llm import shingles as shingling
from loresift.llm.graph import components
from tests.llm import plain
from tests.llm.conftest import ODD


def edited(words: list[str], rate: float, draw: random.Random) -> str:
    return " ".join(draw.choice(["x", "yy", "z"]) + str(draw.randrange(999)) if draw.random() < rate else w for w in words)


@pytest.fixture(scope="module")
def corpus():
    """Families of near copies at all similarities, short texts, and unrelated ones."""
    draw = random.Random(4)
    rows = {}
    for family in range(6):
        words = [f"w{draw.randrange(300)}" for _ in range(draw.choice([12, 60, 200]))]
        for _ in range(40):
            rows[len(rows)] = edited(words, draw.choice([0.0, 0.01, 0.03, 0.06, 0.1]), draw)
    for _ in range(60):
        rows[len(rows)] = " ".join(f"w{draw.randrange(300)}" for _ in range(draw.randrange(0, 9)))
    ids = list(rows)
    draw.shuffle(ids)
    return {ids[i]: t for i, t in rows.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_components_match_all_pairs(spark, docs, corpus, width):
    got = near_dedup.near_duplicates(docs(*corpus.items()), width=width).collect()
    expected = plain.near_components(corpus, width)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(plain.shingles(t, width)) for i, t in corpus.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_and_shares_of_any_size_agree(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHARE", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    got = near_dedup.near_duplicates(docs(*corpus.items()), width=2).collect()
    assert {r.doc_id: r.component_id for r in got} == plain.near_components(corpus, 2)


def test_a_family_just_apart_visits_each_block_once(spark, docs, monkeypatch):
    """Texts that share buckets, yet mostly are below the similarity: rows are texts times blocks of the family."""
    draw, block, visits = random.Random(11), 16, []
    base = [f"w{i}" for i in range(100)]
    rows = {}
    for i in range(300):
        words = list(base)
        for at in draw.sample(range(100), 3):
            words[at] = f"x{i}.{at}"
        rows[i] = " ".join(words)
    settle = near_dedup.settle

    def counted(table, label):
        out = settle(table, label)
        if label == "visits":
            visits.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "settle", counted)
    got = near_dedup.near_duplicates(docs(*rows.items()), width=2).collect()
    assert {r.doc_id: r.component_id for r in got} == plain.near_components(rows, 2)
    assert visits[0] <= 300 * -(-300 // block)


def test_odd_rows(spark, odd):
    got = near_dedup.near_duplicates(odd, width=2)
    rows = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert got.count() == len(ODD)
    assert {i: r.component_id for i, r in rows.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 1, 7: 7, 8: 7, 9: 9}
    assert rows[3].n_shingles == rows[4].n_shingles == rows[5].n_shingles == 0
    kept = near_dedup.keep_one(odd, width=2)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "7", "9", "None", "None"]


def test_empty_table(spark, odd):
    assert near_dedup.near_duplicates(odd.where("false")).collect() == []
    assert near_dedup.keep_one(odd.where("false")).collect() == []


def test_shingles_match_plain_sets(monkeypatch):
    monkeypatch.setattr(shingling, "_WINDOW", 16)
    draw = random.Random(1)
    texts = ["", " ", "A a", "É é\tß", "x" * 100] + [
        "".join(draw.choice("abAB \t\né") for _ in range(draw.randrange(60))) for _ in range(200)
    ]
    for width in (1, 2, 5):
        values, begin = shingling.shingle_sets(pa.array(texts), width)
        sets = [plain.shingles(t, width) for t in texts]
        assert np.diff(begin).tolist() == [len(s) for s in sets]
        mine = [set(values[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        for i, j in ((draw.randrange(205), draw.randrange(205)) for _ in range(500)):
            assert len(mine[i] & mine[j]) == len(sets[i] & sets[j])


def test_every_coordinate_fills_and_estimates_similarity():
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 90), (10, 100), (0, 1), (0, 0))]
    values, begin = shingling.shingle_sets(pa.array(texts), 1)
    sketch = shingling.similarity_sketch(values, begin, 2000)
    full = np.uint64(2**64 - 1)
    assert (sketch[:3] != full).all() and (sketch[3] == full).all()
    assert abs((sketch[0] == sketch[1]).mean() - 0.8) < 0.04


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_workers_give_back_what_they_hold_unused(monkeypatch):
    """An idle worker counts beside the executor's other work, so each task ends by giving memory back."""
    from loresift.llm import common, near_dedup

    ended = []
    for module in (common, near_dedup):
        monkeypatch.setattr(module, "give_back", lambda: ended.append(1))
    texts = pa.record_batch([pa.array([1, 2]), pa.array(["a b c", ""])], names=["doc_id", "text"])
    for task in (near_dedup._sketcher(2, 4, 2), near_dedup._comparer(80), near_dedup._block_comparer(80)):
        before = len(ended)
        list(task(iter([texts] if task.__qualname__.startswith("_sketcher") else [])))
        assert len(ended) == before + 1
