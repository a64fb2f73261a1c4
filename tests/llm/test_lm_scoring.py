from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from loresift.llm import lm_scoring
from tests.llm import plain
from tests.llm.conftest import ODD

LABELS = "doc_id long, quality int, toxic int, text string"


def words(text):
    return plain.WORD.findall(plain.lower(text or ""))


def brute(rows, good):
    """The same models over dictionaries of words and pairs."""
    counts = []
    for part in ([t for i, t in rows if i in good], [t for _, t in rows]):
        one, before, pair = Counter(), Counter(), Counter()
        for text in part:
            w = words(text)
            one.update(w)
            before.update(["<s>", *w][: len(w)])
            pair.update(zip(["<s>", *w], w, strict=False))
        counts.append([one, before, pair])
    scale = counts[0][0].total() / counts[1][0].total()
    out = []
    for i, text in rows:
        w, losses = words(text), []
        for (one, before, pair), by in zip(counts, (1, scale), strict=True):
            total = by * one.total() + 1
            loss = 0.0
            for v, x in zip(["<s>", *w], w, strict=False):
                p = (by * one[x] + 1 / (1 << lm_scoring.WORD_BITS)) / total
                loss -= math.log((by * pair[v, x] + lm_scoring.MU * p) / (by * before[v] + lm_scoring.MU))
            losses.append(loss / max(1, len(w)))
        out.append((i, len(w), losses[0] - losses[1]))
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(9)
    good = [(i, " ".join(draw.choices(["sun", "moon", "star", "sky"], k=draw.randrange(1, 30)))) for i in range(100, 140)]
    rest = [(i, " ".join(draw.choices(["buy", "now", "cheap", "star"], k=draw.randrange(1, 30)))) for i in range(140, 200)]
    return good + rest


def test_scores_match_plain_models(spark, docs, rows):
    every = rows + [p for p in ODD if p[0]]
    labels = spark.createDataFrame([(i, int(i < 140), 0, "") for i, _ in rows] + [(None, 1, 0, ""), (1, None, 0, "")], LABELS)
    got = sorted((r.doc_id, r.n_words, round(r.score, 4)) for r in lm_scoring.score_documents(docs(*every), labels).collect())
    expected = sorted((i, n, round(s, 4)) for i, n, s in brute(every, set(range(100, 140))))
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected], abs=2e-3)
    by_id = {g[0]: g[2] for g in got}
    assert max(by_id[i] for i, t in rows[:40]) < min(by_id[i] for i, t in rows[40:] if "buy" in t)
    assert by_id[3] == by_id[4] == by_id[5] == 0


def test_no_target_and_empty_tables(spark, docs, odd):
    none = spark.createDataFrame([(1, 0, 0, "")], LABELS)
    assert {r.score for r in lm_scoring.score_documents(odd, none).collect()} == {0.0}
    assert lm_scoring.score_documents(odd.where("false"), none).collect() == []


def test_large_vocabulary_is_counted_exactly(spark, docs):
    """More words than 2**16 and more pairs than any task's share: nothing is mixed up with anything else."""
    draw = random.Random(3)
    many = [(i, " ".join(f"w{draw.randrange(300_000)}" for _ in range(1000))) for i in range(150)]
    many += [(1000 + i, " ".join(draw.choices(many[i][1].split(), k=40))) for i in range(150)]
    assert len({x for _, t in many for x in t.split()}) > 100_000
    good = set(range(0, 150, 3))
    labels = spark.createDataFrame([(i, int(i in good), 0, "") for i, _ in many], LABELS)
    got = sorted((r.doc_id, r.n_words, r.score) for r in lm_scoring.score_documents(docs(*many), labels).collect())
    expected = sorted(brute(many, good))
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected], abs=1e-9)


def test_every_good_document_counts(spark, docs, rows):
    labels = spark.createDataFrame([(i, int(i < 140), 0, "") for i, _ in rows], LABELS)
    got = sorted((r.doc_id, r.score) for r in lm_scoring.score_documents(docs(*rows), labels).collect())
    assert [g[1] for g in got] == pytest.approx([e[2] for e in sorted(brute(rows, set(range(100, 140))))], abs=1e-9)
