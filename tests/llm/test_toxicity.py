from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loresift.llm import toxicity
from loresift.llm.shingles import shingle_sets
from tests.llm.conftest import ODD

LABELS = "doc_id long, quality int, toxic int, text string"


def quadratic_segments(scores):
    """By the definition: the best segment, then the best ones left and right of it."""

    def within(low, high):
        best = max(
            ((sum(scores[a:b]), -(b - a), -a) for a, b in combinations(range(low, high + 1), 2)), default=(0, 0, 0)
        )
        if best[0] <= 0:
            return []
        start = -best[2]
        end = start - best[1]
        return [*within(low, start), (start, end, best[0]), *within(end, high)]

    return within(0, len(scores))


def test_segments_match_their_definition():
    draw = random.Random(6)
    for _ in range(300):
        scores = [draw.choice([-7, -4, -3, -1, 2, 3, 5, 11]) + draw.random() / 64 for _ in range(draw.randrange(18))]
        got = toxicity.maximal_segments(np.array(scores, float))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in quadratic_segments(scores)]
        assert all(s == pytest.approx(sum(scores[a:b])) for a, b, s in got)


def test_extreme_values_recover_their_parameters():
    draw = np.random.default_rng(1)
    size = draw.integers(50, 3000, 20_000).astype(float)
    best = (np.log(0.2 * size) - np.log(draw.exponential(size=20_000))) / 1.4
    decay, space = toxicity.extreme_values(best, size, np.ones_like(best))
    assert decay == pytest.approx(1.4, rel=0.05) and space == pytest.approx(0.2, rel=0.25)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(8)
    plain = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(700):
        words = draw.choices(plain, k=draw.randrange(5, 80))
        toxic = i % 4 == 0
        if toxic:
            for at in range(0, len(words), 8):
                words.insert(at, draw.choice(["vilething", "vileperson", "nastyword"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic), "x"))
    return docs, labels


def test_held_out_labels_are_met(spark, docs, corpus):
    rows, labels = corpus
    got = toxicity.score_toxicity(docs(*rows), spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: t for i, _, t, _ in labels}
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows}
    unseen = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.passages for r in got if r.predicted)


def test_held_out_labels_are_not_read(spark, docs, corpus):
    rows, labels = corpus
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, x) for i, q, t, x in labels]
    one, two = (
        sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs(*rows), spark.createDataFrame(part, LABELS)).collect())
        for part in (labels, turned)
    )
    assert one == two


def test_odd_rows(spark, docs, odd, corpus):
    rows, labels = corpus
    more = [(i + 1000 if i else None, t) for i, t in ODD]
    labels = [*labels, (3, None, None, ""), (None, 1, 1, ""), (0, 1, 1, ""), (0, 1, 0, "")]
    table = docs(*rows, *more)
    got = toxicity.score_toxicity(table, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) + len(more)
    assert all(r.score < 0.5 for r in got if r.doc_id is None or r.doc_id >= 1000)
    assert all(r.held_out for r in got if r.doc_id is None)
    kept = toxicity.drop_toxic(table, spark.createDataFrame(labels, LABELS))
    assert kept.columns == table.columns
    assert kept.count() == len(got) - sum(r.predicted for r in got)
    none = spark.createDataFrame(labels, LABELS).where("toxic = 0")
    assert {(r.score, r.predicted) for r in toxicity.score_toxicity(table, none).collect()} == {(0.0, 0)}
    assert toxicity.score_toxicity(table.where("false"), none).collect() == []


def test_word_scores_equal_plain_python(spark, docs, corpus):
    """The log-odds of every word and beginning, from the counts of the documents that teach."""
    rows, labels = corpus
    table = docs(*rows).select("doc_id", "text")
    model, calibrating = toxicity.fit_words(table, spark.createDataFrame(labels, LABELS))
    truth = {i: bool(t) for i, _, t, _ in labels if zlib.crc32(str(i).encode()) % 5}
    values, begin = shingle_sets(pa.array([t for _, t in rows]), 2)
    first = {}
    for n, (i, _) in enumerate(rows):
        if i in truth:
            family = (int(values[begin[n]]) if begin[n + 1] > begin[n] else 0, truth[i])
            first[family] = min(first.get(family, i), i)
    chosen = set(first.values())
    ids = spark.createDataFrame([(i,) for i in sorted(chosen)], "i long")
    aside = {r.i for r in ids.where(f"pmod(xxhash64(i, 3), {toxicity.PARTS}) = 0").collect()}
    assert {r.label_id for r in calibrating.collect()} == aside
    counts = {True: Counter(), False: Counter()}
    teaching = [(t, truth[i]) for i, t in rows if i in chosen - aside]
    for text, toxic in teaching:
        counts[toxic].update({k for w in set(toxicity.words(text)) for k in toxicity._beginnings(w)})
    root = sum(toxic for _, toxic in teaching) / len(teaching)
    shares, expected = {}, {}
    for key in sorted(counts[True] | counts[False], key=lambda k: (k.endswith("$"), len(k))):
        stems = [shares[key[:n]] for n in toxicity.STEMS if len(key.rstrip("$")) > n]
        back = stems[-1] if stems else root
        a, b = counts[True][key] + toxicity.PRIOR * back, counts[False][key] + toxicity.PRIOR * (1 - back)
        apart = math.log(a / b) - math.log(back / (1 - back))
        sure = math.copysign(max(0.0, abs(apart) - toxicity.Z * math.sqrt(1 / a + 1 / b)), apart)
        shares[key] = 1 / (1 + math.exp(-(math.log(back / (1 - back)) + sure)))
        if abs(sure) >= toxicity.DIFFERENT:
            expected[key] = math.log(shares[key] / (1 - shares[key])) - math.log(root / (1 - root))
    hashed = {np.uint64(xxhash.xxh64_intdigest(k.encode(), 42)).astype(np.int64): v for k, v in expected.items()}
    assert dict(zip(model.hashes, model.odds, strict=True)) == pytest.approx(hashed)
    found = ["vilething", "vilest", "nastyword", "word7", "other"]
    plain = [next((expected[k] for k in reversed(toxicity._beginnings(w)) if k in expected), 0.0) - toxicity.DRIFT for w in found]
    assert model.score(found).tolist() == pytest.approx(plain) and plain[0] > 0.5
