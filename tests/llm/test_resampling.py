from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loresift.llm import resampling
from tests.llm import plain
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=1):
    words = WORD.findall(plain.lower(text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def buckets(text, longest, count):
    return [zlib.crc32(f.encode()) % count for f in features(text, longest)]


def expected(rows, target, longest=1, count=10_000, seed=2024, least=20, percent=10):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets(text, longest, count))
    for text in target:
        t.update(buckets(text, longest, count))
    whole_s, whole_t = sum(s.values()) + count, sum(t.values()) + count
    out = []
    for i, text in rows:
        held = buckets(text, longest, count)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * whole_s / ((s[b] + 1) * whole_t))) for b in held)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, len(held), weight, score, None, len(features(text))])
    able = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def table(rows):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows.collect()), key=str)


def test_crc32_equals_the_library():
    draw = np.random.default_rng(3)
    data = draw.integers(0, 256, 5000).astype(np.uint8)
    starts = np.concatenate([draw.integers(0, 4000, 300), [0, 7]])
    ends = starts + np.concatenate([draw.integers(0, 100, 300), [900, 0]])
    whole = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert resampling.crc32(data, starts, ends).tolist() == whole
    assert len(resampling.crc32(data, starts[:0], ends[:0])) == 0


def test_features_equal_the_pattern():
    draw = random.Random(6)
    texts = ["", " ", "a", "A1 b", "end", "start end", "é中x Z", *("".join(draw.choice("aZ09 .-\té中\x00\x7f@[`{") for _ in range(draw.randrange(30))) for _ in range(800))]
    texts.append("w" * 300 + " " + "é" * 90)
    for longest in (1, 3):
        found, begin, words = resampling.feature_buckets(pa.array(texts), longest, 97)
        assert [sorted(found[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:], strict=True)] == [sorted(buckets(t, longest, 97)) for t in texts]
        assert words.tolist() == [len(features(t)) for t in texts]


def some_rows(count):
    draw = random.Random(8)
    names = [f"w{k}" for k in range(60)]
    return [(i * 7 % 1009, " ".join(draw.choices(names, range(1, 61), k=draw.randrange(60)))) for i in range(count)]


@pytest.mark.parametrize(("longest", "percent", "least"), [(1, 10, 20), (2, 37, 5), (1, 100, 0), (1, 0, 0), (1, 1, 55)])
def test_draw_equals_plain_python(spark, docs, longest, percent, least):
    rows, target = some_rows(700), [f"w{k} w{k + 1} W3" for k in range(20)] + [None]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    found = resampling.resample(docs(*rows, partitions=4), wanted, longest, 500, 11, least, percent)
    assert table(found) == expected(rows, target, longest, 500, 11, least, percent)


def test_bracket_is_widened_until_it_holds_the_cutoff(spark):
    # a few scores, each held by many rows, and a sketch that is far off
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("score"))
    best = sorted((-(i % 7), i) for i in range(3000))
    for drawn in (1, 2, 428, 429, 1500, 2999, 3000):
        score, doc_id = best[drawn - 1]
        assert resampling.cutoff(rows, drawn, 3000, accuracy=4) == (-score, doc_id)
    assert resampling.cutoff(rows, 0, 3000) is None


def test_odd_rows(spark, odd):
    wanted = spark.createDataFrame([("alpha one",)], "text string")
    found = resampling.resample(odd, wanted, least_words=0, percent=60)
    assert table(found) == expected(ODD, ["alpha one"], least=0, percent=60)
    none = resampling.resample(odd.where("false"), wanted)
    assert none.collect() == [] and none.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert resampling.resample(odd, wanted.where("false")).count() == len(ODD)
