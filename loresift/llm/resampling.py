"""Importance resampling towards a target distribution of hashed n-grams.

1. Every word run of all rows and of all target texts is counted in one of a
   fixed number of buckets. The logarithms of the two smoothed shares' ratio,
   one number for each bucket, are an array that scores documents; its length
   is a parameter, so it goes to every task.
2. A document's weight is the sum over its features. Gumbel noise drawn from
   its id makes the highest scores a draw without replacement by weight.
3. The cutoff is bracketed by quantiles of a sketch. Exact counts above and in
   the bracket tell whether it holds the cutoff; if not, it is widened. Only
   the bracket is sorted to find the cutoff, and only drawn rows are ranked.

Sorts are range partitions with running counts; no task holds more than its
range. A range holds equal scores of many documents by their ids.

Defined results: a null, empty or blank text has no features and the weight 0.
A row without ``doc_id`` has a weight, but no score, and is not drawn. Rows
that repeat an id are each drawn for themselves, in any order among equals. An
empty table gives an empty result, and an empty target gives every bucket the
gain of an unseen one. Other columns may have any names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loresift.llm.common import filled, settle, slices, small_batches
from loresift.llm.encoding import text_bytes

#: The sketch's quantiles are off by one in this many at most.
ACCURACY = 10_000
#: Tasks work through about this many bytes of text at once.
_BYTES = 2 << 20
#: Longer words are hashed one by one.
_LONG = 64

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):  # the polynomial of CRC-32, reversed (fixed value)
    _TABLE = np.where(_TABLE & 1, np.uint32(0xEDB88320) ^ (_TABLE >> np.uint32(1)), _TABLE >> np.uint32(1))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Digits, letters and all bytes of longer characters.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = True


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of many runs of bytes, all advancing together by one byte."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at, left = starts[order], length[order]
    long = int(np.searchsorted(-left, -_LONG, "left"))
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(int(left[long]) if long < len(left) else 0):
        held = slice(long, int(np.searchsorted(-left, -k, "left")))
        now = state[held]
        state[held] = _TABLE[(now ^ data[at[held] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        state[i] = zlib.crc32(data[at[i] : at[i] + left[i]])
    out = np.empty(len(at), np.uint32)
    out[order] = state
    return out


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of all texts, where each text's begin (one more than texts), and its number of words."""
    data, ends = text_bytes(texts)
    data = _LOWER[data]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = _SOLID[data]
    # a word also ends with its text
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    inner = ends[(ends > 0) & (ends < len(data))]
    first[inner] = solid[1:-1][inner]
    last[inner - 1] = solid[1:-1][inner - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    word_at = np.searchsorted(starts, ends)
    words = np.diff(word_at)
    # words of all texts in a row, joined by single blanks, so that a run of words is a run of bytes
    sizes = stops - starts
    moved = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    joined[np.repeat(moved - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))] = data[_SOLID[data]]
    found, owner = [], []
    text_of = np.repeat(np.arange(len(words)), words)
    for run in range(1, longest + 1):
        begins = np.flatnonzero(np.arange(len(starts)) + run <= word_at[1:][text_of]) if len(starts) else np.zeros(0, np.int64)
        found.append(crc32(joined, moved[begins], moved[begins + run - 1] + sizes[begins + run - 1]) % np.uint32(buckets))
        owner.append(text_of[begins])
    found, owner = np.concatenate(found).astype(np.int64), np.concatenate(owner)
    if longest > 1:
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, np.searchsorted(owner, np.arange(len(words) + 1)), words


def _counter(longest: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in slices(batches, limit=_BYTES):
            counts += np.bincount(feature_buckets(batch.column("text"), longest, buckets)[0], minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all ``texts`` (text) fall into each bucket; the result's length is ``buckets``."""
    rows = texts.select(filled(F.col("text")).alias("text")).mapInArrow(_counter(longest, buckets), "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of target over source share of each bucket, rounded down."""
    smooth = len(source)
    all_source, all_target = float(int(source.sum()) + smooth), float(int(target.sum()) + smooth)
    return np.array(
        [math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target)))
         for s, t in zip(source.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("n_words", pa.int64()), ("weight", pa.int64())])


def _scorer(scores: np.ndarray, longest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=_BYTES):
            found, begin, words = feature_buckets(batch.column("text"), longest, len(scores))
            sums = np.concatenate([[0], np.cumsum(scores[found])])
            columns = [np.diff(begin), words, sums[begin[1:]] - sums[begin[:-1]]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], schema=_SCORED
            )

    return run


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel number drawn from the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` (score, doc_id, ...) with their place, from 1, in descending order of score, then by id."""
    order = [F.desc("score"), F.asc("doc_id")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = laid.select("*", F.monotonically_increasing_id().alias("place"))
    laid = settle(laid.select("*", F.shiftright("place", 33).alias("part")), label)
    # one row per range, so the single task here is small; ranges and places within are in order
    least = laid.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    least = least.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return laid.join(least, "part").withColumn("rank", F.col("before") + nth).drop("place", "part", "before")


def cutoff(rows: DataFrame, drawn: int, total: int, accuracy: int = ACCURACY) -> tuple[int, int] | None:
    """Score and id of the last one drawn of ``rows`` (score, doc_id), in descending order; None to draw none.

    The bracket begins as wide as the sketch may err, and doubles until exact
    counts show that the cutoff is inside.
    """
    if not drawn:
        return None
    share, slack = 1 - drawn / total, 2 / accuracy
    while True:
        low, high = max(0.0, share - slack), min(1.0, share + slack)
        bounds = rows.agg(F.percentile_approx("score", [low, high], accuracy).alias("at")).head().at
        low_score = bounds[0] if low > 0 else None
        high_score = bounds[1] if high < 1 else None
        above = F.lit(False) if high_score is None else F.col("score") > high_score
        inside = ~above if low_score is None else ~above & (F.col("score") >= low_score)
        counts = rows.agg(F.count_if(above).alias("above"), F.count_if(inside).alias("inside")).head()
        if counts.above < drawn <= counts.above + counts.inside:
            break
        slack *= 2
    last = ranked(rows.where(inside).select("score", "doc_id"), "bracket").where(F.col("rank") == drawn - counts.above)
    row = last.select("score", "doc_id").head()
    return row.score, row.doc_id


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    least_words: int = 20,
    percent: int = 10,
) -> DataFrame:
    """Every row of ``docs``: doc_id, n_features, weight, score, and the rank of those drawn.

    Features are runs of 1 to ``longest`` words. Of the N rows with at least
    ``least_words`` words, floor(percent * N / 100) with the highest scores are drawn.
    """
    small_batches(docs)
    scores = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text"))
    weighed = texts.mapInArrow(_scorer(scores, longest), "doc_id long, n_features long, n_words long, weight long")
    scored = settle(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")

    able = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    total = scored.where(able).count()
    drawn = percent * total // 100
    last = cutoff(scored.where(able).select("score", "doc_id"), drawn, total)
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    chosen = able & ((F.col("score") > last[0]) | ((F.col("score") == last[0]) & (F.col("doc_id") <= last[1])))
    ranks = ranked(scored.where(chosen).select(*columns), "drawn")
    # rows that repeat the last id may be one too many
    ranks = ranks.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranks.unionByName(scored.where(~chosen).select(*columns, F.lit(None).cast("long").alias("rank")))
