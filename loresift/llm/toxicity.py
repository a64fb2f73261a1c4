"""Toxicity by maximum-scoring segments.

1. In how many toxic and clean training documents a word, and each of its
   beginnings, occurs gives it a log-odds score. Priors are Dirichlet
   distributions centred on the next shorter beginning, and at the root on the
   share of toxic documents: a rare word scores as its stem does, a stem seen
   once says little. Of near copies one counts.
2. A linear-time scan over a text's word scores, each less a small drift,
   finds all its maximal scoring segments (Ruzzo and Tompa).
3. The best segment of a clean text follows an extreme-value distribution
   whose parameters, lambda and K, are fitted to clean examples that word
   scores were not learnt from. Segments
   that are rare under it are the toxic passages; their normalised scores add
   up to the document's evidence, which a logistic curve turns into a score.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0.

Bound: ``TRAIN_ROWS`` labelled rows (the first by a hash of the id) fit the
model. Every word and beginning of theirs that differs from its stem has a
score of its own: a 64-bit hash and a number for each go to the tasks.

Defined results: a null or empty text has no words and scores as an empty one.
A document with several label rows is toxic if one says so; null labels and
ids are no examples. Without examples of both classes every score is 0.
Repeated rows score alike. A row without id counts as held out. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loresift.llm.common import PIPED_BYTES, filled, settle, slices, small_batches
from loresift.llm.shingles import shingle_sets

TRAIN_ROWS = 200_000
#: Lengths of the beginnings that back a word up, short to long.
STEMS = (4, 6)
#: The prior weighs as much as this many documents.
PRIOR = 10.0
#: Standard errors by which a word's distance from its stem is reduced.
Z = 1.5
#: Of so many parts of the examples one calibrates the scores that the others gave to the words.
PARTS = 4
#: Taken off every word's score, so that chance segments end.
DRIFT = 0.05
#: A word has a score of its own if it differs from its stem's by this much.
DIFFERENT = 0.2
#: Expected number of such segments in a clean text of the same length, for a passage to count.
SIGNIFICANT = 0.05
#: A task's word counts are passed on when they hold this many words.
_FLUSH = 100_000
#: Tasks work through about this many bytes of text at once.
_BYTES = 2 << 20

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def examples(labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and toxic of at most ``limit`` labelled rows that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    per_doc = known.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.max("toxic") > 0).alias("toxic"))
    return per_doc.orderBy(F.xxhash64("label_id"), "label_id").limit(limit)


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A number that near copies mostly share: the smallest hash of a pair of words."""
    for batch in slices(batches, limit=2 << 20):
        values, begin = shingle_sets(batch.column("text"), 2)
        family = np.zeros(len(begin) - 1, np.uint64)
        some = np.flatnonzero(np.diff(begin))
        family[some] = values[begin[some]]  # sorted within a text
        yield pa.RecordBatch.from_arrays(
            [batch.column("label_id"), pa.array(family.view(np.int64))], names=["label_id", "family"]
        )


def _beginnings(word: str) -> list[str]:
    """Keys of a word's stems and of the word itself, short to long."""
    return [*(word[:k] for k in STEMS if len(word) > k), word + "$"]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def made() -> pa.RecordBatch:
        keys = list(toxic.keys() | clean.keys())
        columns = [pa.array([c[k] for k in keys], pa.int64()) for c in (toxic, clean)]
        toxic.clear()
        clean.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *columns], names=["key", "toxic", "clean"])

    for batch in slices(batches, limit=_BYTES):
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            keys = {key for word in set(words(text.as_py())) for key in _beginnings(word)}
            (toxic if label else clean).update(keys)
            if len(toxic) + len(clean) >= _FLUSH:
                yield made()
    if toxic or clean:
        yield made()


def _stem(key: Column, length: int) -> Column:
    """The beginning of this length that backs a key up, or null."""
    return F.when(F.length(F.rtrim(key, F.lit("$"))) > length, F.substring(key, 1, length))


class Model:
    """Log-odds of words and beginnings, by the sorted 64-bit hashes of their keys."""

    def __init__(self, hashes: np.ndarray, odds: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.odds = hashes[order], odds[order]

    def score(self, found: list[str]) -> np.ndarray:
        """A word's score is that of its longest known key, less the drift."""
        out = np.zeros(len(found))
        if len(self.hashes):
            # stems from short to long, then the word itself: the last one known counts
            for length in (*STEMS, None):
                rows = [i for i, w in enumerate(found) if length is None or len(w) > length]
                keys = ((found[i] + "$" if length is None else found[i][:length]).encode() for i in rows)
                made = np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(rows)).view(np.int64)
                at = np.minimum(np.searchsorted(self.hashes, made), len(self.hashes) - 1)
                known = self.hashes[at] == made
                out[np.array(rows, np.int64)[known]] = self.odds[at[known]]
        return out - DRIFT


def fit_words(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame] | None:
    """Learn word scores from the labelled ones of ``docs``. Also returns examples left out: label_id, toxic."""
    # at most TRAIN_ROWS rows of an id and a flag
    labelled = docs.join(F.broadcast(examples(labels)), docs.doc_id == F.col("label_id"))
    family = settle(labelled.select("label_id", "text").mapInArrow(_families, "label_id long, family long"), "families")
    chosen = settle(
        family.join(examples(labels), "label_id")
        .groupBy("family", "toxic")
        .agg(F.min("label_id").alias("label_id"))
        .select("label_id", "toxic"),
        "examples",
    )
    calibrating = F.pmod(F.xxhash64("label_id", F.lit(3)), F.lit(PARTS)) == 0
    teaching = chosen.where(~calibrating)
    totals = teaching.agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")).head()
    if not totals.toxic or not totals.clean:
        return None
    root = totals.toxic / (totals.toxic + totals.clean)
    marked = docs.join(F.broadcast(teaching), docs.doc_id == F.col("label_id")).select("text", "toxic")
    counted = marked.mapInArrow(_count, "key string, toxic long, clean long")
    counts = settle(
        counted.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "word-counts"
    )

    def estimate(rows: DataFrame, backing: Column) -> DataFrame:
        a, b = F.col("toxic") + PRIOR * backing, F.col("clean") + PRIOR * (1 - backing)
        apart = F.log(a / b) - F.log(backing / (1 - backing))
        sure = F.signum(apart) * F.greatest(F.lit(0.0), F.abs(apart) - Z * F.sqrt(1 / a + 1 / b))
        share = 1 / (1 + F.exp(-(F.log(backing / (1 - backing)) + sure)))
        return rows.select("key", share.alias("share"), F.abs(sure).alias("apart"))

    levels = []
    for number, length in enumerate([*STEMS, None]):
        is_word = F.endswith("key", F.lit("$"))
        rows = counts.where(is_word if length is None else ~is_word & (F.length("key") == length))
        backing = F.lit(root)
        for shorter in range(number):
            above = levels[shorter].select(F.col("key").alias(f"k{shorter}"), F.col("share").alias(f"s{shorter}"))
            rows = rows.join(above, _stem(F.col("key"), STEMS[shorter]) == F.col(f"k{shorter}"), "left")
            backing = F.coalesce(F.col(f"s{shorter}"), backing)
        levels.append(estimate(rows, backing))

    every = levels[0].union(levels[1]).union(levels[2])
    odds = F.log(F.col("share") / (1 - F.col("share"))) - F.lit(math.log(root / (1 - root)))
    odds = every.select("key", "apart", odds.alias("odds"))
    # no more rows than the examples have words; Spark's hash has the seed 42
    kept = odds.where(F.col("apart") >= DIFFERENT).select(F.xxhash64("key").alias("hash"), "odds").toArrow()
    return Model(kept.column("hash").to_numpy(), kept.column("odds").to_numpy()), chosen.where(calibrating)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time.

    They are disjoint, each scores more than any of its proper sub-segments,
    and none can be extended to a better one.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    earlier: list[int] = []  # the last one before it whose sum before is smaller
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, before, after = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = earlier[j]
            if j < 0 or found[j][3] >= after:
                found.append((start, end, before, after))
                earlier.append(j)
                break
            start, before = found[j][0], found[j][2]
            del found[j:], earlier[j:]
    return [(start, end, after - before) for start, end, before, after in found]


_SEGMENTS = "array<struct<start:int,end:int,score:double>>"


def _scan(model: Model) -> Callable:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=_BYTES):
            # the slice's distinct words are scored once
            number: dict[str, int] = {}
            texts = []
            for text in batch.column("text"):
                found = words(text.as_py())
                texts.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
            scores = model.score(list(number))
            segments = [[{"start": a, "end": b, "score": s} for a, b, s in maximal_segments(scores[t])] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(list(map(len, texts)), pa.int64()), pa.array(segments, kind)],
                names=["doc_id", "digest", "n_words", "segments"],
            )

    return run


def extreme_values(best: np.ndarray, size: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Lambda and K by maximum likelihood, if P(best <= x) = exp(-K * size * exp(-lambda * x))."""
    mean = np.average(best, weights=count)

    def tilted(decay: float) -> float:
        weight = count * size * np.exp(-decay * (best - best.min()))
        return mean - np.average(best, weights=weight) - 1 / decay

    low, high = 0.05, 5.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if tilted(middle) > 0 else (middle, high)
    return high, float(count.sum() / (count * size * np.exp(-high * best)).sum())


def _logistic(rows: list) -> tuple[float, float]:
    """Slope and intercept for label counts by evidence (z, toxic, clean), with a weak pull to zero."""
    z = np.array([r.z for r in rows], float)
    y, n = np.array([r.toxic for r in rows], float), np.array([r.toxic + r.clean for r in rows], float)
    x = np.stack([z, np.ones_like(z)], axis=1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - n * p) - 1e-2 * beta
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, the significant passages as spans of words, and a text's digest."""
    small_batches(docs, PIPED_BYTES)
    text = filled(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    fitted = fit_words(rows.drop("digest"), labels)
    base = [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")]
    if fitted is None:
        return rows.select(
            *base, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(None).cast("long").alias("n_words"),
            F.lit(None).cast(_SEGMENTS).alias("passages"), "digest",
        )
    model, chosen = fitted
    scanned = settle(rows.mapInArrow(_scan(model), f"doc_id long, digest string, n_words long, segments {_SEGMENTS}"), "segments")
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s.score)), F.lit(0.0))
    size = F.greatest(F.col("n_words"), F.lit(1))
    known = scanned.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    # steps of best score and of length: a table of bounded size, whatever the number of examples
    table = (
        known.where("NOT toxic")
        .groupBy((F.round(F.least(best, F.lit(50.0)) * 5) / 5).alias("best"), F.round(F.log2(size) * 2).alias("size"))
        .count()
        .collect()
    )
    columns = [np.array([f(r) for r in table], float) for f in (lambda r: r[0], lambda r: 2 ** (r[1] / 2), lambda r: r[2])]
    decay, space = extreme_values(*columns) if table else (1.0, 1.0)
    log_space = F.log(F.lit(space) * size)

    def rarity(score: Column) -> Column:
        return F.lit(decay) * score - log_space

    def evidence(rows: DataFrame) -> DataFrame:
        passages = F.filter("segments", lambda s: rarity(s.score) >= -math.log(SIGNIFICANT))
        total = F.aggregate("passages", F.lit(0.0), lambda held, s: held + rarity(s.score))
        z = F.when(F.size("passages") > 0, total).otherwise(rarity(best))
        return rows.withColumn("passages", passages).withColumn("z", F.greatest(F.lit(-40.0), F.least(F.lit(60.0), z)))

    # at most a few hundred rows: evidence in steps of a quarter
    steps = (
        evidence(known).groupBy((F.round(F.col("z") * 4) / 4).alias("z"))
        .agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean"))
        .collect()
    )
    slope, intercept = _logistic(steps)
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("z") + F.lit(intercept))))
    return evidence(scanned).select(*base, score.alias("score"), "n_words", "passages", "digest").select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "passages", "digest"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with columns unchanged; rows without id stay."""
    toxic = score_toxicity(docs, labels).where("predicted = 1 AND doc_id IS NOT NULL")
    toxic = toxic.select(F.col("doc_id").alias("toxic_id"), F.col("digest").alias("toxic_digest")).distinct()
    same = (docs["doc_id"] == F.col("toxic_id")) & (F.sha2(filled(docs["text"]), 256) == F.col("toxic_digest"))
    return docs.join(toxic, same, "left_anti")
