"""Cross-entropy difference of two matched n-gram models.

The target model counts the documents labelled good, the background model all
documents. Both share one vocabulary, and every word and word pair has counts
of its own, held under its 64-bit hash. Background counts are scaled to the
target's size, so that both models are smoothed alike. A document's score is
the mean over its words of the loss under the target model minus the loss
under the background model: the lower, the more it reads like the target.

P(w | v) = (n(v, w) + MU * P(w)) / (n(v) + MU), and P(w) is smoothed by
2**-WORD_BITS of a count for each word. A text's first word follows a start mark.

1. Documents are dealt to blocks by a hash. A block counts its distinct words,
   pairs, and all its words, for both models.
2. Counts are dealt by ranges of the hash to parts, a row for each block and
   part, and summed there. A block names a key once, however common it is; the
   part of a very common key still gets it from every block. Each block is sent
   the sums of the keys it named.
3. A block scores its documents from those sums.

Blocks and parts grow in number with the input, not in size, and the rows between
them with the product of both numbers until each holds few keys; nothing but the
input's size in bytes comes to the driver. Numbers travel as compressed planes
of their bytes, as they would be several times the texts.

Defined results: words are runs of other characters than blank, tab to
carriage return, with A to Z as a to z. A null or empty text has no words and
scores 0, as do all texts if there is no target document. A document is good
if one of its label rows says so. Repeated rows count and score each. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm.common import filled, small_batches
from loresift.llm.shingles import mix, word_hashes

#: A word's share in the smoothing of P(w), as a power of two.
WORD_BITS = 16
#: The weight of the one-word distribution in that of pairs, in words.
MU = 50.0
#: Bytes of text of a block, and bytes of text whose counts make a part.
BLOCK_BYTES = 8 << 20
PART_BYTES = 16 << 20
#: Blocks and parts of small inputs, so that many tasks share them.
LEAST_BLOCKS, LEAST_PARTS = 64, 256
_START = np.uint64(0x5DEECE66D)
_TOTAL = np.uint64(0x2545F4914F6CDD1D)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)

_COUNTS = "part int, block int, n int, keys binary, counts binary"
_SUMS = "block int, part int, n int, others binary"
_SCORES = "doc_id long, n_words long, target_loss double, background_loss double, score double"


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes: all first bytes, all second bytes and so on."""
    planes = numbers.reshape(-1, 1).view(np.uint8).T
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(planes), asbytes=True)


def unpacked(data: bytes, kind: type, rows: int, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(data, width * rows * n)
    planes = np.frombuffer(planes, np.uint8).reshape(width, rows * n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(rows, n)


@dataclass
class Tokens:
    """A block's texts: distinct words (and the start mark) and pairs, and each word's place among them."""

    ids: pa.Array
    good: np.ndarray
    begin: np.ndarray
    words: np.ndarray
    own: np.ndarray
    before: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    pair: np.ndarray

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the words, the pairs and the number of words, in ascending order; and that order."""
        keys = np.concatenate([mix(self.words, 11), self.pairs, [_TOTAL]])
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def counts(self) -> np.ndarray:
        """Rows by key: how often in the target and in the background, and how often as a text's last word in each.

        The start mark counts as often as it has a word after it.
        """
        sizes = np.diff(self.begin)
        last = self.own[self.begin[1:][sizes > 0] - 1]
        out = np.zeros((4, len(self.words) + len(self.pairs) + 1), np.int32)
        for row, texts in ((0, self.good), (1, np.ones_like(self.good))):
            among = np.repeat(texts, sizes)
            out[row, : len(self.words)] = np.bincount(self.own[among], minlength=len(self.words))
            out[row, self.start] = (texts & (sizes > 0)).sum()
            out[row, len(self.words) : -1] = np.bincount(self.pair[among], minlength=len(self.pairs))
            out[row, -1] = among.sum()
            out[row + 2, : len(self.words)] = np.bincount(last[texts[sizes > 0]], minlength=len(self.words))
        return out

    @property
    def start(self) -> int:
        return int(np.searchsorted(self.words, _START))


def tokens(block: pa.Table) -> Tokens:
    """Of a block's documents. Its rows without text name the good ones."""
    docs = block.filter(pc.is_valid(block.column("text")))
    named = block.filter(pc.is_null(block.column("text"))).column("doc_id")
    good = pc.is_in(docs.column("doc_id"), value_set=named.combine_chunks()).to_numpy()
    hashes, begin = word_hashes(docs.column("text").combine_chunks())
    words, own = np.unique(np.append(hashes, _START), return_inverse=True)
    start, own = own[-1], own[:-1]
    before = np.append(start, own)[:-1]
    before[begin[:-1][np.diff(begin) > 0]] = start
    both = mix(words[before] * _MULTIPLY + words[own], 12)
    pairs = np.unique(both, return_index=True, return_inverse=True)
    return Tokens(docs.column("doc_id").combine_chunks(), good, begin, words, own, before, *pairs)


def _cuts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Parts of keys in ascending order, and where the keys of each begin and end."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    return part[begin], list(zip(begin.tolist(), [*begin[1:].tolist(), len(part)], strict=True))


def _counter(parts: int) -> Callable:
    def count(block: pa.Table) -> pa.Table:
        found = tokens(block)
        keys, order = found.keys()
        counts = found.counts()[:, order]
        part, cuts = _cuts(keys, parts)
        columns = [
            pa.array(part),
            pa.array(np.full(len(part), block.column("block")[0].as_py(), np.int32)),
            pa.array([b - a for a, b in cuts], pa.int32()),
            pa.array([packed(keys[a:b]) for a, b in cuts], pa.binary()),
            pa.array([packed(np.ascontiguousarray(counts[:, a:b])) for a, b in cuts], pa.binary()),
        ]
        return pa.table(columns, names=["part", "block", "n", "keys", "counts"])

    return count


def _add(part: pa.Table) -> pa.Table:
    """Of a part: for each block what the other blocks counted of the keys it named, in its order."""
    sizes = part.column("n").to_pylist()
    keys = [unpacked(k, np.uint64, 1, n)[0] for k, n in zip(part.column("keys").to_pylist(), sizes, strict=True)]
    counts = [unpacked(c, np.int32, 4, n) for c, n in zip(part.column("counts").to_pylist(), sizes, strict=True)]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros((4, len(distinct)), np.int64)
    for row in range(4):
        sums[row] = np.bincount(place, np.concatenate([c[row] for c in counts]), len(distinct))
    ends = np.cumsum(sizes)
    others = [packed(sums[:, place[e - n : e]] - own) for own, e, n in zip(counts, ends, sizes, strict=True)]
    columns = [part.column("block"), part.column("part"), part.column("n"), pa.array(others, pa.binary())]
    return pa.table(columns, names=["block", "part", "n", "others"])


def _score(block: pa.Table, sums: pa.Table) -> pa.Table:
    found = tokens(block)
    _, order = found.keys()
    counts = found.counts().astype(np.float64)
    sums = sums.sort_by("part")
    others = zip(sums.column("others").to_pylist(), sums.column("n").to_pylist(), strict=True)
    counts[:, order] += np.concatenate([unpacked(o, np.int64, 4, n) for o, n in others], axis=1)
    sizes = np.diff(found.begin)
    if counts[0, -1]:
        counts[[1, 3]] *= counts[0, -1] / counts[1, -1]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        own, before = found.own[found.first], found.before[found.first]
        means = []
        for n, last in zip(counts[:2], counts[2:], strict=True):
            chance = (n[own] + 2.0**-WORD_BITS) / (n[-1] + 1)
            losses = -np.log((n[len(found.words) : -1] + MU * chance) / (n[before] - last[before] + MU))
            means.append(np.bincount(owner, losses[found.pair], len(sizes)) / np.maximum(sizes, 1))
    else:
        sizes, means = np.zeros_like(sizes), [np.zeros(len(sizes))] * 2
    return pa.table(
        [found.ids, pa.array(sizes), *map(pa.array, means), pa.array(means[0] - means[1])],
        names=["doc_id", "n_words", "target_loss", "background_loss", "score"],
    )


def good_documents(labels: DataFrame) -> DataFrame:
    """Ids of the documents that make the target model."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL")
    return good.select(F.col("doc_id").cast("long").alias("label_id")).distinct()


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: n_words, mean loss under both models, and their difference."""
    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = max(LEAST_BLOCKS, size // BLOCK_BYTES), max(LEAST_PARTS, size // PART_BYTES)
    # by what a row holds, so that a task that runs anew deals alike
    keyed = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")
    good = keyed.select("block", "doc_id").join(good_documents(labels), F.col("doc_id") == F.col("label_id"))
    named = good.select("block", "doc_id", F.lit(None).cast("string").alias("text")).distinct()
    dealt = keyed.union(named)
    counts = dealt.groupBy("block").applyInArrow(_counter(parts), _COUNTS)
    sums = counts.groupBy("part").applyInArrow(_add, _SUMS)
    return dealt.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_score, _SCORES)
