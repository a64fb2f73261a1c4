"""Alignment of two tokenizers' tokens by the bytes they cover.

1. Texts are cut into chunks where neither tokenizer joins anything, so both
   have a token end at every cut. Tokens of distinct chunks are aligned once
   while they are in use.
2. The ends of A's tokens and those of B's are two sorted lists. Their merge is
   divided at equal distances (merge path): a binary search on each diagonal
   finds where a piece begins in both lists. All pieces are merged side by
   side, and each step emits an overlap of one A and one B token. What a piece
   cannot see, whether its first end equals the last one before it, is
   stitched at its boundary. Ends that both lists hold close a group.
3. Each block of texts reports its distinct id pairs with the number of its
   documents that hold them. Spark adds these up and finds each A id's highest
   count, and every block gets the counts of its own pairs back.

Token bytes: A's entries are read as byte-level, B's pieces as UTF-8 with
U+2581 for a blank and byte pieces as their byte. A gets a blank and the text,
B the text, before which its model puts a blank.

Defined results: texts that are null or empty, or that either tokenizer
changes, have no tokens: zeros, and an empty digest. Repeated rows count as
documents of their own. An empty table gives an empty result. Other columns
may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm.common import settle, slices, small_batches
from loresift.llm.encoding import Cuts, Memory, cut_texts, encoder

#: Ends that a piece merges.
PIECE = 64
#: Bytes of text of a block, whose pairs are counted together.
BLOCK_BYTES = 8 << 20
#: Links whose documents are counted at a time, of one document at least.
COUNTED = 1 << 18


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of the intervals that end at ``a`` with those that end at ``b``, both ascending and with the same last end.

    Returns the numbers of the two intervals of each overlap, in order, and the
    ends that both lists hold.
    """
    total = len(a) + len(b)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    diagonal = np.arange(0, total, piece)
    # on each diagonal: how many of a come before the piece; of equal ends a's is first
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # where a search is over, any place will do
        before = a[np.minimum(middle, len(a) - 1)] <= b[np.clip(diagonal - 1 - middle, 0, len(b) - 1)]
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    i, j = low, diagonal - low
    steps = min(piece, total)
    at_a, at_b = np.zeros((steps, len(i)), np.int64), np.zeros((steps, len(i)), np.int64)
    ends = np.full((steps, len(i)), -1, np.int64)
    for step in range(steps):
        next_a = np.where(i < len(a), a[np.minimum(i, len(a) - 1)], np.iinfo(np.int64).max)
        next_b = np.where(j < len(b), b[np.minimum(j, len(b) - 1)], np.iinfo(np.int64).max)
        at_a[step], at_b[step], ends[step] = i, j, np.minimum(next_a, next_b)
        of_a = next_a <= next_b
        i, j = i + of_a, j + ~of_a
    # piece after piece, in the order of the whole merge
    ends, at_a, at_b = (x.T.reshape(-1)[:total] for x in (ends, at_a, at_b))
    # stitched over the boundaries: an end that came just before closes both intervals and is no overlap
    again = np.zeros(total, bool)
    again[1:] = ends[1:] == ends[:-1]
    return at_a[~again], at_b[~again], ends[again]


def _byte_level() -> dict[str, int]:
    """The bytes that byte-level entries' characters stand for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(others)}


class Aligner:
    """Aligns the tokens of chunks; what it learnt for them is remembered."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = encoder(a_path, "spaced", plain=True), encoder(b_path, "pieces")
        level = _byte_level()
        self.a_said = {
            i: bytes(level[c] for c in entry)
            for entry, i in Tokenizer.from_file(a_path).get_vocab(with_added_tokens=False).items()
            if all(c in level for c in entry)
        }
        model = SentencePieceProcessor(model_file=b_path)
        self.b_said = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.b_said[i] = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        self.cuts = Cuts((0x20,))
        self.cuts.pairs = self.a.cuts.pairs & self.b.cuts.pairs
        self.memory = Memory(self._learn)

    def _learn(self, chunks: list[str]) -> pa.Array:
        a_ids = self.a.learn(chunks) if chunks else []
        b_ids = self.b.learn(chunks) if chunks else []
        good = np.ones(len(chunks), bool)
        for n, (chunk, x, y) in enumerate(zip(chunks, a_ids, b_ids, strict=True)):
            said = chunk.encode()
            if b"".join([self.a_said.get(i, b"") for i in x]) != said or b"".join([self.b_said[i] for i in y]) != said:
                a_ids[n], b_ids[n], good[n] = [], [], False
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a_ids, b_ids))
        a_flat, b_flat = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (a_ids, b_ids))
        a_ends = np.cumsum(np.fromiter((len(self.a_said[i]) for i in a_flat.tolist()), np.int64, len(a_flat)))
        b_ends = np.cumsum(np.fromiter((len(self.b_said[i]) for i in b_flat.tolist()), np.int64, len(b_flat)))
        link_a, link_b, shared = merge_path(a_ends, b_ends)
        # a chunk's last ends are shared, so no group and no overlap spans two chunks
        link_at = np.searchsorted(link_a, np.concatenate([[0], np.cumsum(n_a)]))
        a_cut, b_cut = np.searchsorted(a_ends, shared, "right").tolist(), np.searchsorted(b_ends, shared, "right").tolist()
        a_text, b_text = list(map(str, a_flat.tolist())), list(map(str, b_flat.tolist()))
        groups = [
            f"{','.join(a_text[p:q])}|{','.join(b_text[r:s])};"
            for p, q, r, s in zip([0, *a_cut], a_cut, [0, *b_cut], b_cut, strict=False)
        ]
        closed = np.searchsorted(a_cut, np.concatenate([[0], np.cumsum(n_a)]), "right") if len(a_cut) else np.zeros(len(n_a) + 1, int)
        pairs = (a_flat[link_a] << 32) | b_flat[link_b]
        return pa.StructArray.from_arrays(
            [
                pa.array(good),
                pa.array(n_a),
                pa.array(n_b),
                pa.array(np.diff(closed).astype(np.int64)),
                pa.ListArray.from_arrays(link_at.astype(np.int32), pa.array(pairs)),
                pa.array(["".join(groups[p:q]) for p, q in zip(closed[:-1], closed[1:], strict=True)], pa.large_string()),
            ],
            names=["good", "n_a", "n_b", "n_groups", "pairs", "groups"],
        )

    def align(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """What is known of the distinct chunks of texts that begin with a blank, their numbers in order, and each text's first."""
        chunks, first = cut_texts(texts, self.cuts)
        numbered = chunks.dictionary_encode()
        return self.memory.of(numbered.dictionary), numbered.indices.to_numpy(), first


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this worker process."""
    key = (a_path, b_path)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


_ALIGNED = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
     ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("chunks", pa.list_(pa.int32())),
     ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int32())),
     ("link_counts", pa.list_(pa.int32())), ("links", pa.list_(pa.int32()))]
)
_ALIGNED_SQL = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunks array<int>, "
    "pairs array<long>, held array<int>, link_counts array<int>, links array<int>"
)


def _spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers begin[i], begin[i] + 1, ... for each i, counts[i] of them."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + counts, counts)


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` from begin[i] to begin[i + 1]."""
    running = np.concatenate([[0], np.cumsum(values)])
    return running[begin[1:]] - running[begin[:-1]]


def _documents_of(
    doc: np.ndarray, chunk: np.ndarray, link_begin: np.ndarray, link_count: np.ndarray, links: np.ndarray, pairs: int
) -> np.ndarray:
    """How many documents hold each pair; ``doc`` ascends and names the chunks of each. Documents are taken in portions."""
    docs_of = np.zeros(pairs, np.int64)
    ends = np.cumsum(link_count[chunk])
    begin = 0
    while begin < len(doc):
        reached = np.searchsorted(ends, (ends[begin - 1] if begin else 0) + COUNTED, "right")
        # whole documents only: back to where the last one begins, or on to the end of a long one
        end = np.searchsorted(doc, doc[reached]) if reached < len(doc) else reached
        if end <= begin:
            end = np.searchsorted(doc, doc[begin], "right")
        some = chunk[begin:end]
        found = np.repeat(doc[begin:end], link_count[some]) * pairs + links[_spread(link_begin[some], link_count[some])]
        docs_of += np.bincount(np.unique(found) % max(1, pairs), minlength=pairs)
        begin = end
    return docs_of


def _align(a_path: str, b_path: str, limit: int) -> Callable:
    """Of each block a row for each document, with the numbers of its chunks, and one for all chunks.

    The latter has the block's distinct pairs, how many of its documents hold
    each, and the pairs that are linked in each chunk by their numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit=limit):
            info, codes, first = aligner(a_path, b_path).align(batch.column("text"))
            column = {f.name: info.field(f.name) for f in info.type}
            bad = ~column["good"].to_numpy(zero_copy_only=False)
            good = _sums(bad[codes].astype(np.int64), first) == 0
            lists = column["pairs"]
            link_begin = lists.offsets.to_numpy().astype(np.int64)
            link_count = np.diff(link_begin)
            pairs, links = np.unique(lists.values.to_numpy()[link_begin[0] : link_begin[-1]], return_inverse=True)
            link_begin = link_begin[:-1] - link_begin[0]

            text = column["groups"].take(pa.array(codes))
            ends = text.offsets.to_numpy() if hasattr(text, "offsets") else np.frombuffer(text.buffers()[1], np.int64)
            ends = ends[text.offset : text.offset + len(text) + 1]
            said = memoryview(text.buffers()[2] or b"")
            digests = [
                hashlib.sha256(said[ends[p] : ends[q] - 1]).hexdigest() if ok and q > p else ""
                for p, q, ok in zip(first[:-1], first[1:], good, strict=True)
            ]
            held = np.repeat(good, np.diff(first))
            doc_of = np.repeat(np.arange(len(good)), np.diff(first))[held]
            kept = codes[held]
            # of each document its distinct chunks, then its distinct pairs
            once = np.unique(doc_of * len(info) + kept) if len(info) else np.zeros(0, np.int64)
            doc, chunk = once // max(1, len(info)), once % max(1, len(info))
            docs_of = _documents_of(doc, chunk, link_begin, link_count, links, len(pairs))

            counted = [
                np.where(good, _sums(values[codes], first), 0)
                for values in (*(column[c].to_numpy() for c in ("n_a", "n_b", "n_groups")), link_count)
            ]
            chunk_ends = np.concatenate([[0], np.cumsum(np.where(good, np.diff(first), 0))])
            rows = len(good)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, block)), batch.column("doc_id"), *(pa.array(c) for c in counted), pa.array(digests, pa.string()),
                 pa.ListArray.from_arrays(chunk_ends.astype(np.int32), pa.array(kept, pa.int32())),
                 *(pa.nulls(rows, f.type) for f in list(_ALIGNED)[8:])],
                schema=_ALIGNED,
            )
            whole = [pairs, docs_of.astype(np.int32), link_count.astype(np.int32), links.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), *(pa.nulls(1, f.type) for f in list(_ALIGNED)[1:8]),
                 *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in whole)],
                schema=_ALIGNED,
            )
            block += 1

    return run


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
     ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]
)
_RESULT_SQL = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _weigh(aligned: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one block, with the counts of the block's pairs."""
    whole = aligned.column("pairs").is_valid()
    block, docs = aligned.filter(whole), aligned.filter(pc.invert(whole)).combine_chunks()
    pairs = len(block.column("pairs")[0])
    count, best = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    at = counts.column("pair_no").to_numpy()
    count[at] = counts.column("count").to_numpy()
    best[at] = counts.column("best").to_numpy(zero_copy_only=False)
    per_chunk, links = (block.column(c)[0].values.to_numpy() for c in ("link_counts", "links"))
    begin = np.concatenate([[0], np.cumsum(per_chunk, dtype=np.int64)])
    lists = docs.column("chunks").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy().astype(np.int64)
    chunks = lists.values.to_numpy()
    columns = {f.name: docs.column(f.name) for f in _RESULT if f.name in docs.column_names}
    columns["n_best"], columns["count_sum"] = (
        pa.array(_sums(_sums(x[links], begin)[chunks], ends)) for x in (best, count)
    )
    return pa.Table.from_arrays([columns[f.name] for f in _RESULT], schema=_RESULT)


def align(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of each row of ``docs`` its numbers of tokens, groups and links, and how its links fare in the whole table.

    A pair's count is the number of documents that hold it linked; ``n_best``
    are the links whose count is the highest of their A id.
    """
    small_batches(docs)
    text = F.col("text").cast("string")
    spaced = F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).otherwise(F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced.alias("text"))
    aligned = settle(texts.mapInArrow(_align(a_path, b_path, block_bytes), _ALIGNED_SQL), "aligned")
    # a row for each pair of each block, dealt once for the sums and for the way back
    pairs = (
        aligned.where("pairs IS NOT NULL")
        .select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("pair_no", "of"))
        .select("block", "pair_no", F.col("of.pairs").alias("pair"), F.col("of.held").cast("long").alias("held"))
        .where("held > 0")
        .repartition("pair")
    )
    counts = pairs.groupBy("pair").agg(F.sum("held").alias("count"))
    # no more rows than A has ids
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("highest"))
    weighed = (
        pairs.join(counts, "pair")
        .join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("a"))
        .select(F.col("block").alias("home"), "pair_no", "count", (F.col("count") == F.col("highest")).alias("best"))
    )
    return aligned.groupBy("block").cogroup(weighed.groupBy("home")).applyInArrow(_weigh, _RESULT_SQL)
