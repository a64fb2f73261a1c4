"""Packing token sequences: first-fit decreasing in randomised groups of documents.

Documents are encoded, cut into full sequences and one remainder, and the
pieces are dealt at random to groups of bounded size. The draw is a hash of the
piece and its task, so that a task that runs again draws the same. Each group
packs its remainders by itself: first-fit decreasing, with a tournament tree
over the room left in the bins. Bins that stay too empty are taken apart and
their pieces cut anew, so padding stays small whatever the lengths are.

Defined results: a null text counts as empty and gives the end id alone.
Repeated rows are packed once each. Every id of every document lies in exactly
one piece. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm.common import PIPED_BYTES, filled, slices, small_batches
from loresift.llm.encoding import encoder
from loresift.llm.shingles import mix

#: Documents of a group on average, and bytes of their texts if that makes more groups.
GROUP_DOCS = 1024
GROUP_BYTES = 4 << 20
#: Bins less full than this are taken apart.
MIN_FILL = 0.98
#: Tasks encode about this many bytes of text at once.
_BYTES = 4 << 20

_CUT = pa.schema(
    [("group", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
     ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
)
_PACKED = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)
_CUT_SQL = "group long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PACKED_SQL = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def first_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers, each item in the first bin with room, longest items first.

    The tree's leaves are the bins and each inner node has the most room of
    its leaves, so the first bin with enough room is one walk from the root.
    """
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    room = [size] * (2 * leaves)
    bins: list[list[int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need, node = lengths[item], 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        if node - leaves == len(bins):
            bins.append([])
        bins[node - leaves].append(item)
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins


def _cutter(path: str, chunks: str | None, size: int, end_id: int, groups: int, seed: int, keep_ids: bool) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path, chunks).encode, TaskContext.get().partitionId()
        for batch in slices(batches, limit=_BYTES):
            ids, ends = encode(batch.column("text"))
            ids = np.insert(ids, ends[1:], end_id).astype("<u4", copy=False)
            ends = ends + np.arange(len(ends))
            totals = np.diff(ends)
            pieces = -(-totals // size)
            row = np.repeat(np.arange(len(totals)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
            begin = ends[row] + start
            length = np.minimum(totals[row] - start, size)
            crc = np.fromiter((zlib.crc32(ids[a : a + n]) for a, n in zip(begin, length, strict=True)), np.int64, len(row))
            doc_id = batch.column("doc_id").take(pa.array(row))
            drawn = mix(pc.fill_null(doc_id, -1).to_numpy().view(np.uint64), seed)
            drawn = mix(drawn + start.view(np.uint64)) + mix(crc.view(np.uint64), task)
            kept = np.full(len(row), True) if keep_ids else length < size
            data = ids.view(np.uint8)
            held = [data[4 * a : 4 * (a + n)].tobytes() if k else None for a, n, k in zip(begin, length, kept, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((mix(drawn) % np.uint64(groups)).astype(np.int64)), doc_id, pa.array(start), pa.array(length),
                 pa.array(crc), pa.array(totals[row]), pa.array(held, pa.binary())],
                schema=_CUT,
            )

    return cut


def _packer(size: int, min_fill: float, keep_ids: bool) -> Callable:
    def pack(table: pa.Table) -> pa.Table:
        # a fixed order, whatever order the shuffle delivers
        order = pc.sort_indices(table, [(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        table = table.take(order).combine_chunks()
        start, length, crc = (table.column(c).to_numpy() for c in ("start", "length", "ids_crc32"))
        base = table.column("group")[0].as_py() << 32
        full, short = np.flatnonzero(length == size), np.flatnonzero(length < size)
        # of whole pieces: row, sequence, offset
        row, sequence, offset = full.tolist(), list(range(len(full))), [0] * len(full)
        sequences, loose = len(full), []
        for items in first_fit_decreasing(length[short].tolist(), size):
            lengths = length[short[items]]
            if lengths.sum() < min_fill * size:
                loose += items
                continue
            row += short[items].tolist()
            sequence += [sequences] * len(items)
            offset += [0, *np.cumsum(lengths)[:-1].tolist()]
            sequences += 1
        # of pieces cut anew also their place in the piece, length and ids
        cut, at = [], 0
        for item in short[loose].tolist():
            done, data = 0, table.column("ids")[item].as_py()
            while done < length[item]:
                take = int(min(size - at, length[item] - done))
                cut.append((item, sequences, at, done, take, data[4 * done : 4 * (done + take)]))
                done, at = done + take, at + take
                if at == size:
                    sequences, at = sequences + 1, 0
        again = [list(c) for c in zip(*cut, strict=True)] or [[]] * 6
        row = np.array(row, np.int64)
        every = np.concatenate([row, np.array(again[0], np.int64)])
        first, new_ids = np.array(again[3], np.int64), again[5]
        ids = pa.chunked_array([*table.column("ids").take(pa.array(row)).chunks, pa.array(new_ids, pa.binary())], pa.binary())
        return pa.Table.from_arrays(
            [table.column("doc_id").take(pa.array(every)),
             pa.array(np.concatenate([start[row], start[every[len(row):]] + first])),
             pa.array(np.concatenate([length[row], np.array(again[4], np.int64)])),
             pa.array(np.concatenate([crc[row], np.array([zlib.crc32(x) for x in new_ids], np.int64)])),
             table.column("doc_tokens").take(pa.array(every)),
             pa.array(base + np.array(sequence + again[1], np.int64)),
             pa.array(np.array(offset + again[2], np.int64)),
             ids if keep_ids else pa.nulls(len(every), pa.binary())],
            schema=_PACKED,
        )

    return pack


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    chunks: str | None,
    size: int = 2048,
    end_id: int = 1,
    group_docs: int = GROUP_DOCS,
    min_fill: float = MIN_FILL,
    seed: int = 17,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: where it comes from, its sequence and offset there, and its ids.

    ``ids`` are little-endian unsigned 32-bit numbers, null unless ``keep_ids``.
    ``chunks`` says where the tokenizer allows a text to be cut (see ``encoding``).
    """
    small_batches(docs, PIPED_BYTES)
    size_of = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).head()
    groups = max(1, math.ceil(size_of.docs / group_docs), math.ceil(size_of.bytes / GROUP_BYTES))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text")).mapInArrow(
        _cutter(tokenizer_path, chunks, size, end_id, groups, seed, keep_ids), _CUT_SQL
    )
    return cut.groupBy("group").applyInArrow(_packer(size, min_fill, keep_ids), _PACKED_SQL)
