"""Token ids as ORC files in document order.

Documents are laid out in ranges of ``doc_id`` and encoded where they land.
Each ORC stripe stores the ids with integer run-length encoding, with row
indexes and a Bloom filter on ``doc_id``, so a reader takes single stripes and
skips those that cannot hold a document.

Defined results: a null text counts as empty and gives the end id alone. Null
ids come first; rows that repeat an id are kept, ordered by a hash of the
text. An empty table gives files without rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loresift.llm.common import filled, slices, small_batches
from loresift.llm.encoding import encoder

#: block and row give a document's place: block by block, row by row.
SCHEMA = "doc_id long, block int, row long, ids array<int>"
#: Tasks encode about this many bytes of text at once.
_BYTES = 4 << 20
_FILE = pa.schema(
    [("doc_id", pa.int64()), ("block", pa.int32()), ("row", pa.int64()), ("ids", pa.list_(pa.int32()))]
)
ORC = {
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "compression": "zstd",
}


def _encode(path: str, chunks: str | None, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, chunks).encode
        block, row = TaskContext.get().partitionId(), 0
        for batch in slices(batches, limit=_BYTES):
            ids, ends = encode(batch.column("text"))
            ids = np.insert(ids, ends[1:], end_id).view(np.int32)
            offsets = (ends + np.arange(len(ends))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(batch.num_rows, block, np.int32)),
                    pa.array(np.arange(row, row + batch.num_rows)),
                    pa.ListArray.from_arrays(offsets, pa.array(ids)),
                ],
                schema=_FILE,
            )
            row += batch.num_rows

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, chunks: str | None, end_id: int = 0) -> None:
    """Encode all texts, each followed by ``end_id``, into ORC files below ``path``."""
    small_batches(docs)
    text = filled(F.col("text"))
    order = ["doc_id", "tie"]
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(_encode(tokenizer_path, chunks, end_id), SCHEMA)
        .write.options(**ORC)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the files; filters on ``doc_id`` skip stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        ends, data = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
        sums = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("block"), batch.column("row"),
             pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())],
            names=["doc_id", "block", "row", "n_tokens", "ids_crc32"],
        )


def document_spans(spark: SparkSession, path: str) -> DataFrame:
    """Where each document's ids begin in the whole sequence, how many they are, and their CRC-32."""
    tokens = read_tokens(spark, path)
    blocks = tokens.groupBy("block").agg(F.sum(F.size("ids").cast("long")).alias("total"))
    # one row per written block, so the single task here is small
    before = F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select(F.col("block"), F.coalesce(before, F.lit(0)).alias("before"))
    documents = tokens.mapInArrow(_checksums, "doc_id long, block int, row long, n_tokens long, ids_crc32 long")
    within = Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        documents.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(starts, "block")
        .select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
    )
