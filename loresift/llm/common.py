"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.session import scratch_path

#: Whitespace of the word and digest operators, as a class of a Java or Python pattern.
BLANK = r"\x20\x09-\x0D"

#: Tasks work through an Arrow batch in slices of about this many bytes of text.
SLICE_BYTES = 8 << 20
#: Bytes of an Arrow batch in the pipeline's stages, whose executors hold one stage's workers beside the next one's shuffles.
PIPED_BYTES = 4 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(rows: DataFrame, label: str) -> DataFrame:
    """Write rows to the shared folder and read them back.

    The plan above starts from files that outlive any executor, and a costly
    plan that feeds several branches runs once.
    """
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small_batches(rows: DataFrame, limit: int = SLICE_BYTES) -> None:
    """Let Arrow batches hold few bytes, as single texts may be long; a limit that the application has set stays.

    The setting stays with the session: plans are run after the operator has returned.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not rows.sparkSession.sparkContext.getConf().contains(name):
        rows.sparkSession.conf.set(name, str(limit))


def give_back() -> None:
    """Give back what Arrow holds unused: a worker waits for its next task beside the executor's other work."""
    pa.default_memory_pool().release_unused()


def filled(text: Column) -> Column:
    """The text, or the empty text where it is null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``limit`` bytes of the text column, at least one row each."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for row, length in enumerate(lengths):
            if size and size + length > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()
