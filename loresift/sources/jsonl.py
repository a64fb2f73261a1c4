"""Transcript files as numbered lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loresift.sources.tree import GONE, _open, list_tree, reading_tasks, with_sizes

#: Files are read in blocks of this size; a line belongs to the block it begins in.
BLOCK_BYTES = 64 * 1024 * 1024

SUFFIX = ".jsonl"
#: Bytes read at a time; lines of many files are handed on at a time, by their bytes and number.
_READ_BYTES = 4 * 1024 * 1024
_READ_LINES = 1 << 16
_LINES = "file_path string, event_index bigint, line string"


def _block_lines(stream, start: int, end: int) -> Iterator[bytes]:
    """Lines of an open file that begin at ``start`` or later and before ``end``."""
    at = max(0, start - 1)
    stream.seek(at)
    held, skipping = b"", start > 0
    while data := stream.read(_READ_BYTES):
        *lines, rest = (held + data).split(b"\n")
        for line in lines:
            if not skipping:
                if at >= end:
                    return
                yield line
            skipping = False
            at += len(line) + 1
        held = rest
        if at >= end and not skipping:
            return
    if held and not skipping and at < end:
        yield held


def _usable(line: bytes) -> str | None:
    """The line's text without a carriage return, or None if it is blank or no UTF-8."""
    try:
        text = line.removesuffix(b"\r").decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if not text or text.isspace() else text


def _opened(filesystem, path: str):
    """The file, or None if it is gone or may not be read. Any other error fails the task, so that it runs again."""
    try:
        return filesystem.open_input_file(path)
    except GONE:
        return None


def _read_blocks(blocks: DataFrame, root: str, block_bytes: int, counted: bool) -> DataFrame:
    """``(file_path, event_index, line)``: usable lines of ``blocks`` (path, file_path, block, lines_before).

    A file that was ``counted`` and is gone since is an error, as others of its blocks may have been read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _open(root)
        paths, nth, texts, held = [], [], [], 0
        for batch in batches:
            for path, file_path, block, before in zip(*(batch.column(c).to_pylist() for c in names)):
                stream = _opened(filesystem, path)
                if stream is None:
                    if counted:
                        raise FileNotFoundError(f"{path} went away while it was read")
                    continue
                with stream:
                    for number, line in enumerate(_block_lines(stream, block * block_bytes, (block + 1) * block_bytes)):
                        text = _usable(line)
                        if text is None:
                            continue
                        paths.append(file_path)
                        nth.append(before + number)
                        texts.append(text)
                        held += len(line)
                        if held >= _READ_BYTES or len(nth) >= _READ_LINES:
                            yield _line_batch(paths, nth, texts)
                            paths, nth, texts, held = [], [], [], 0
        if nth:
            yield _line_batch(paths, nth, texts)

    names = ["path", "file_path", "block", "lines_before"]
    return blocks.select(*names).mapInArrow(read, _LINES)


def _line_batch(paths: list[str], nth: list[int], texts: list[str]) -> pa.RecordBatch:
    columns = [pa.array(paths, pa.string()), pa.array(nth, pa.int64()), pa.array(texts, pa.string())]
    return pa.record_batch(columns, names=["file_path", "event_index", "line"])


def _lines_begun(filesystem, path: str, block: int, block_bytes: int) -> int | None:
    """How many lines begin in a block, or None if its file is gone or may not be read."""
    stream = _opened(filesystem, path)
    if stream is None:
        return None
    at, end = max(0, block * block_bytes - 1), (block + 1) * block_bytes - 1
    n = int(block == 0)
    with stream:
        stream.seek(at)
        while at < end and (data := stream.read(min(_READ_BYTES, end - at))):
            n += data.count(b"\n")
            at += len(data)
    return n


def _count_lines(blocks: DataFrame, root: str, block_bytes: int) -> DataFrame:
    """``(path, file_path, block, n_lines)``: how many lines begin in each block, null if the file is gone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _open(root)
        for batch in batches:
            rows = zip(batch.column("path").to_pylist(), batch.column("block").to_pylist())
            counts = [_lines_begun(filesystem, path, block, block_bytes) for path, block in rows]
            columns = [batch.column(c) for c in ("path", "file_path", "block")]
            yield pa.record_batch([*columns, pa.array(counts, pa.int64())], names=["path", "file_path", "block", "n_lines"])

    schema = "path string, file_path string, block bigint, n_lines bigint"
    return blocks.select("path", "file_path", "block").mapInArrow(count, schema)


def _numbered(files: DataFrame, root: str, block_bytes: int) -> DataFrame:
    """Lines of ``(path, file_path, size_bytes)``. Every file is read the same way, in blocks.

    A file of one block needs no more; the blocks of longer ones are placed by
    the line counts of the blocks before. A file of which a block could not be
    opened is left out whole.
    """
    last = F.greatest(F.ceil(F.col("size_bytes") / block_bytes) - 1, F.lit(0))
    several = F.col("size_bytes") > block_bytes
    blocks = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    tasks = reading_tasks(files.sparkSession)
    spread = blocks.repartition(tasks, "path", "block")
    single = spread.filter(~several).withColumn("lines_before", F.lit(0).cast("bigint"))
    file = Window.partitionBy("file_path")
    before = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = _count_lines(spread.filter(several), root, block_bytes).select(
        "path", "file_path", "block", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("lines_before"),
        (F.count("*").over(file) == F.count("n_lines").over(file)).alias("whole"),
    )
    parts = placed.filter("whole").repartition(tasks, "path", "block")
    return _read_blocks(single, root, block_bytes, counted=False).unionByName(
        _read_blocks(parts, root, block_bytes, counted=True)
    )


def split_lines(texts: DataFrame, content: str = "value") -> DataFrame:
    """Numbered lines of whole texts held in one column, by the same rules: no shuffle."""
    lines = F.split(F.col(content), "\n")
    numbered = texts.select("file_path", F.posexplode(lines).alias("event_index", "line"))
    usable = numbered.filter(F.col("line").rlike(r"(?U)\S"))
    return usable.select("file_path", F.col("event_index").cast("bigint"), F.regexp_replace("line", "\r$", "").alias("line"))


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """Transcript files below ``root``, whatever their names begin with."""
    listing = list_tree(spark, root).filter(F.endswith("path", F.lit(SUFFIX)))
    return listing.select("path", F.col("path").alias("file_path"), "size_bytes", "mtime")


def read_lines(spark: SparkSession, root: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(file_path, event_index, line)`` of all ``*.jsonl`` files below ``root``.

    ``event_index`` is the 0-based physical line number; blank and undecodable
    lines count but are left out.
    """
    return _numbered(_listed(spark, root).drop("mtime"), root, block_bytes)


def read_lines_of(files: DataFrame, root: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Numbered lines of the files named in ``file_path`` that still exist below ``root``."""
    sized = with_sizes(files.select("file_path", F.col("file_path").alias("path")), root)
    return _numbered(sized, root, block_bytes)


def list_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """``(file_path, mtime, size_bytes)`` of the transcript files; contents are not read."""
    return _listed(spark, root).select("file_path", "mtime", "size_bytes")
