"""Source trees: a listing first, contents only for the files that pass the gates.

Spark's own file sources hide names that begin with ``_`` (``__init__.py``), so
folders are listed by tasks of our own, in rounds: each is a job over the
folders that the one before found, dealt evenly. Any file system pyarrow can
open will do; on a cluster that is storage all executors see.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.session import settled

_BATCH_BYTES = 8 * 1024 * 1024
_LISTING_ROWS = 4096


def _open(root: str):
    if "://" in root:
        filesystem, base = fs.FileSystem.from_uri(root)
    else:
        filesystem, base = fs.LocalFileSystem(), root
    return filesystem, base.rstrip("/") or "/"


#: What is gone or may not be read is passed over. Any other error fails the task, so that it runs again.
GONE = (FileNotFoundError, NotADirectoryError, PermissionError)

#: A repository's own folder is not listed, but for its exclude rules.
GIT_FOLDER = ".git"
EXCLUDE_FILE = f"{GIT_FOLDER}/info/exclude"


def _is_link(filesystem, path: str) -> bool:
    return isinstance(filesystem, fs.LocalFileSystem) and os.path.islink(path)


def _children(filesystem, path: str) -> list:
    """Plain files and folders; links are left out, so that nothing is listed twice or without end."""
    try:
        found = filesystem.get_file_info(fs.FileSelector(path, recursive=False))
    except GONE:  # the folder is passed over
        return []
    children = []
    for info in found:
        if _is_link(filesystem, info.path):
            continue
        if info.base_name == GIT_FOLDER and info.type == fs.FileType.Directory:
            info = filesystem.get_file_info(f"{path}/{EXCLUDE_FILE}")
        children.append(info)
    return children


_ENTRIES = "path string, rel_path string, size_bytes bigint, mtime timestamp, is_dir boolean"


def _entries(batches: Iterator[pa.RecordBatch], filesystem, base: str) -> Iterator[pa.RecordBatch]:
    """The files and folders right below each ``path``."""
    prefix = base.rstrip("/") + "/"
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            for info in _children(filesystem, path):
                if info.type in (fs.FileType.File, fs.FileType.Directory):
                    is_dir = info.type == fs.FileType.Directory
                    rows.append((info.path, info.path.removeprefix(prefix), info.size, info.mtime, is_dir))
                if len(rows) >= _LISTING_ROWS:
                    yield _entry_batch(rows)
                    rows = []
        if rows:
            yield _entry_batch(rows)


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.bool_()]
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.record_batch(columns, names=["path", "rel_path", "size_bytes", "mtime", "is_dir"])


def list_tree(spark: SparkSession, root: str, kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(path, rel_path, size_bytes, mtime)`` of every regular file below ``root``, listed once.

    ``kept`` is given what each round found, with ``is_dir``, and leaves out
    rows; folders that it leaves out are never opened.
    """
    _, base = _open(root)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _entries(batches, _open(root)[0], base)

    folders, rounds = spark.createDataFrame(pa.table({"path": [base]})), []
    while True:
        found = settled(folders.repartition(reading_tasks(spark), "path").mapInArrow(look, _ENTRIES), "listing")
        if kept:
            found = settled(kept(found), "listing")
        rounds.append(found.filter("NOT is_dir").drop("is_dir"))
        folders = found.filter("is_dir").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, rounds)


def with_sizes(files: DataFrame, root: str) -> DataFrame:
    """Add ``size_bytes`` to rows with a ``path``; rows whose file is gone drop out."""
    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes) + ", size_bytes bigint"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _open(root)
        for batch in batches:
            found = filesystem.get_file_info(batch.column("path").to_pylist())
            kept = [
                row for row, info in enumerate(found)
                if info.type == fs.FileType.File and not _is_link(filesystem, info.path)
            ]
            sizes = pa.array([found[row].size for row in kept], pa.int64())
            yield _with_column(batch, kept, "size_bytes", sizes)

    return files.mapInArrow(look, schema)


def reading_tasks(spark: SparkSession) -> int:
    """How many tasks read files. The adaptive planner would go by the size of
    the paths alone and leave all the reading to a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """Add the bytes of each listed file as ``content``; files that are gone or may not be read drop out.

    The listing is spread out by path first: one directory may hold most of
    the files, and listing tasks are per directory.
    """
    columns = files.columns
    spread = files.repartition(reading_tasks(files.sparkSession), "path")
    schema = ", ".join(f"`{n}` {t}" for n, t in spread.dtypes) + ", content binary"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _contents(batches, _open(root)[0])

    return spread.mapInArrow(load, schema).select(*columns, "content")


def _contents(batches: Iterator[pa.RecordBatch], filesystem) -> Iterator[pa.RecordBatch]:
    """Batches with the bytes of each ``path``, without files that can't be opened; one that can't be read through is an error."""
    for batch in batches:
        kept, contents, held = [], [], 0
        for row, path in enumerate(batch.column("path").to_pylist()):
            try:
                stream = filesystem.open_input_stream(path)
            except GONE:
                continue
            with stream:
                data = stream.read()
            kept.append(row)
            contents.append(data)
            held += len(data)
            if held >= _BATCH_BYTES:
                yield _with_column(batch, kept, "content", pa.array(contents, pa.binary()))
                kept, contents, held = [], [], 0
        if kept:
            yield _with_column(batch, kept, "content", pa.array(contents, pa.binary()))


def _with_column(batch: pa.RecordBatch, kept: list[int], name: str, values: pa.Array) -> pa.RecordBatch:
    taken = pa.Table.from_batches([batch]).take(pa.array(kept, pa.int64()))
    columns = [column.combine_chunks() for column in taken.columns] + [values]
    return pa.RecordBatch.from_arrays(columns, names=[*taken.column_names, name])
