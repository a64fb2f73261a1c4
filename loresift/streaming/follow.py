"""Follow a stream of file changes: coalesce bursts, then replace what changed.

Spark's file source does not read a file again that was rewritten under its
name, so changes arrive as rows ``(file_path, kind, ts)`` of their own, from
whatever notices them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loresift.operators.transcripts import extract_documents
from loresift.plans.refresh import refresh
from loresift.plans.store import StoredIndex
from loresift.session import let_go, settled
from loresift.sources.jsonl import read_lines_of, split_lines

# Change kinds that matter, and how long a file must be quiet.
KINDS = ("create", "modify", "remove")
QUIET = "750 milliseconds"
QUIET_MILLIS = 750

_DUE = "file_path string, first_change timestamp, last_change timestamp, n_changes bigint"
_WAITING = "first_change timestamp, last_change timestamp, n_changes bigint"


def transcript_changes(changes: DataFrame) -> DataFrame:
    """Changes of transcript files that ask for a reindex."""
    return changes.filter(F.col("kind").isin(*KINDS) & F.col("file_path").endswith(".jsonl"))


def quiet_files(changes: DataFrame, quiet: str = QUIET, late: str = "10 seconds") -> DataFrame:
    """One row per burst of changes of a file, once it has been quiet long enough.

    Each change restarts the wait of its file. Works on a stream (append mode)
    and on a table alike.
    """
    bursts = changes.withWatermark("ts", late) if changes.isStreaming else changes
    # session windows that touch are merged, yet a file quiet for exactly this
    # long is due; the smallest unit of time less keeps the two apart
    window = F.session_window("ts", f"{quiet} -1 microseconds").alias("burst")
    grouped = bursts.groupBy("file_path", window)
    return grouped.agg(F.max("ts").alias("last_change"), F.count("*").alias("n_changes")).select(
        "file_path", F.col("burst.start").alias("first_change"), "last_change", "n_changes"
    )


def due_files(changes: DataFrame, quiet_millis: int = QUIET_MILLIS) -> DataFrame:
    """One row per burst of changes of a file, once no change has arrived for this long by the clock.

    A timer per file is set anew by each change, so the last burst of a quiet
    system is due as well, and no change comes too late, whatever its ``ts``.
    """

    def wait(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, count = state.get
            state.remove()
            yield pd.DataFrame({"file_path": [key[0]], "first_change": [first], "last_change": [last], "n_changes": [count]})
            return
        first, last, count = state.get if state.exists else (None, None, 0)
        for batch in batches:
            times = batch["ts"].dropna()
            if len(times):
                low, high = times.min().to_pydatetime(), times.max().to_pydatetime()
                first = low if first is None else min(first, low)
                last = high if last is None else max(last, high)
            count += len(batch)
        state.update((first, last, count))
        state.setTimeoutDuration(quiet_millis)

    grouped = changes.select("file_path", "ts").groupBy("file_path")
    return grouped.applyInPandasWithState(wait, _DUE, _WAITING, "append", GroupStateTimeout.ProcessingTimeTimeout)


def apply_versions(index: StoredIndex, versions: DataFrame) -> None:
    """Bring the index to the latest of the file versions in a batch.

    ``versions`` holds ``(file_path, kind, ts, content)``; content is the whole
    transcript, ignored for ``remove``. Applying a batch again changes nothing,
    and a version older than the one applied before is passed over.
    """
    latest = versions.groupBy("file_path").agg(
        F.max_by(F.struct("kind", "content"), F.struct("ts", "kind")).alias("last"), F.max("ts").alias("ts")
    )
    applied = index.applied_versions().select("file_path", F.col("ts").alias("applied"))
    latest = latest.join(applied, "file_path", "left").filter(F.col("applied").isNull() | (F.col("ts") >= F.col("applied")))
    # whole transcripts, which a cache would hold unpacked
    latest = settled(latest.drop("applied"), "latest")
    live = latest.filter(F.col("last.kind") != "remove").select("file_path", F.col("last.content").alias("value"))
    index.replace_files(extract_documents(split_lines(live)), latest.select("file_path", "ts"))
    let_go(latest)


def reindex_paths(index: StoredIndex, due: DataFrame, root: str) -> None:
    """Reindex the files in ``due`` from storage; those that are gone are dropped."""
    paths = due.select("file_path").distinct()
    index.replace_files(extract_documents(read_lines_of(paths, root)), paths)


def _each_batch(job: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """Run ``job`` on a micro-batch that is kept while it is used several times."""

    def run(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            job(kept)
        finally:
            kept.unpersist()

    return run


def follow_versions(index: StoredIndex, changes: DataFrame) -> DataStreamWriter:
    """Stream of file versions into the index, one replacement per micro-batch."""
    wanted = transcript_changes(changes)
    return wanted.writeStream.foreachBatch(lambda batch, _: apply_versions(index, batch))  # which reads the batch once


def follow_folder(index: StoredIndex, root: str) -> DataStreamWriter:
    """Keep an index up to the files below ``root``: first all of them, then what changes, one refresh per trigger.

    Nothing has to notice changes; a clock asks for listings. The trigger says how often.
    """

    def catch_up(batch: DataFrame, batch_id: int) -> None:
        refresh(index, root)

    clock = index.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(catch_up)


def follow_files(index: StoredIndex, changes: DataFrame, root: str, quiet_millis: int = QUIET_MILLIS) -> DataStreamWriter:
    """Stream of change notices into the index; files are read once they are quiet by the clock.

    The query needs a trigger that goes on, as timers fire between changes.
    """
    due = due_files(transcript_changes(changes), quiet_millis)
    return due.writeStream.outputMode("append").foreachBatch(
        _each_batch(lambda batch: reindex_paths(index, batch, root))
    )
