"""Bring an index up to the transcripts that lie below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loresift.operators.changes import detect_changes
from loresift.operators.transcripts import extract_documents
from loresift.plans.store import StoredIndex
from loresift.session import settled
from loresift.sources.jsonl import list_transcripts, read_lines_of


def refresh(index: StoredIndex, root: str) -> DataFrame:
    """Read what is new or changed below ``root``, drop what is gone; returns ``(file_path, change)``.

    The listing is compared with the manifest that earlier loads left in the
    index, so only changed files are opened. A file that changes again while
    it is read differs from its listing and is found by the next refresh.
    """
    listing = list_transcripts(index.spark, root)
    found = detect_changes(listing, index.manifest()).join(listing, "file_path", "left")
    changes = settled(found.select("file_path", "change", "mtime", "size_bytes"), "changes")
    live = changes.filter("change <> 'removed'").select("file_path")
    index.replace_files(extract_documents(read_lines_of(live, root)), changes.select("file_path"), changes)
    return changes.select("file_path", "change")
