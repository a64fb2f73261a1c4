"""The two corpora and the columns their tables share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Corpus:
    """Column roles of one kind of document.

    ``keys`` identify a document and break score ties. ``scope`` are the
    columns corpus statistics are kept by. ``fields`` are exact-match or range
    columns; they are copied onto the postings so that filters reach that scan.
    ``unit`` are the columns of the key that a replacement replaces by.
    """

    name: str
    keys: tuple[str, ...]
    scope: tuple[str, ...]
    fields: tuple[str, ...]
    stored: tuple[str, ...]
    text: str
    unit: tuple[str, ...]
    snippet_chars: int

    @property
    def filterable(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.keys + self.fields))

    @property
    def carried(self) -> tuple[str, ...]:
        """Everything about a document but its text."""
        return tuple(dict.fromkeys(self.keys + self.fields + self.stored))


TRANSCRIPTS = Corpus(
    name="transcripts",
    keys=("file_path", "event_index"),
    scope=(),
    fields=("session_id", "project", "event_role", "timestamp", "cwd", "git_branch"),
    stored=(),
    text="text",
    unit=("file_path",),
    snippet_chars=140,
)

CODE = Corpus(
    name="code",
    keys=("repo", "branch", "file_path"),
    scope=("repo",),
    fields=("language", "size_bytes"),
    stored=("commit_sha",),  # kept for display, not searchable
    text="content",
    unit=("repo", "branch"),
    snippet_chars=160,
)

TRANSCRIPT_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("project", T.StringType(), False),
        T.StructField("event_role", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("cwd", T.StringType(), True),
        T.StructField("git_branch", T.StringType(), True),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("event_index", T.LongType(), False),
        T.StructField("text", T.StringType(), False),
    ]
)

CODE_SCHEMA = T.StructType(
    [
        T.StructField("repo", T.StringType(), False),
        T.StructField("branch", T.StringType(), False),
        T.StructField("commit_sha", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("language", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("size_bytes", T.LongType(), False),
    ]
)
