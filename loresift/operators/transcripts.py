"""Transcript lines to documents, in native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.functions.once import computed_once
from loresift.functions.paths import project_label
from loresift.functions.since import rfc3339
from loresift.functions.text import not_blank
from loresift.functions.variant import is_string, string_at
from loresift.schema import TRANSCRIPT_SCHEMA
from loresift.sources.jsonl import read_lines

# Roles whose text is the message content.
MESSAGE_ROLES = ("user", "assistant")


def _block_parts(item: Column) -> Column:
    """Text pieces of one content block; nulls stand for what it lacks."""
    name = string_at(item, "$.name")
    call_input = F.try_variant_get(item, "$.input", "variant")
    fields = F.array(
        string_at(item, "$.text"),
        string_at(item, "$.thinking"),
        F.concat(F.lit("[tool: "), name, F.lit("]")),
        F.when(name.isNotNull(), F.to_json(call_input)),
    )
    return F.when(is_string(item), F.array(F.try_variant_get(item, "$", "string"))).otherwise(fields)


def message_text(record: Column) -> Column:
    """Content of a message: a string as it is, an array of blocks joined by line ends."""
    blocks = F.try_variant_get(record, "$.message.content", "array<variant>")
    joined = F.array_join(F.flatten(F.transform(blocks, _block_parts)), "\n")
    return F.coalesce(string_at(record, "$.message.content"), joined)


def attachment_text(record: Column) -> Column:
    return F.concat_ws(
        "\n",
        string_at(record, "$.attachment.content"),
        F.nullif(string_at(record, "$.attachment.stdout"), F.lit("")),
        F.nullif(string_at(record, "$.attachment.stderr"), F.lit("")),
    )


def record_text(record: Column, role: Column) -> Column:
    return F.when(role.isin(*MESSAGE_ROLES), message_text(record)).when(
        role == "attachment", attachment_text(record)
    )


def extract_documents(lines: DataFrame) -> DataFrame:
    """Documents of numbered transcript lines ``(file_path, event_index, line)``.

    Lines that are no JSON, or hold no text, give no document.
    """
    parsed = computed_once(lines, record=F.try_parse_json("line")).filter(F.col("record").isNotNull())
    record = F.col("record")
    fields = parsed.select(
        F.coalesce(string_at(record, "$.sessionId"), F.lit("")).alias("session_id"),
        project_label(F.col("file_path")).alias("project"),
        F.coalesce(string_at(record, "$.type"), F.lit("unknown")).alias("event_role"),
        rfc3339(string_at(record, "$.timestamp")).alias("timestamp"),
        string_at(record, "$.cwd").alias("cwd"),
        string_at(record, "$.gitBranch").alias("git_branch"),
        "file_path",
        F.col("event_index").cast("bigint").alias("event_index"),
        "record",
    )
    texts = computed_once(fields, text=record_text(record, F.col("event_role")))
    return texts.filter(not_blank(F.col("text"))).select(*TRANSCRIPT_SCHEMA.fieldNames())


def load_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """Documents of every transcript file below ``root``."""
    return extract_documents(read_lines(spark, root))
