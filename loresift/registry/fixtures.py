"""The driver's tables in the shapes the operators work on."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.schema import CODE_SCHEMA, TRANSCRIPT_SCHEMA

#: The "now" of relative time bounds.
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)

#: Extensions and names paths are made up of.
PATH_TAILS = ["rs", "py", "tsx", "PNG", "lock", "md", "jsonc", "tar.gz", "weird", "h"]
PATH_NAMES = ["Makefile", "Dockerfile", "README", ".bashrc", "justfile"]


TEXTS = ("documents", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables. Those of texts are single files of one row group here, so they are dealt to all cores.

    The adaptive planner chooses the number of partitions, so that they don't grow with the table.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return rows.hint("rebalance") if name in TEXTS else rows


def session_path(conv_id: Column) -> Column:
    return F.concat(F.lit("/t/-srv-log-p"), conv_id % 5, F.lit("/"), conv_id, F.lit(".jsonl"))


def turn_time(conv_id: Column, turn: Column) -> Column:
    seconds = F.lit(1704067200) + conv_id * 3600 + turn * 60
    return F.timestamp_seconds(seconds)


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as transcript documents; system turns hold no document."""
    turns = table(spark, folder, "conversations").filter(F.col("role").isin("user", "assistant"))
    conv, turn = F.col("conv_id"), F.col("turn")
    return turns.select(
        conv.cast("string").alias("session_id"),
        F.concat(F.lit("srv/log/p"), conv % 5).alias("project"),
        F.col("role").alias("event_role"),
        turn_time(conv, turn).alias("timestamp"),
        F.lit(None).cast("string").alias("cwd"),
        F.lit(None).cast("string").alias("git_branch"),
        session_path(conv).alias("file_path"),
        turn.alias("event_index"),
        "text",
    ).select(*TRANSCRIPT_SCHEMA.fieldNames())


def transcript_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as JSON lines.

    The content is a string, an array of blocks, or an attachment, by turn.
    """
    turns = table(spark, folder, "conversations")
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    header = [
        conv.cast("string").alias("sessionId"),
        F.date_format(turn_time(conv, turn), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit("/w").alias("cwd"),
        F.lit("main").alias("gitBranch"),
    ]
    plain = F.struct(F.col("role").alias("type"), *header, F.struct("role", text.alias("content")).alias("message"))
    blocks = F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text"), *_no_call()),
        F.struct(
            F.lit("tool_use").alias("type"),
            F.lit(None).cast("string").alias("text"),
            F.lit("Read").alias("name"),
            F.struct(turn.alias("line"), F.lit("/a b").alias("path")).alias("input"),
        ),
    )
    mixed = F.struct(F.col("role").alias("type"), *header, F.struct("role", blocks.alias("content")).alias("message"))
    attached = F.struct(text.alias("content"), F.lit("done").alias("stdout"), F.lit("").alias("stderr"))
    hook = F.struct(
        F.when(F.col("role") == "system", "system").otherwise("attachment").alias("type"),
        *header,
        attached.alias("attachment"),
    )
    line = F.when(turn % 3 == 0, F.to_json(plain)).when(turn % 3 == 1, F.to_json(mixed)).otherwise(F.to_json(hook))
    return turns.select(session_path(conv).alias("file_path"), turn.alias("event_index"), line.alias("line"))


def _no_call() -> list[Column]:
    call_input = F.lit(None).cast("struct<line: bigint, path: string>")
    return [F.lit(None).cast("string").alias("name"), call_input.alias("input")]


def code(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as source files, one repository per source."""
    documents = table(spark, folder, "documents")
    return documents.select(
        F.col("source").alias("repo"),
        F.lit("development").alias("branch"),
        F.lit("unknown").alias("commit_sha"),
        F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("file_path"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
    ).select(*CODE_SCHEMA.fieldNames())


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as paths of a source tree, with sizes that reach both gates."""
    doc_id = F.col("doc_id")
    tails = F.array(*[F.lit(t) for t in PATH_TAILS])
    names = F.array(*[F.lit(n) for n in PATH_NAMES])
    with_tail = F.concat(F.lit("f"), doc_id, F.lit("."), F.get(tails, (doc_id % len(PATH_TAILS)).cast("int")))
    by_name = F.get(names, (doc_id % len(PATH_NAMES)).cast("int"))
    name = F.when(doc_id % 7 == 0, by_name).otherwise(with_tail)
    parent = (
        F.when(doc_id % 11 == 0, ".hidden/")
        .when(doc_id % 13 == 0, "node_modules/lib/")
        .when(doc_id % 17 == 0, "src/build/")
        .otherwise("src/")
    )
    size = F.when(doc_id % 19 == 0, 0).when(doc_id % 23 == 0, 1_000_001).otherwise(F.octet_length("text"))
    rel_path = F.concat("source", F.lit("/"), parent, name)
    return table(spark, folder, "documents").select(
        "doc_id", rel_path.alias("rel_path"), size.cast("bigint").alias("size_bytes")
    )


def query_table(spark: SparkSession, folder: str) -> DataFrame:
    """One query per benchmark item: its whole text."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def file_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as file changes; clicks play changes that do not matter."""
    return table(spark, folder, "events").select(*change_columns())


def change_columns() -> list[Column]:
    kind = (
        F.when(F.col("event_type") == "view", "modify")
        .when(F.col("event_type") == "signup", "create")
        .when(F.col("event_type") == "error", "remove")
        .when(F.col("event_type") == "purchase", "modify")
        .otherwise("access")
    )
    tail = F.when(F.col("user_id") % 10 == 0, ".txt").otherwise(".jsonl")
    return [
        F.concat(F.lit("/t/p/"), F.col("user_id"), tail).alias("file_path"),
        kind.alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
    ]
