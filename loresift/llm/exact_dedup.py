"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest. New rows are reduced to
one row per digest, an anti-join against the index keeps the digests it lacks,
and those are appended. Both sides of the anti-join are laid out by digest, so
the index itself is never shuffled. Each append adds a file to every bucket;
from the second on a bucket's files are merged by a sort when they are read.

Defined results: a null text counts as empty; texts are equal if they are
identical after each run of white space is replaced by one space. Of equal
texts the row with the smallest ``doc_id`` stays (a null id is larger than any
other). Rows that repeat both id and text are one document: the labels mark
each, ``keep_first`` returns one. An empty table gives an empty result. Other
columns may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loresift.llm.common import BLANK, filled, settle
from loresift.session import scratch_path

BUCKETS = 64


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 64 hexadecimal digits."""
    # single spaces, by far the most matches, are already as they should be
    return F.sha2(F.regexp_replace(filled(text), f"[{BLANK}]{{2,}}|[\\x09-\\x0D]", " "), 256)


class DigestIndex:
    """Digests seen so far and the id that stays for each.

    ``open`` attaches a folder to the session's catalog, or makes a new index
    there. The folder outlives the session; ``buckets`` must be the same each
    time.
    """

    def __init__(self, spark: SparkSession, table: str):
        self.spark = spark
        self.table = table

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> DigestIndex:
        table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return cls(spark, table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame) -> None:
        """Append the digests of ``groups`` (digest, keep_id: one row per digest) that the index lacks."""
        known = self.rows().select("digest")
        new = settle(groups.select("digest", "keep_id").join(known.hint("merge"), "digest", "left_anti"), "new-digests")
        buckets = self.spark.sql(f"DESCRIBE EXTENDED {self.table}").where("col_name = 'Num Buckets'").head()[1]
        (
            new.repartition(int(buckets), "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(int(buckets), "digest")
            .sortBy("digest")
            .saveAsTable(self.table)
        )


def label_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per row of ``docs``: which row of its text stays, after adding the texts to the index.

    ``group_size`` counts the rows of ``docs`` with that text; a text that the
    index knew before keeps the id stored there.
    """
    digests = settle(docs.select("doc_id", F.unhex(text_digest(F.col("text"))).alias("digest")), "digests")
    groups = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    index.add(groups)
    # Written, so that both sides of the labelling join are plain shuffles, which
    # Spark splits where one text holds many rows.
    sizes = settle(
        groups.drop("keep_id").join(index.rows().hint("merge"), "digest"),"digest-groups")
    return digests.join(sizes, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged.

    A text that the index knew before is dropped. Only one row per kept text is
    read again; rows that repeat an id and a text are reduced to one of them.
    """
    digests = settle(docs.select("doc_id", F.unhex(text_digest(F.col("text"))).alias("digest")), "digests")
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
    known = index.rows().select("digest").hint("merge")
    groups = settle(first.join(known, "digest", "left_anti"), "first-rows")
    index.add(groups)

    def row_key(digest: Column, doc_id: Column) -> Column:
        return F.sha2(F.concat(digest, F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 256)

    wanted = groups.select(row_key(F.col("digest"), F.col("keep_id")).alias("key"))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        row_key(F.unhex(text_digest(F.col("text"))), F.col("doc_id")).alias("key"),
    )
    # the window finds its rows laid out and sorted by the join
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return keyed.join(wanted.hint("merge"), "key").withColumn("nth", nth).where("nth = 1").select("row.*")


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex.open(spark, scratch_path(spark, "digest-index"))
