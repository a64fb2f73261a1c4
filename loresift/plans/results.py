"""Hits as JSON or as a ranked listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loresift.schema import CODE, Corpus


def _query(hits: DataFrame) -> list[str]:
    """The column that tells the queries of a batch apart, if there is one."""
    return [c for c in hits.columns if c == "query_id"]


def _ranked(hits: DataFrame, corpus: Corpus) -> DataFrame:
    """Number the hits of each query; a search returns no more than its limit of them."""
    order = Window.partitionBy(*_query(hits)).orderBy(F.desc("score"), *corpus.keys)
    return hits.withColumn("rank", F.row_number().over(order))


def hits_json(hits: DataFrame, corpus: Corpus) -> DataFrame:
    """All hits of a query as one pretty-printed JSON array, column ``hits``; of a batch, one row per query."""
    ranked = _ranked(hits, corpus)
    rows = F.array_sort(F.collect_list(F.struct("rank", F.struct(*hits.columns).alias("hit"))))
    options = {"pretty": "true", "ignoreNullFields": "false"}
    return ranked.groupBy(*_query(hits)).agg(F.to_json(F.transform(rows, lambda r: r["hit"]), options).alias("hits"))


def hits_listing(hits: DataFrame, corpus: Corpus) -> DataFrame:
    """One printable block per hit, with its ``rank``."""
    ranked = _ranked(hits, corpus)
    if corpus is CODE:
        head = F.format_string("%2d. [%s/%s] %s (%s)", "rank", "repo", "branch", "file_path", "language")
        lines = [head, F.concat(F.lit("    "), "snippet")]
    else:
        head = F.format_string(
            "%2d. [%s] %s %s (%s)",
            "rank",
            F.coalesce("timestamp", F.lit("—")),
            "project",
            "session_id",
            "event_role",
        )
        lines = [head, F.concat(F.lit("    "), "snippet"), F.concat(F.lit("    "), "file_path")]
    listing = F.concat_ws("\n", *lines).alias("listing")
    return ranked.select(*_query(hits), "rank", listing).orderBy(*_query(hits), "rank")
