"""Which repositories an index holds, and which one a search without a label means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repo_list(rows: DataFrame) -> DataFrame:
    """Labels in order, of documents or of an index's statistics, which have few rows per label."""
    return rows.select("repo").distinct().orderBy("repo")


def default_repo(documents: DataFrame) -> str:
    """The only repository there is; an error if there are none or several."""
    labels = [row["repo"] for row in repo_list(documents).collect()]  # one row per repository
    if not labels:
        raise ValueError("no code repositories are indexed")
    if len(labels) > 1:
        raise ValueError(f"several repositories are indexed ({', '.join(labels)}); name one with repo")
    return labels[0]
