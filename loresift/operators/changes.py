"""What changed between a listing and the files an index was built from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect_changes(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(file_path, change)`` with change ``created``, ``modified`` or ``removed``.

    Both sides hold ``(file_path, mtime, size_bytes)``, one row per file.
    """
    new, old = listing.alias("new"), manifest.alias("old")
    both = new.join(old, F.col("new.file_path") == F.col("old.file_path"), "full_outer")
    differs = ~F.equal_null("new.mtime", "old.mtime") | ~F.equal_null("new.size_bytes", "old.size_bytes")
    change = (
        F.when(F.col("old.file_path").isNull(), "created")
        .when(F.col("new.file_path").isNull(), "removed")
        .when(differs, "modified")
    )
    path = F.coalesce("new.file_path", "old.file_path").alias("file_path")
    return both.select(path, change.alias("change")).filter(F.col("change").isNotNull())
