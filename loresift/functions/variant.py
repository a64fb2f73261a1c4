"""Type-strict access to parsed JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def string_at(value: Column, path: str) -> Column:
    """The string at ``path``; null when absent or of any other JSON type."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(is_string(found), F.try_variant_get(value, path, "string"))
