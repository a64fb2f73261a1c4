"""Keep costly columns from being computed more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns in a step that later filters are not pushed below.

    A filter on a projected column is pushed below the projection with the
    column's expression copied into it, so that tokenising or parsing would run
    once for the filter and again for the result. Filters do not move below the
    output of a generator, here one that yields exactly one row.
    """
    named = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [name for name in rows.columns if name not in columns]
    return rows.select(*kept, F.inline(F.array(named)))
