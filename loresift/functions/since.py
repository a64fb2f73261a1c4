"""The ``since`` bound: an RFC-3339 instant or a count of time units before now."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of an RFC-3339 date-time with its offset.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"

# Seconds per unit letter.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}

_RELATIVE = r"^([+-]?\d{1,18})([smhdw])$"


def rfc3339(value: Column) -> Column:
    """UTC instant of an RFC-3339 string, null for anything else."""
    return F.when(value.rlike(RFC3339), F.try_to_timestamp(F.upper(value)))


def since_bound(value: Column, now: Column) -> Column:
    """Inclusive lower bound for ``timestamp``, cut to whole seconds.

    A null value means no bound; anything that is neither an instant nor an
    integer with a unit fails the query.
    """
    amount = F.regexp_extract(value, _RELATIVE, 1).try_cast("bigint")
    unit = F.regexp_extract(value, _RELATIVE, 2)
    seconds = F.lit(None).cast("bigint")
    for letter, length in UNIT_SECONDS.items():
        seconds = F.when(unit == letter, F.try_multiply(amount, F.lit(length).cast("bigint"))).otherwise(seconds)
    micros = F.try_multiply(seconds, F.lit(1_000_000).cast("bigint"))
    relative = F.timestamp_micros(F.unix_micros(now) - micros)
    bound = F.coalesce(rfc3339(value), F.when(value.rlike(_RELATIVE), relative))
    invalid = F.raise_error(F.concat(F.lit("invalid since value: "), value)).cast("timestamp")
    return F.date_trunc("second", F.when(value.isNull(), F.lit(None)).otherwise(F.coalesce(bound, invalid)))
