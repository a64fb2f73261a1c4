"""Even work: joins against a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT = "__salt"


def salted_join(
    large: DataFrame, small: DataFrame, on: list[str], spread_by: list[str], how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Join where one key may hold most of ``large``.

    The rows of a key are spread over ``salts`` tasks, by default a quarter of
    those that a shuffle has, by a hash of
    ``spread_by`` and the matching rows of ``small`` are copied to each. Every
    row of ``large`` still meets every match exactly once.
    """
    if salts is None:
        salts = max(8, int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    left = large.withColumn(_SALT, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, _SALT], how).drop(_SALT)
