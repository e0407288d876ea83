"""Joins that hold up when one side is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(few: DataFrame, many: DataFrame, on: list[str], spread_by: str) -> DataFrame:
    """Inner equi-join whose hot keys are spread over several tasks.

    Rows of ``many`` with one key are split by a hash of ``spread_by``; rows of ``few``
    are repeated for each split.  Neither side is broadcast: a table estimated small before
    it is repeated would go through the driver sixteen times as large.
    """
    many = many.withColumn("salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    few = few.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return few.hint("merge").join(many, [*on, "salt"]).drop("salt")
