"""Contract checks: what one side has and the other lacks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap(declared: Iterable[str], found: Iterable[str]) -> tuple[list[str], list[str]]:
    """(declared but not found, found but not declared): empty lists if the contract holds."""
    a, b = set(declared), set(found)
    return sorted(a - b), sorted(b - a)


def gap_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct rows that only one side has, with the side: a symmetric difference."""
    sides = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(2)))
    seen = sides.groupBy(*left.columns).agg(F.bit_or("_side").alias("_side")).where("_side < 3")
    return seen.withColumn("side", F.when(F.col("_side") == 1, "left").otherwise("right")).drop("_side")
