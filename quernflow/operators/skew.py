"""Hot keys: report them, and join them salted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernflow.functions.columns import all_equal


def skew_report(df: DataFrame, keys: Sequence[str], top: int = 20, error: float = 0.01) -> DataFrame:
    """The ``top`` heaviest keys with their ratio to the approximate median key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    middle = counts.agg(F.percentile_approx("row_count", 0.5, round(1 / error)).alias("median"))
    heavy = counts.orderBy(F.desc("row_count"), *keys).limit(top)
    median = F.coalesce(F.nullif(middle.scalar(), F.lit(0)), F.lit(1))
    return heavy.select(*keys, "row_count", (F.col("row_count") / median).alias("times_median"))


def salted_join(large: DataFrame, small: DataFrame, keys: Sequence[str], salts: int = 16, how: str = "inner", extra=None) -> DataFrame:
    """Join where ``large`` has hot keys: its rows get a salt, ``small`` is repeated per salt.

    The salt is a hash of the row, so a repeated task deals the same rows; only joins
    that keep no unmatched row of ``small`` stay correct, hence inner, left, semi and anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted {how} join would repeat unmatched rows of the small side")
    l = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int")).alias("l")  # noqa: E741
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("s")
    on = all_equal("l", "s", keys) & (F.col("l._salt") == F.col("s._salt"))
    joined = l.join(s, on if extra is None else on & extra, how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*[F.col(f"l.{c}") for c in large.columns])
    return joined.select(*[F.col(f"l.{c}") for c in large.columns], *[F.col(f"s.{c}") for c in small.columns if c not in keys])
