"""Collapse a batch to the latest row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Differ between two landings of the same change and must not keep both.
TECHNICAL = ("_ingest_ts", "_source_file", "_source_file_ts", "_ingestion_run_id", "_load_date", "_pipeline_run_id")


def latest(df: DataFrame, keys: Sequence[str], order: str = "_sequence", tie: Sequence[str] = ()) -> DataFrame:
    """One row per key: the highest ``order``, ties settled by ``tie`` and then by all columns.

    The rank limit is applied before the shuffle too, so a hot key sends one row a task.
    """
    rest = [c for c in df.columns if c not in {*keys, order, *tie}]
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in tie], F.xxhash64(*rest).desc() if rest else F.lit(0))
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def deduplicate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact repeats (technical columns aside) and older changes go; the result is deterministic."""
    tie = [c for c in ("_is_deleted", "_row_hash", "_ingestion_run_id", "_source_file") if c in df.columns]
    return latest(df, keys, "_sequence", tie)
