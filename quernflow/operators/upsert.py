"""Apply changes to a table by one join: sequence-guarded upsert, hard delete, replace by date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernflow.functions.columns import all_equal, in_dates
from quernflow.operators.feed import AFTER, BEFORE, DELETE, INSERT


def _side(columns: Sequence[str], use_source: Column, target_columns: set[str]) -> list[Column]:
    return [F.when(use_source, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}") if c in target_columns else F.lit(None)).alias(c) for c in columns]


def _newer(sequence: str) -> Column:
    """Whether the source's row wins: an unknown key, or a higher sequence. Never NULL, so a change
    without a sequence loses against a row that has one."""
    higher = (F.col(f"s.{sequence}") > F.col(f"t.{sequence}")) | F.col(f"t.{sequence}").isNull()
    return F.col("s._in_s").isNotNull() & (F.col("t._in_t").isNull() | F.coalesce(higher, F.lit(False)))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], sequence: str = "_sequence", deleted: str = "_is_deleted", delete_mode: str = "soft", keep_tombstones: bool = False) -> DataFrame:
    """The target after the source's changes; ``source`` has one row a key.

    A change wins only if its sequence is higher, so replays and late arrivals are harmless.
    ``soft``: a delete updates the flag, an unmatched delete is not inserted unless
    ``keep_tombstones`` (then an insert that arrives after it cannot resurrect the key).
    ``hard``: deleted keys leave the table. Keys compare NULL-safe.
    """
    if delete_mode not in ("soft", "hard"):
        raise ValueError(f"delete_mode {delete_mode!r}")
    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    s = source.withColumn("_in_s", F.lit(True)).alias("s")
    joined = t.join(s, all_equal("t", "s", keys), "full_outer")
    newer = _newer(sequence)
    gone = F.coalesce(F.col(f"s.{deleted}"), F.lit(False))
    if delete_mode == "hard":
        joined = joined.where(~(newer & gone))
    elif not keep_tombstones:
        joined = joined.where(~(F.col("t._in_t").isNull() & gone))
    return joined.select(*_side(target.columns, newer, set(target.columns)))


def upsert_changes(target: DataFrame, source: DataFrame, keys: Sequence[str], sequence: str = "_sequence", deleted: str = "_is_deleted", delete_mode: str = "soft", keep_tombstones: bool = False, row_hash: str = "_row_hash") -> DataFrame:
    """The change rows of ``upsert``, with _change_type: both images of an update.

    Only the source's keys are looked up; rows that change nothing but technical columns
    (the same hash and delete flag) give no change.
    """
    s = source.withColumn("_in_s", F.lit(True)).alias("s")
    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    joined = s.join(t, all_equal("s", "t", keys), "left").where(_newer(sequence))
    known, gone = F.col("t._in_t").isNotNull(), F.coalesce(F.col(f"s.{deleted}"), F.lit(False))
    same = F.lit(False)
    if row_hash in target.columns:
        same = F.col(f"s.{row_hash}").eqNullSafe(F.col(f"t.{row_hash}")) & gone.eqNullSafe(F.coalesce(F.col(f"t.{deleted}"), F.lit(False)))
    image = lambda side, there: F.struct(*[(F.col(f"{side}.{c}") if c in there else F.lit(None).cast(target.schema[c].dataType)).alias(c) for c in target.columns])
    old, new = image("t", target.columns), image("s", source.columns)
    row = lambda when, kind, of: F.when(when, F.struct(F.lit(kind).alias("kind"), of.alias("row")))
    if delete_mode == "hard":
        rows = [row(known & gone, DELETE, old), row(known & ~gone & ~same, BEFORE, old), row(known & ~gone & ~same, AFTER, new), row(~known & ~gone, INSERT, new)]
    else:
        rows = [row(known & ~same, BEFORE, old), row(known & ~same, AFTER, new), row(~known & (F.lit(True) if keep_tombstones else ~gone), INSERT, new)]
    return joined.select(F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull()))).select("row.*", F.col("kind").alias("_change_type"))


def merge_metrics(target: DataFrame, source: DataFrame, keys: Sequence[str], sequence: str = "_sequence", deleted: str = "_is_deleted") -> DataFrame:
    """One row: inserted, updated, soft_deleted, ignored of an upsert."""
    t = target.select(*keys, sequence).withColumn("_in_t", F.lit(True)).alias("t")
    s = source.select(*keys, sequence, deleted).alias("s")
    joined = s.join(t, all_equal("s", "t", keys), "left")
    new, gone = F.col("t._in_t").isNull(), F.coalesce(F.col(f"s.{deleted}"), F.lit(False))
    newer = ~new & (F.col(f"s.{sequence}") > F.col(f"t.{sequence}"))
    return joined.agg(
        F.count_if(new & ~gone).alias("inserted"),
        F.count_if(newer & ~gone).alias("updated"),
        F.count_if(newer & gone).alias("soft_deleted"),
        F.count_if((new & gone) | (~new & ~F.coalesce(newer, F.lit(False)))).alias("ignored"),
    )


def replace_dates(target: DataFrame, fresh: DataFrame, date_column: str, dates: Sequence | DataFrame | None) -> DataFrame:
    """The target with the given dates taken from ``fresh``: updated, inserted and deleted at once.

    ``dates`` is a list or a table of one column; None replaces everything. This gives the whole
    of the new rows; ``VersionedTable.replace`` writes only the partitions of the dates.
    """
    if dates is None:
        return fresh
    if isinstance(dates, DataFrame):
        day = dates.select(F.col(dates.columns[0]).alias(date_column)).distinct()
        return target.join(day, date_column, "left_anti").select(*target.columns).unionByName(fresh.join(day, date_column, "left_semi"), allowMissingColumns=True)
    if not dates:
        return target
    inside = in_dates(date_column, dates)
    return target.where(~F.coalesce(inside, F.lit(False))).unionByName(fresh.where(inside), allowMissingColumns=True)


def delete_matching(target: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is among ``gone`` leave: an anti join, not a list in a predicate."""
    return target.join(gone.select(*keys).distinct(), list(keys), "left_anti")
