"""Change feeds: diff of two versions, the dates they touch, collapse and apply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernflow.functions.columns import all_equal

INSERT, DELETE, BEFORE, AFTER = "insert", "delete", "update_preimage", "update_postimage"


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str], row_hash: str = "_row_hash", version: int | None = None) -> DataFrame:
    """Rows that differ, with _change_type: both images of an update count.

    One full-outer join on the keys; unchanged rows are dropped by their hash (and delete
    flag, which the hash leaves out) before any column is touched.
    """
    b, a = before.withColumn("_there", F.lit(True)).alias("b"), after.withColumn("_there", F.lit(True)).alias("a")
    marks = [c for c in (row_hash, "_is_deleted") if c in after.columns] if row_hash in after.columns else [c for c in after.columns if c not in keys]
    same = all_equal("b", "a", ["_there", *marks])
    joined = b.join(a, all_equal("b", "a", keys), "full_outer").where(~same)
    image = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in after.columns])
    old, new = F.col("b._there").isNotNull(), F.col("a._there").isNotNull()
    rows = F.array(
        F.when(old, F.struct(F.when(new, BEFORE).otherwise(DELETE).alias("kind"), image("b").alias("row"))),
        F.when(new, F.struct(F.when(old, AFTER).otherwise(INSERT).alias("kind"), image("a").alias("row"))),
    )
    out = joined.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("c")).select("c.row.*", F.col("c.kind").alias("_change_type"))
    return out if version is None else out.withColumn("_commit_version", F.lit(version).cast("long"))


def affected_dates(feed: DataFrame, timestamp: str) -> DataFrame:
    """The distinct days of all images, so a moved row recomputes its old and its new day."""
    return feed.select(F.to_date(timestamp).alias("day")).where("day IS NOT NULL").distinct()


def union_dates(*lists: Sequence | None) -> list | None:
    """All dates of the lists; None (rebuild everything) absorbs."""
    if any(x is None for x in lists):
        return None
    return sorted({d for x in lists for d in x if d is not None})


def collapse(feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last change of each key; pre-images do not count."""
    order = Window.partitionBy(*keys).orderBy(F.desc("_commit_version"), F.desc("_change_type"))
    rows = feed.where(F.col("_change_type") != BEFORE)
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def apply_feed(target: DataFrame, collapsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete, update and insert by _change_type."""
    kept = target.alias("t").join(collapsed.select(*keys).alias("c"), all_equal("t", "c", keys), "left_anti")
    return kept.unionByName(collapsed.where(F.col("_change_type") != DELETE).select(*target.columns))


def pair_images(feed: DataFrame, keys: Sequence[str], order: Sequence[str], operation: str = "cdc_operation") -> DataFrame:
    """A CDC update as its before and after image: operations 3 and 4 of one sequence.

    The before image is the key's previous row, found by ``lag`` over the key.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    values = [c for c in feed.columns if c not in {*keys, *order, operation}]
    held = feed.withColumn("_old", F.lag(F.struct(*values)).over(window))
    after = held.where(f"{operation} = 4").drop("_old")
    before = held.where(f"{operation} = 4 AND _old IS NOT NULL").select(*keys, *order, F.lit(3).alias(operation), *[F.col(f"_old.{c}").alias(c) for c in values])
    return feed.where(f"{operation} <> 4").unionByName(before).unionByName(after)
