"""Slowly changing dimensions, type 1 and type 2, and their unknown member."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernflow.functions.columns import digest, surrogate_key

# The bounds of a version without a start or an end.
BEGINNING, END = "1900-01-01 00:00:00", "9999-12-31 00:00:00"
UNKNOWN_KEY = -1


def scd1(target: DataFrame, source: DataFrame, key: str, tracked: Sequence[str], sk: str) -> DataFrame:
    """Latest attributes per key; a row is rewritten only if its hash differs."""
    fresh = source.select(surrogate_key([F.col(key)]).alias(sk), key, *tracked, digest([F.col(c) for c in tracked]).alias("attr_hash"))
    old = target.alias("t").join(fresh.alias("s"), key, "full_outer")
    changed = F.col("s.attr_hash").isNotNull() & ~F.col("s.attr_hash").eqNullSafe(F.col("t.attr_hash"))
    return old.select(*[F.col(key) if c == key else F.when(changed, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in fresh.columns])


def empty_scd2(source: DataFrame, keys: Sequence[str], tracked: Sequence[str], sk: str) -> DataFrame:
    """The dimension before its first load."""
    zero = F.lit(0).cast("long").alias(sk)
    return source.limit(0).select(
        zero, *keys, *tracked, F.lit("").alias("attr_hash"), F.lit(None).cast("timestamp").alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_to"), F.lit(True).alias("is_current")
    )


def scd2(target: DataFrame, source: DataFrame, keys: Sequence[str], tracked: Sequence[str], changed_at: str, sk: str) -> DataFrame:
    """The dimension after a snapshot of one row a key.

    A new key is in force from the beginning; a changed key closes its current version and
    opens one at the change; an unchanged key is left alone. A change that is not later
    than the current version would turn its interval round and is ignored.
    """
    current = target.where("is_current").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("attr_hash").alias("_hash"), F.col("effective_from").alias("_since"))
    fresh = source.withColumn("attr_hash", digest([F.col(c) for c in tracked]))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    compared = fresh.join(current, on, "left")
    at = F.col(changed_at).cast("timestamp")
    opened = compared.where(F.col("_hash").isNull() | ((F.col("_hash") != F.col("attr_hash")) & (at > F.col("_since"))))
    start = F.when(F.col("_hash").isNull(), F.lit(BEGINNING).cast("timestamp")).otherwise(at)
    opened = opened.withColumn("effective_from", start)
    versions = opened.select(
        surrogate_key([*[F.col(k) for k in keys], F.col("effective_from")]).alias(sk), *keys, *tracked, "attr_hash", "effective_from", F.lit(END).cast("timestamp").alias("effective_to"), F.lit(True).alias("is_current")
    )
    closing = opened.where("_hash IS NOT NULL").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("effective_from").alias("_until"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("is_current")]
    kept = target.join(closing, on, "left").select(
        *[c for c in target.columns if c not in ("effective_to", "is_current")],
        F.coalesce("_until", "effective_to").alias("effective_to"),
        (F.col("is_current") & F.col("_until").isNull()).alias("is_current"),
    )
    return kept.select(*versions.columns).unionByName(versions)


def scd2_from_log(log: DataFrame, keys: Sequence[str], tracked: Sequence[str], changed_at: str, sk: str) -> DataFrame:
    """The whole history at once: runs of equal attributes become versions.

    One sort by key replaces a merge per batch when a dimension is rebuilt.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(changed_at).cast("timestamp"))
    hashed = log.withColumn("attr_hash", digest([F.col(c) for c in tracked])).withColumn("_last", F.lag("attr_hash").over(order))
    starts = hashed.where(F.col("_last").isNull() | (F.col("_last") != F.col("attr_hash")))
    first = F.when(F.col("_last").isNull(), F.lit(BEGINNING).cast("timestamp")).otherwise(F.col(changed_at).cast("timestamp"))
    starts = starts.withColumn("effective_from", first)
    until = F.lead("effective_from").over(Window.partitionBy(*keys).orderBy("effective_from"))
    out = starts.withColumn("_until", until)
    return out.select(
        surrogate_key([*[F.col(k) for k in keys], F.col("effective_from")]).alias(sk), *keys, *tracked, "attr_hash", "effective_from",
        F.coalesce("_until", F.lit(END).cast("timestamp")).alias("effective_to"), F.col("_until").isNull().alias("is_current"),
    )


def with_unknown(dimension: DataFrame, sk: str) -> DataFrame:
    """Adds the member that misses point to: key -1, text UNKNOWN, all else NULL."""
    if not dimension.columns:
        return dimension
    kinds = dict(dimension.dtypes)
    fixed = {sk: F.lit(UNKNOWN_KEY).cast("long"), "is_current": F.lit(True), "effective_from": F.lit(BEGINNING).cast("timestamp"), "effective_to": F.lit(END).cast("timestamp")}
    member = [fixed.get(c, F.lit("UNKNOWN") if kinds[c] == "string" else F.lit(None)).cast(kinds[c]).alias(c) for c in dimension.columns]
    one = dimension.sparkSession.range(1).select(*member)
    return dimension.where(F.col(sk) != UNKNOWN_KEY).unionByName(one)
