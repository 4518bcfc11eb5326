"""Point-in-time lookup of the dimension version in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernflow.operators.history import UNKNOWN_KEY


def version_in_force(fact: DataFrame, dimension: DataFrame, fact_key: str, instant: str, dim_key: str, sk: str, carry: tuple[str, ...] = (), broadcast: bool = True) -> DataFrame:
    """Adds ``sk`` (and ``carry``) of the version with from <= instant < to; -1 on a miss.

    An equi join on the key with the interval as a residual: Spark broadcasts a dimension
    it knows to be small, and otherwise both sides meet on the key.
    """
    d = dimension.select(F.col(dim_key).alias("_dk"), F.col(sk).alias("_sk"), "effective_from", "effective_to", *[F.col(c).alias(f"_c_{c}") for c in carry])
    at = F.col(instant)
    on = (F.col(fact_key) == F.col("_dk")) & (at >= F.col("effective_from")) & (at < F.col("effective_to"))
    joined = fact.join(F.broadcast(d) if broadcast and is_small(dimension) else d, on, "left")
    names = [F.coalesce("_sk", F.lit(UNKNOWN_KEY).cast("long")).alias(sk), *[F.col(f"_c_{c}").alias(c) for c in carry]]
    return joined.select(*[F.col(c) for c in fact.columns], *names)


def is_small(dimension: DataFrame, limit_bytes: int = 64 << 20) -> bool:
    """Whether Spark's own size estimate lets the dimension be broadcast. A session that does not
    show its plans (Spark Connect) leaves the choice to Spark's threshold."""
    plan = getattr(dimension, "_jdf", None)
    return plan is not None and int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit_bytes


def asof_sorted(fact: DataFrame, versions: DataFrame, key: str, instant: str, since: str, value: str, slice: str = "month") -> DataFrame:
    """The same lookup for a large history: union, one sort per key and time slice, last value
    carried forward; what a slice begins with comes from a table of a row per key and slice.

    So a hot key is as many tasks as it has slices. No version matches before the first one.
    Needs no interval end and no broadcast.
    """
    names, at = fact.columns, F.col("_at")
    left = fact.select(F.col(key).alias("_key"), F.col(instant).alias("_at"), F.lit(1).alias("_kind"), F.struct(*names).alias("_row"), F.lit(None).cast(versions.schema[value].dataType).alias("_value"))
    right = versions.select(F.col(key).alias("_key"), F.col(since).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    rows = left.unionByName(right).withColumn("_slice", F.date_trunc(slice, at))
    order = Window.partitionBy("_key", "_slice").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_found", F.last("_value", ignorenulls=True).over(order)).where("_kind = 1")
    last = rows.groupBy("_key", "_slice").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), at)).alias("_last"))
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    begun = last.select(F.col("_key").alias("_k"), F.col("_slice").alias("_s"), F.last("_last", ignorenulls=True).over(earlier).alias("_begun"))
    joined = found.join(begun, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_slice").eqNullSafe(F.col("_s")), "left")
    return joined.select("_row.*", F.coalesce("_found", "_begun").alias(value))
