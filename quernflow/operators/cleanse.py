"""Standardise source rows and add the row metadata that later steps rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernflow.functions.columns import chain, digest, sequence, typed
from quernflow.registry import TECHNICAL_PREFIXES, Entity


def standardise(df: DataFrame, entity: Entity) -> DataFrame:
    """Declared columns only: string steps, then a cast, a rename and the NULL default.

    A declared column that the source lacks becomes a typed NULL; undeclared columns go,
    except technical ones. Defaults come before any rule is checked.
    """
    there = {c.lower(): c for c in df.columns}
    out = []
    for a in entity.attributes:
        if a.source.lower() in there:
            value = typed(chain(F.col(there[a.source.lower()]).cast("string") if a.steps else F.col(there[a.source.lower()]), a.steps), a.kind)
        else:
            value = F.lit(None).cast(a.kind)
        if a.name in entity.defaults:
            value = F.coalesce(value, F.lit(entity.defaults[a.name]).cast(a.kind))
        out.append(value.alias(a.name))
    return df.select(*out, *[F.col(c) for c in df.columns if c.startswith(TECHNICAL_PREFIXES)])


def add_row_metadata(df: DataFrame, entity: Entity, run_id: str) -> DataFrame:
    """Adds _sequence, _is_deleted, _row_hash and _pipeline_run_id."""
    kinds = [(c, "timestamp" if entity.kind_of(c) == "timestamp" or c.endswith("_ts") and not c.startswith("cdc_") else "string") for c in entity.order]
    deleted = F.coalesce(F.expr(entity.deleted_when), F.lit(False)) if entity.deleted_when else F.lit(False)
    return df.select(
        "*",
        sequence(kinds).alias("_sequence"),
        deleted.alias("_is_deleted"),
        digest([F.col(a.name) for a in entity.attributes]).alias("_row_hash"),
        F.lit(run_id).alias("_pipeline_run_id"),
    )


def supplier_lines(df: DataFrame) -> DataFrame:
    """Supplier files cleansed the strict way: bad lines are dropped, not quarantined.

    Codes trimmed and upper-cased, names in proper case, types cast; a line needs a key, a
    positive quantity and rejects within it; one line per key, plus the accepted quantity.
    """
    code = lambda c: F.upper(F.trim(c))
    rows = df.select(
        code("delivery_id").alias("delivery_id"), code("supplier_id").alias("supplier_id"), F.initcap(F.trim("supplier_name")).alias("supplier_name"), code("material_code").alias("material_code"), code("plant_id").alias("plant_id"),
        F.col("delivery_date").try_cast("date").alias("delivery_date"), F.col("delivered_qty").try_cast("int").alias("delivered_qty"), F.coalesce(F.col("rejected_qty").try_cast("int"), F.lit(0)).alias("rejected_qty"), code("lot_number").alias("lot_number"),
    )
    good = rows.where("delivery_id IS NOT NULL AND delivery_id <> '' AND delivered_qty > 0 AND rejected_qty BETWEEN 0 AND delivered_qty")
    rest = [c for c in good.columns if c != "delivery_id"]
    one = good.groupBy("delivery_id").agg(F.max(F.struct(*rest)).alias("r")).select("delivery_id", "r.*")
    return one.withColumn("accepted_qty", F.col("delivered_qty") - F.col("rejected_qty"))
