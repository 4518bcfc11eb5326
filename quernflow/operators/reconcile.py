"""Reconciliation: counts and amounts must agree before any watermark moves."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernflow.functions.columns import all_equal


class ReconciliationError(RuntimeError):
    """Some check failed; nothing may advance."""


@dataclass(frozen=True)
class Result:
    check_type: str
    entity: str
    passed: bool
    source_value: float
    target_value: float
    detail: str = ""

    def row(self) -> dict:
        return asdict(self)


def compare_counts(entity: str, source: int, target: int, tolerance: int = 0, check_type: str = "COUNT", detail: str = "") -> Result:
    return Result(check_type, entity, abs(source - target) <= tolerance, float(source), float(target), detail or f"source={source} target={target} tolerance={tolerance}")


def compare_amounts(entity: str, source: float, target: float, rel_tol: float = 0.0, check_type: str = "AMOUNT") -> Result:
    """``rel_tol`` is a fraction of the source amount, not a percentage."""
    allowed = max(abs(source) * rel_tol, 1e-9)
    return Result(check_type, entity, abs(source - target) <= allowed, source, target, f"source={source} target={target} allowed={allowed}")


def compare_counts_and_amounts(entity: str, source: tuple[int, float], target: tuple[int, float], tolerance: int = 0, rel_tol: float = 0.0, check_type: str = "COUNT_AND_AMOUNT") -> Result:
    n, amount = compare_counts(entity, source[0], target[0], tolerance), compare_amounts(entity, source[1], target[1], rel_tol)
    return Result(check_type, entity, n.passed and amount.passed, amount.source_value, amount.target_value, f"{n.detail}; {amount.detail}")


def silver_balance(entity: str, read: int, valid: int, quarantined: int, duplicates: int) -> Result:
    """All rows read are valid, quarantined or duplicates. ``read`` is counted on its own."""
    return compare_counts(entity, read, valid + quarantined + duplicates, 0, "SILVER_BALANCE", f"read={read} valid={valid} quarantined={quarantined} duplicates={duplicates}")


def assert_all_passed(results: Iterable[Result]) -> None:
    if failed := [r for r in results if not r.passed]:
        raise ReconciliationError("; ".join(f"{r.check_type} {r.entity}: {r.detail}" for r in failed))


def control_totals(df: DataFrame, amount: str | None = None) -> tuple[int, float]:
    """Row count and the sum of a measure, in one pass."""
    total = F.coalesce(F.sum(F.col(amount).cast("double")), F.lit(0.0)) if amount else F.lit(0.0)
    row = df.agg(F.count(F.lit(1)).alias("n"), total.alias("amount")).first()
    return row["n"], row["amount"]


def manifest_gaps(manifests: DataFrame, landed: DataFrame, passed: DataFrame) -> DataFrame:
    """run_id, expected, landed, passed of the manifests that have not passed before."""
    counts = landed.groupBy(F.col("_ingestion_run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("landed_rows"))
    pending = manifests.join(passed.select("run_id").distinct(), "run_id", "left_anti")
    found = pending.join(counts, "run_id", "left").withColumn("landed_rows", F.coalesce("landed_rows", F.lit(0)))
    return found.withColumn("passed", F.col("rows_copied") == F.col("landed_rows"))


def missing_or_older(batch: DataFrame, target: DataFrame, keys: Sequence[str], sequence: str = "_sequence", deleted: str = "_is_deleted") -> DataFrame:
    """Keys of the batch that the target lacks or holds in an older version: none after a good merge.

    A delete of a key that never was is not expected in the target.
    """
    b, t = batch.select(*keys, sequence, deleted).alias("b"), target.select(*keys, sequence).withColumn("_there", F.lit(True)).alias("t")
    joined = b.join(t, all_equal("b", "t", keys), "left")
    bad = (F.col("t._there").isNull() & ~F.coalesce(F.col(f"b.{deleted}"), F.lit(False))) | (F.col(f"t.{sequence}") < F.col(f"b.{sequence}"))
    return joined.where(bad).select(*[F.col(f"b.{k}") for k in keys])


def with_run_id(results: DataFrame) -> DataFrame:
    """run_id taken from a detail text that names it (``run_id=...``); without one it is empty."""
    return results.withColumn("run_id", F.regexp_extract("detail", r"run_id=([^\s;,]+)", 1))


def latest_results(results: DataFrame, as_of: str | None = None) -> DataFrame:
    """The last result of each (check_type, entity, run): an older failure that was repaired does not
    count. ``as_of``: only results of the day before that moment and it."""
    if as_of is not None:
        until = F.lit(as_of).cast("timestamp")
        results = results.where((F.col("checked_at") > until - F.expr("INTERVAL 1 DAY")) & (F.col("checked_at") <= until))
    newest = F.max_by(F.struct(*[F.col(c) for c in results.columns]), "checked_at")
    return results.groupBy("check_type", "entity", "run_id").agg(newest.alias("r")).select("r.*")


def report(results: DataFrame) -> DataFrame:
    """Open failures first, then by layer in the order data flows, then by entity."""
    layer = F.when(F.col("check_type").startswith("MANIFEST"), 1).when(F.col("check_type").startswith("SILVER"), 2).when(F.col("check_type").startswith("GOLD"), 3).otherwise(4)
    return latest_results(results).withColumn("position", layer).orderBy("passed", "position", "entity", "run_id")


def gate(results: DataFrame) -> None:
    """Raise if a check's last result is a failure."""
    open_ = latest_results(results).where("NOT passed").select("check_type", "entity", "run_id").orderBy("check_type", "entity", "run_id").take(20)
    if open_:
        raise ReconciliationError("open failures: " + ", ".join(f"{r.check_type}/{r.entity}/{r.run_id}" for r in open_))
