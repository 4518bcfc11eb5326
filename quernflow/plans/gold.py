"""Builds gold from silver: dates, facts, gate, and only then the watermarks; then publishes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernflow import control
from quernflow.control import Watermarks
from quernflow.operators import feed, reconcile, upsert
from quernflow.plans import facts
from quernflow.sources.versioned import VersionedTable

CONSUMER = "gold"
WATCHED = ("mes_production_log", "mes_quality_inspection", "cmms_work_order")

# Publish order and the measure that each table is reconciled by.
PUBLISHED = {
    "dim_date": None, "dim_shift": None, "dim_defect_type": None, "dim_plant": None, "dim_supplier": None, "dim_machine": None, "dim_product": None,
    "fact_production_daily": "units_produced", "fact_machine_daily": "run_minutes", "fact_quality_inspection": "defect_count",
    "fact_maintenance_event": "downtime_minutes", "fact_supplier_delivery": "delivered_qty", "fact_process_run_sensor": "reading_count",
}


@dataclass
class Gold:
    spark: SparkSession
    silver: dict[str, VersionedTable]
    gold: dict[str, VersionedTable]
    watermarks: Watermarks
    run_id: str = "local"
    journal: control.Journal | None = None

    def dimension(self, name: str) -> DataFrame:
        return self.gold[name].read()

    def changed(self, name: str) -> DataFrame | None:
        return self.silver[name].changes(self.watermarks.get(CONSUMER, name))

    def _store(self, name: str, fresh: DataFrame, dates: list | None) -> None:
        """A fact that is partitioned by day writes the touched days only; others are written whole."""
        table = self.gold[name]
        if table.partition_by:
            table.replace(fresh, dates if table.exists() else None, "REPLACE_DATES" if dates is not None else "REBUILD", self.run_id)
            return
        if table.exists() and dates is not None:
            fresh = upsert.replace_dates(table.read(), fresh, "production_date", dates)
        table.commit(fresh, "REPLACE_DATES" if dates is not None else "REBUILD", self.run_id, record_changes=bool(table.keys))

    def build(self, minutes: DataFrame | None = None, readings: DataFrame | None = None, fail_after: str | None = None) -> list | None:
        """All facts for the touched days, with an entry in the run log whatever comes of it."""
        began = datetime.now(UTC)
        try:
            dates = self._build(minutes, readings, fail_after)
        except Exception as error:
            if self.journal:
                self.journal.run("GOLD", "facts", control.FAILED, began, message=str(error))
            raise
        if self.journal:
            self.journal.run("GOLD", "facts", control.SUCCESS, began, message="all days" if dates is None else f"{len(dates)} days")
            self.journal.audit("facts", "BUILD", versions={n: self.silver[n].latest() for n in WATCHED})
        return dates

    def _build(self, minutes: DataFrame | None, readings: DataFrame | None, fail_after: str | None) -> list | None:
        """All facts for the touched days. The watermarks of the three watched tables move
        last, together; a failure before that leaves them and the next call repeats the days."""
        runs = self.silver["mes_production_log"].read()
        inspections, orders = self.silver["mes_quality_inspection"].read(), self.silver["cmms_work_order"].read()
        versions = {n: self.silver[n].latest() for n in WATCHED}
        dates = facts.dates_to_build(*[self.changed(n) for n in WATCHED], runs)
        machines, products, plants = (self.dimension(n) for n in ("dim_machine", "dim_product", "dim_plant"))
        self._store("fact_production_daily", facts.production_daily(runs, inspections, machines, products, plants, dates), dates)
        production = self.gold["fact_production_daily"].read()
        source = facts.live(runs).withColumn("production_date", F.to_date("start_ts")).where(F.col("production_date").isNotNull() if dates is None else facts.in_dates("production_date", dates))
        built = production.where(facts.in_dates("production_date", dates)).where("production_date IS NOT NULL")
        total = reconcile.control_totals(source, "units_produced")
        sums = built.agg(F.coalesce(F.sum("production_runs"), F.lit(0)).alias("n"), F.coalesce(F.sum("units_produced").cast("double"), F.lit(0.0)).alias("a")).first()
        result = reconcile.compare_counts_and_amounts("fact_production_daily", total, (sums["n"], sums["a"]), check_type="GOLD_COUNT_AND_AMOUNT")
        if self.journal:
            self.journal.results([result])
        reconcile.assert_all_passed([result])
        if fail_after == "fact_production_daily":
            raise reconcile.ReconciliationError("injected")
        self._store("fact_machine_daily", facts.machine_daily(production, orders, machines, plants, minutes, dates), dates)
        if readings is not None:
            self._store("fact_process_run_sensor", facts.process_run_sensor(runs, readings, dates), dates)
        self._store("fact_quality_inspection", facts.quality_inspection(inspections, machines, products), None)
        self._store("fact_maintenance_event", facts.maintenance_event(orders, machines), None)
        if "supplier_delivery" in self.silver and self.silver["supplier_delivery"].exists():
            self._store("fact_supplier_delivery", facts.supplier_delivery(self.silver["supplier_delivery"].read(), self.dimension("dim_supplier"), plants), None)
        self.watermarks.advance(CONSUMER, {n: v for n, v in versions.items() if v is not None})
        return dates


def publish_table(source: VersionedTable, target: VersionedTable, name: str, watermarks: Watermarks, consumer: str = "serving", rel_tol: float = 0.0001) -> reconcile.Result:
    """Bring a serving copy up to date from the collapsed change feed, reconcile, then advance."""
    done, latest = watermarks.get(consumer, name), source.latest()
    if done != latest or not target.exists():
        changes = source.changes(done) if source.keys and target.exists() else None
        if changes is None:
            target.commit(source.read(), "FULL")
        elif target.keys:
            target.apply(feed.collapse(changes, source.keys))
        else:
            target.commit(feed.apply_feed(target.read(), feed.collapse(changes, source.keys), source.keys), "MERGE")
    measure = PUBLISHED.get(name)
    result = reconcile.compare_counts_and_amounts(name, reconcile.control_totals(source.read(), measure), reconcile.control_totals(target.read(), measure), 0, rel_tol)
    if result.passed:
        watermarks.advance(consumer, {name: latest})
    return result


def publish_all(gold: dict[str, VersionedTable], serving: dict[str, VersionedTable], watermarks: Watermarks) -> list[reconcile.Result]:
    """Dimensions before facts; every table is tried, then any failure raises."""
    results = [publish_table(gold[n], serving[n], n, watermarks) for n in PUBLISHED if n in gold and gold[n].exists()]
    reconcile.assert_all_passed(results)
    return results


def serving_sql(spark: SparkSession, serving: dict[str, VersionedTable], sql: str) -> DataFrame:
    """Run SQL over the serving copies, each a view of its table's name."""
    for name, table in serving.items():
        if table.exists():
            table.read().createOrReplaceTempView(name)
    return spark.sql(sql)
