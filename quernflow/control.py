"""Control plane: extraction runs as a state machine, version watermarks, run log.

The state functions are pure: they take the control rows and give the new ones, so a
caller commits the outcome in one step and a failed step changes nothing.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernflow import registry

log = logging.getLogger("quernflow")

RUNNING, VALIDATED, SUCCESS, FAILED, RECON_FAILED, ABANDONED = "RUNNING", "VALIDATED", "SUCCESS", "FAILED", "RECON_FAILED", "ABANDONED"
UNFINISHED = (RUNNING, VALIDATED, FAILED, RECON_FAILED)


class StateError(RuntimeError):
    """The step is not allowed in this state."""


@dataclass(frozen=True)
class Control:
    """What is configured and known for one entity."""

    entity: str
    pattern: str
    watermark: str
    batch_group: str = "DAILY"
    enabled: bool = True
    max_reject_pct: float = 0.0
    priority: int = 100
    extract_template: str = "SELECT * FROM {entity} WHERE {column} > '{start}' AND {column} <= '{end}'"
    column: str = "updated_at"


@dataclass(frozen=True)
class Run:
    run_id: str
    entity: str
    status: str
    window_start: str
    window_end: str
    number: int
    day: str
    extract_sql: str = ""
    counts: dict = field(default_factory=dict)
    message: str = ""
    batch_id: str = ""

    @property
    def has_changes(self) -> bool:
        return self.window_end > self.window_start


def start_run(control: Control, runs: Sequence[Run], day: str, high: str, batch_id: str = "") -> Run:
    """The entity's next attempt. An unfinished attempt is taken up again with its run id
    and its frozen window, so a retry reads exactly the same rows."""
    mine = [r for r in runs if r.entity == control.entity]
    open_ = [r for r in mine if r.status in UNFINISHED]
    if open_:
        return replace(max(open_, key=lambda r: (r.day, r.number)), status=RUNNING, message="")
    number = 1 + max((r.number for r in mine if r.day == day), default=0)
    sql = control.extract_template.format(entity=control.entity, column=control.column, start=control.watermark, end=high)
    return Run(f"{control.entity}_{day.replace('-', '')}_{number:02d}", control.entity, RUNNING, control.watermark, max(high, control.watermark), number, day, sql, batch_id=batch_id)


def validate_counts(run: Run, control: Control, source: int, read: int, copied: int, skipped: int) -> Run:
    """source = read = copied + skipped, rejects within the limit. A negative source count means
    that the file itself is the source."""
    counts = {"source_count": source, "rows_read": read, "rows_copied": copied, "rows_skipped": skipped}
    reject = 100.0 * skipped / read if read else 0.0
    if source >= 0 and source != read:
        problem = f"source {source} <> read {read}"
    elif read != copied + skipped:
        problem = f"read {read} <> copied {copied} + skipped {skipped}"
    elif reject > control.max_reject_pct:
        problem = f"rejected {reject:.2f} % > {control.max_reject_pct} %"
    else:
        problem = ""
    return replace(run, counts=counts, status=RECON_FAILED if problem else VALIDATED, message=problem)


def complete_run(run: Run, control: Control) -> tuple[Run, Control]:
    """Success and the new watermark together; only a validated run may, a finished one stays."""
    if run.status == SUCCESS:
        return run, control
    if run.status != VALIDATED:
        raise StateError(f"{run.run_id} is {run.status}, not {VALIDATED}")
    return replace(run, status=SUCCESS), replace(control, watermark=max(run.window_end, control.watermark))


def fail_run(run: Run, message: str) -> Run:
    """A failed count check keeps its own status; a success is never taken back."""
    return run if run.status in (SUCCESS, RECON_FAILED) else replace(run, status=FAILED, message=message)


def reset_watermark(control: Control, runs: Sequence[Run], value: str, reason: str) -> tuple[Control, list[Run]]:
    """An operator moves the watermark; half-finished runs are given up."""
    if len(reason.strip()) < 10:
        raise ValueError("a reset needs a reason of at least 10 characters")
    given_up = [replace(r, status=ABANDONED, message=reason) if r.entity == control.entity and r.status in UNFINISHED else r for r in runs]
    return replace(control, watermark=value), given_up


def pending_entities(controls: DataFrame, runs: DataFrame, batch_group: str, day: str, force: bool = False) -> DataFrame:
    """Enabled entities of the group by priority; daily ones already done that day are left out."""
    wanted = controls.where(F.col("enabled") & (F.col("batch_group") == batch_group))
    if batch_group == "DAILY" and not force:
        done = runs.where((F.col("status") == SUCCESS) & (F.col("day") == day)).select("entity").distinct()
        wanted = wanted.join(done, "entity", "left_anti")
    return wanted.orderBy("priority", "entity")


def batch_status(runs: DataFrame) -> DataFrame:
    """batch_id, succeeded, failed and SUCCESS, PARTIAL_FAILURE or FAILED."""
    good, bad = F.count_if(F.col("status") == SUCCESS), F.count_if(F.col("status") != SUCCESS)
    counts = runs.groupBy("batch_id").agg(good.alias("succeeded"), bad.alias("failed"))
    status = F.when(F.col("failed") == 0, SUCCESS).when(F.col("succeeded") > 0, "PARTIAL_FAILURE").otherwise(FAILED)
    return counts.withColumn("status", status)


def ingestion_status(controls: DataFrame, runs: DataFrame) -> DataFrame:
    """Each entity with its latest run, if any."""
    newest = runs.groupBy("entity").agg(F.max_by(F.struct("run_id", "status", "window_start", "window_end"), F.struct("day", "number")).alias("r"))
    return controls.join(newest, "entity", "left").select("entity", "batch_group", "watermark", "r.*")


#: Which reader takes an entity, by its load pattern.
ROUTES = {registry.CDC: "lsn_window", registry.WATERMARK: "watermark_window", registry.FULL: "full_extract", registry.API: "paged_source", registry.FILE: "read_csv_drop"}


def route(pattern: str) -> str:
    if pattern not in ROUTES:
        raise ValueError(f"no reader for {pattern}")
    return ROUTES[pattern]


def run_isolated(names: Iterable[str], work: Callable[[str], object], parallel: int = 4) -> dict[str, Exception | None]:
    """Run ``work`` for each name, some at once; a failure stays with its name."""

    def one(name: str) -> Exception | None:
        try:
            work(name)
        except Exception as error:  # noqa: BLE001
            log.exception("%s failed", name)
            return error
        return None

    names = list(names)
    with ThreadPoolExecutor(parallel) as pool:
        return dict(zip(names, pool.map(one, names), strict=True))


class Watermarks:
    """Published version of each (consumer, table), a small versioned table."""

    SCHEMA = "consumer string, table_name string, version long, advanced_at timestamp"

    def __init__(self, table) -> None:
        self.table = table

    def get(self, consumer: str, name: str) -> int | None:
        if not self.table.exists():
            return None
        row = self.table.read().where((F.col("consumer") == consumer) & (F.col("table_name") == name)).first()
        return row["version"] if row else None

    def advance(self, consumer: str, versions: dict[str, int], at: datetime | None = None) -> None:
        """All given tables in one commit."""
        spark: SparkSession = self.table.spark
        at = at or datetime.now(UTC)
        fresh = spark.createDataFrame([(consumer, n, v, at) for n, v in versions.items()], self.SCHEMA)
        if self.table.exists():
            kept = self.table.read().join(fresh.select("consumer", "table_name"), ["consumer", "table_name"], "left_anti")
            fresh = kept.unionByName(fresh)
        self.table.commit(fresh, "ADVANCE")


#: The append-only control tables.
JOURNAL = {
    "run_log": "pipeline string, run_id string, layer string, entity string, batch_id long, status string, rows_in long, rows_valid long, rows_quarantined long, rows_duplicate long, message string, started_at timestamp, ended_at timestamp",
    "audit": "pipeline string, run_id string, entity string, event string, detail string, at timestamp",
    "quality": "run_id string, entity string, batch_id long, rule_name string, failed_count long, at timestamp",
    "results": "check_type string, entity string, run_id string, passed boolean, source_value double, target_value double, detail string, checked_at timestamp",
}


@dataclass(frozen=True)
class Journal:
    """Run log, audit trail, rule failures and reconciliation results, each a folder that only grows."""

    spark: SparkSession
    root: str
    pipeline: str = "quernflow"
    run_id: str = "local"

    def _append(self, name: str, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, JOURNAL[name]).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def table(self, name: str) -> DataFrame:
        """The rows so far; none yet gives an empty table."""
        try:
            return self.spark.read.schema(JOURNAL[name]).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], JOURNAL[name])

    def run(self, layer: str, entity: str, status: str, began: datetime, counts: dict | None = None, batch_id: int | None = None, message: str = "") -> None:
        c = counts or {}
        self._append("run_log", [(self.pipeline, self.run_id, layer, entity, batch_id, status, c.get("read"), c.get("valid"), c.get("quarantined"), c.get("duplicates"), message[:4000], began, datetime.now(UTC))])

    def audit(self, entity: str, event: str, **detail) -> None:
        self._append("audit", [(self.pipeline, self.run_id, entity, event, json.dumps(detail, default=str, sort_keys=True), datetime.now(UTC))])

    def quality(self, entity: str, batch_id: int, failures: dict[str, int]) -> None:
        at = datetime.now(UTC)
        self._append("quality", [(self.run_id, entity, batch_id, rule, n, at) for rule, n in failures.items()])

    def results(self, found: Iterable) -> None:
        """Reconciliation results, passed or not: written before anything raises."""
        at = datetime.now(UTC)
        self._append("results", [(r.check_type, r.entity, self.run_id, r.passed, r.source_value, r.target_value, r.detail, at) for r in found])


def alert(message: str, send: Callable[[str], None] | None = None) -> None:
    """Tell someone; trouble with telling never hides the failure that is told."""
    log.error(message)
    if send:
        try:
            send(message)
        except Exception:  # noqa: BLE001
            log.exception("the alert was not delivered")


def latest_status(run_log: DataFrame) -> DataFrame:
    """The last entry of each (layer, entity)."""
    newest = F.max_by(F.struct(*run_log.columns), F.struct("ended_at", "run_id"))
    return run_log.groupBy("layer", "entity").agg(newest.alias("r")).select("r.*")


# How each kind of table is kept in shape: what is done, the columns it is laid out by
# and, for tables partitioned by day, how many of the latest days.
MAINTENANCE = {
    "telemetry_raw": ("cluster_recent", ("partition_id",), 2),
    "sensor_reading": ("cluster_recent", ("machine_id", "sensor_type"), 3),
    "sensor_minute": ("compact", (), None),
    "bronze": ("compact", (), None),
    "silver": ("cluster", ("keys",), None),
    "gold": ("cluster_and_analyse", ("date_key",), None),
    "control": ("cluster", (), None),
    "erp_plant": ("vacuum_only", (), None),
}


def maintain(tables: dict[str, object], target_bytes: int = 128 << 20) -> dict[str, Exception | None]:
    """Lay out, analyse and vacuum versioned tables by their kind; one failure does not stop the
    rest. Consumers of a change feed see nothing of it."""

    def one(name: str) -> None:
        kind, table = tables[name]
        how, columns, days = MAINTENANCE[kind]
        if how != "vacuum_only":
            there = table.read().columns
            sort = tuple(c for c in (table.keys if columns == ("keys",) else columns) if c in there)
            recent = sorted(table.last()["segments"])[-days:] if days and table.partition_by else None
            table.optimise(sort, segments=recent, target_bytes=target_bytes)
            if how == "cluster_and_analyse":
                table.statistics([*dict.fromkeys([*sort, *table.keys, *table.partition_by])])
        table.vacuum()

    return run_isolated(tables, one, 1)
