"""Bronze to silver: each micro-batch is cleansed, checked, deduplicated, merged and reconciled.

An exception leaves the offset where it was, so the batch comes again; every write of a
batch goes to a place named by its stream and batch id and replaces what an earlier attempt
left. The table's commits carry the last batch of each stream, so a repeated batch is known by
the latest commit alone, and a new checkpoint is a new stream.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernflow import control
from quernflow.operators import cleanse, dedup, quality, reconcile
from quernflow.registry import Entity
from quernflow.sources.landing import read_bronze_stream
from quernflow.sources.versioned import FileStore, VersionedTable

DIRECT = "direct"


@dataclass
class SilverProcessor:
    spark: SparkSession
    entity: Entity
    table: VersionedTable
    quarantine: str
    run_id: str = "local"
    as_of: str | None = None
    delete_mode: str = "soft"
    journal: control.Journal | None = None
    metrics: list[dict] = field(default_factory=list)

    def process(self, batch: DataFrame, batch_id: int, stream: str = DIRECT) -> dict:
        """One micro-batch of a stream, all or nothing for the silver table."""
        last, began = self.table.last(), datetime.now(UTC)
        if last and last["streams"].get(stream, -1) >= batch_id:
            return {"batch_id": batch_id, "replayed": True}
        try:
            found = self._merge(batch, batch_id, stream)
        except Exception as error:
            if self.journal:
                self.journal.run("SILVER", self.entity.name, control.FAILED, began, batch_id=batch_id, message=str(error))
            raise
        if self.journal:
            self.journal.run("SILVER", self.entity.name, control.SUCCESS, began, found, batch_id)
            self.journal.quality(self.entity.name, batch_id, found["rules"])
            self.journal.audit(self.entity.name, "MERGE", batch_id=batch_id, stream=stream, version=self.table.latest())
        self.metrics.append(found)
        return found

    def _merge(self, batch: DataFrame, batch_id: int, stream: str) -> dict:
        rows = cleanse.add_row_metadata(cleanse.standardise(batch, self.entity), self.entity, self.run_id)
        checked = quality.check(rows, self.entity.rules, self.as_of).persist()
        latest = None
        try:
            bad = F.size("_dq_errors") > 0
            read = batch.count()  # on its own, not from the cleansed rows
            failed = F.concat("_dq_errors", "_dq_warnings")
            n_bad, n_valid, *failures = checked.agg(F.count_if(bad), F.count_if(~bad), *[F.count_if(F.array_contains(failed, r.name)) for r in self.entity.rules]).first()
            latest = dedup.deduplicate(checked.where(~bad).drop("_dq_errors"), self.entity.keys).persist()
            n_latest = latest.count()
            self._check(reconcile.silver_balance(self.entity.name, read, n_latest, n_bad, n_valid - n_latest))
            place = f"{self.quarantine}/stream={stream}/batch_id={batch_id}"
            if n_bad:
                checked.where(bad).withColumns({"_quarantined_ts": F.current_timestamp(), "_batch_id": F.lit(batch_id).cast("long")}).write.mode("overwrite").parquet(place)
            found = {"batch_id": batch_id, "read": read, "valid": n_valid, "quarantined": n_bad, "duplicates": n_valid - n_latest, "rules": dict(zip([r.name for r in self.entity.rules], failures, strict=True))}
            self.table.upsert(latest, delete_mode=self.delete_mode, run_id=self.run_id, metrics=found, audit=lambda written: self._verify(latest, written), stream=(stream, batch_id))
            return found
        finally:
            checked.unpersist()
            if latest is not None:
                latest.unpersist()

    def _verify(self, batch: DataFrame, written: DataFrame) -> None:
        """What was written holds every row of the batch in this version or a newer one, and with
        hard deletes none that the batch deletes."""
        if self.delete_mode == "hard":
            dead = batch.where("_is_deleted").select(*self.entity.keys, F.col("_sequence").alias("_deleted_at"))
            left = written.join(dead, list(self.entity.keys), "inner").where("_deleted_at > _sequence").select(*self.entity.keys)
            batch, missing = batch.where("NOT _is_deleted"), left.count()
        else:
            missing = 0
        missing += reconcile.missing_or_older(batch, written, self.entity.keys).count()
        self._check(reconcile.compare_counts(self.entity.name, 0, missing, check_type="SILVER_TARGET_VERIFY"))

    def _check(self, result: reconcile.Result) -> None:
        if self.journal:
            self.journal.results([result])
        reconcile.assert_all_passed([result])

    def run(self, bronze: str, checkpoint: str, max_files: int = 200) -> None:
        """Everything that bronze has and silver has not. The stream is known by its checkpoint's id."""
        schema = self.spark.read.parquet(bronze).schema
        store = FileStore(self.spark, checkpoint)

        def each(batch: DataFrame, number: int) -> None:
            self.process(batch, number, json.loads(store.read(f"{checkpoint}/metadata"))["id"])

        writer = read_bronze_stream(self.spark, bronze, schema, max_files).writeStream.foreachBatch(each)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
