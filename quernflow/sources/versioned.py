"""Versioned tables on a plain file store: segment directories plus commit files.

A table is a set of *segments*: the values of ``partition_by``, or ``buckets`` hash buckets of
the keys, or one for all. ``<root>/data/<id>/_segment=<s>/`` holds a segment's Parquet,
``<root>/_commits/<n>.json`` names the directory of each segment of version n, and
``<root>/_changes/<n>/`` keeps the change rows of the commit, if it recorded them (those of the
first version are its data). A commit
that touches a few segments writes those and names the older directories of all others, so
its cost follows what changed and not the table.

A commit file is written to a temporary name and renamed, so a version appears at once or not
at all; readers take the highest committed version. What was written can be audited before
that. Every file operation goes through the file system that Spark itself uses, so the store
may be local or remote.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernflow.operators import feed, upsert
from quernflow.session import files_for

SEGMENT = "_segment"
NO_VALUE = "__none__"


class FileStore:
    """The few file operations that commits need, on Spark's file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write under another name and rename; raises if ``path`` is there already."""
        draft = f"{path}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(draft), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self.path(path)) or not self.fs.rename(self.path(draft), self.path(path)):
            self.delete(draft)
            raise FileExistsError(path)

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self.path(path)).getLength()

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise FileExistsError(new)


class RetentionError(LookupError):
    """A consumer asks for changes that have been removed."""


@dataclass
class VersionedTable:
    spark: SparkSession
    root: str
    keys: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    buckets: int = 16

    @property
    def store(self) -> FileStore:
        return FileStore(self.spark, self.root)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.store.names(f"{self.root}/_commits") if n.endswith(".json"))

    def latest(self) -> int | None:
        found = self.versions()
        return found[-1] if found else None

    def exists(self) -> bool:
        return self.latest() is not None

    def info(self, version: int) -> dict:
        return json.loads(self.store.read(f"{self.root}/_commits/{version}.json"))

    def last(self) -> dict | None:
        """The latest commit, one file read whatever the history."""
        version = self.latest()
        return None if version is None else self.info(version)

    def history(self) -> list[dict]:
        return [self.info(v) for v in self.versions()]

    # ------------------------------------------------------------ segments

    def segment(self, buckets: int) -> Column:
        """The segment of a row."""
        if self.partition_by:
            return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(NO_VALUE)) for c in self.partition_by])
        if self.keys and buckets > 1:
            return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("string")
        return F.lit("all")

    def touched(self, rows: DataFrame, buckets: int) -> list[str]:
        """The segments of some rows: never more than the table has days or buckets."""
        return sorted(r[0] for r in rows.select(self.segment(buckets).alias(SEGMENT)).distinct().collect())

    def _write(self, df: DataFrame, buckets: int, laid_out: bool = False) -> dict[str, str]:
        """Write rows by segment; the directory of each segment that has any."""
        data = f"data/{uuid.uuid4().hex}"
        rows = df.withColumn(SEGMENT, self.segment(buckets))
        # the rebalance hint gathers a segment's rows and splits those that are too large for a task
        rows = rows.hint("rebalance", SEGMENT) if not laid_out and (buckets > 1 or self.partition_by) else rows
        rows.write.partitionBy(SEGMENT).parquet(f"{self.root}/{data}")
        names = [n for n in self.store.names(f"{self.root}/{data}") if n.startswith(f"{SEGMENT}=")]
        return {unquote(n.removeprefix(f"{SEGMENT}=")): f"{data}/{n}" for n in names}

    def _load(self, segments: dict[str, str], schema: str) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{d}" for _, d in sorted(segments.items())])

    def read(self, version: int | None = None, segments: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version, or of some of its segments."""
        version = self.latest() if version is None else version
        if version is None or version not in self.versions():
            raise LookupError(f"{self.root} has no version {version}")
        commit = self.info(version)
        wanted = commit["segments"] if segments is None else {s: d for s, d in commit["segments"].items() if s in set(segments)}
        return self._load(wanted, commit["schema"])

    # ------------------------------------------------------------ commits

    def _publish(self, before: dict | None, segments: dict[str, str], schema: str, operation: str, run_id: str, metrics: dict | None, buckets: int, changes: Callable[[int], DataFrame | None] | None, stream: tuple[str, int] | None, data_change: bool = True) -> int:
        version = 0 if before is None else before["version"] + 1
        metrics, recorded = dict(metrics or {}), None
        if changes and before is None:
            recorded = "segments"  # all rows of the first version are inserts: the data itself tells
            metrics["changes"] = {feed.INSERT: self._load(segments, schema).count()}
        elif changes:
            rows, recorded = changes(version), "rows"
            place = f"{self.root}/_changes/{version}"
            rows.write.mode("overwrite").parquet(place)
            counts = self.spark.read.schema(rows.schema).parquet(place).groupBy("_change_type").count().collect()
            metrics["changes"] = {r[0]: r[1] for r in counts}
        streams = dict(before["streams"]) if before else {}
        if stream:
            streams[stream[0]] = stream[1]
        entry = {
            "version": version, "segments": segments, "buckets": buckets, "operation": operation, "run_id": run_id, "metrics": metrics, "schema": schema,
            "streams": streams, "data_change": data_change, "recorded": recorded, "committed_at": time.time(),
        }
        self.store.create(f"{self.root}/_commits/{version}.json", json.dumps(entry))
        return version

    def commit(self, df: DataFrame, operation: str, run_id: str = "", metrics: dict | None = None, record_changes: bool = False) -> int:
        """Write ``df`` as the whole of the next version; with a key its change rows can be kept beside it.

        Change rows are derived from the version that was just written, not from the plan.
        """
        before = self.last()
        buckets = self.buckets if self.keys and not self.partition_by else 1
        segments, schema = self._write(df, buckets), _ddl(df)

        def changes(version: int) -> DataFrame:
            new = self._load(segments, schema)
            old = new.limit(0) if before is None else self._load(before["segments"], before["schema"]).select(*new.columns)
            return feed.changes(old, new, self.keys, version=version)

        return self._publish(before, segments, schema, operation, run_id, metrics, buckets, changes if record_changes and self.keys else None, None)

    def upsert(self, source: DataFrame, sequence: str = "_sequence", deleted: str = "_is_deleted", delete_mode: str = "soft", keep_tombstones: bool = False, operation: str = "MERGE", run_id: str = "", metrics: dict | None = None, audit: Callable[[DataFrame], None] | None = None, stream: tuple[str, int] | None = None) -> int:
        """Apply changes, one row a key (see ``operators.upsert``), to the buckets that they fall into.

        The other buckets keep their directories. Change rows come from joining the source with
        those buckets, not from a comparison of two versions. ``audit`` sees the written buckets
        before the version appears; if it raises, nothing has happened.
        """
        if self.partition_by or not self.keys:
            raise ValueError("an upsert needs a table that is bucketed by its keys")
        before = self.last()
        buckets = before["buckets"] if before else self.buckets
        schema = before["schema"] if before else _ddl(source)
        touched = self.touched(source, buckets) if buckets > 1 else ["all"]
        old = {s: d for s, d in (before["segments"] if before else {}).items() if s in set(touched)}
        target, options = self._load(old, schema), {"sequence": sequence, "deleted": deleted, "delete_mode": delete_mode, "keep_tombstones": keep_tombstones}
        fresh = self._write(upsert.upsert(target, source, self.keys, **options), buckets)
        if audit:
            try:
                audit(self._load(fresh, schema))
            except Exception:
                self._discard(fresh)
                raise
        segments = {s: d for s, d in (before["segments"] if before else {}).items() if s not in set(touched)} | fresh
        changes = lambda version: upsert.upsert_changes(target, source, self.keys, **options).withColumn("_commit_version", F.lit(version).cast("long"))
        return self._publish(before, segments, schema, operation, run_id, metrics, buckets, changes, stream)

    def replace(self, fresh: DataFrame, values: Sequence | None, operation: str = "REPLACE", run_id: str = "", metrics: dict | None = None, record_changes: bool = True) -> int:
        """Replace the partitions of the given values (of the single partition column); None: all.

        Rows of ``fresh`` outside the values are left out, and values without rows lose their partition.
        Only these partitions are written and compared.
        """
        if len(self.partition_by) != 1:
            raise ValueError("a table of one partition column")
        before = self.last()
        names = None if values is None else {NO_VALUE if v is None else str(v) for v in values}
        schema = _ddl(fresh)
        written = self._write(fresh if names is None else fresh.where(F.coalesce(F.col(self.partition_by[0]).cast("string"), F.lit(NO_VALUE)).isin(*sorted(names)) if names else F.lit(False)), 1)
        old = {s: d for s, d in (before["segments"] if before else {}).items() if names is None or s in names}
        segments = {s: d for s, d in (before["segments"] if before else {}).items() if s not in old} | written

        def changes(version: int) -> DataFrame:
            new = self._load(written, schema)
            return feed.changes(self._load(old, schema).select(*new.columns), new, self.keys, version=version)

        return self._publish(before, segments, schema, operation, run_id, metrics, 1, changes if record_changes and self.keys else None, None)

    def apply(self, collapsed: DataFrame, operation: str = "MERGE", run_id: str = "") -> int:
        """Apply a collapsed change feed to the buckets that its keys fall into."""
        before = self.last()
        if before is None or self.partition_by or not self.keys:
            raise ValueError("an existing table that is bucketed by its keys")
        touched = set(self.touched(collapsed, before["buckets"])) if before["buckets"] > 1 else {"all"}
        old = {s: d for s, d in before["segments"].items() if s in touched}
        fresh = self._write(feed.apply_feed(self._load(old, before["schema"]), collapsed, self.keys), before["buckets"])
        segments = {s: d for s, d in before["segments"].items() if s not in touched} | fresh
        return self._publish(before, segments, before["schema"], operation, run_id, None, before["buckets"], None, None)

    # ------------------------------------------------------------ changes and upkeep

    def changes(self, after: int | None, to: int | None = None) -> DataFrame | None:
        """Change rows of the versions after ``after``. None: start over from the whole table.

        Versions that only lay the rows out anew have no changes. Raises if some of the others'
        changes are gone, rather than skipping them.
        """
        to = self.latest() if to is None else to
        if after is None or to is None:
            return None
        kept, wanted, gone = set(self.versions()), [], []
        for v in range(after + 1, to + 1):
            entry = self.info(v) if v in kept else None
            if entry is None or (entry["data_change"] and not entry["recorded"]):
                gone.append(v)
            elif entry["data_change"]:
                wanted.append(entry)
        if gone:
            raise RetentionError(f"{self.root}: changes of versions {gone} are not retained")
        if not wanted:
            return self.read(to).limit(0).withColumns({"_change_type": F.lit(""), "_commit_version": F.lit(0).cast("long")})
        written = [f"{self.root}/_changes/{e['version']}" for e in wanted if e["recorded"] == "rows"]
        parts = [self.spark.read.parquet(*written)] if written else []
        for e in wanted:
            if e["recorded"] == "segments":
                parts.append(self._load(e["segments"], e["schema"]).withColumns({"_change_type": F.lit(feed.INSERT), "_commit_version": F.lit(e["version"]).cast("long")}))
        return reduce(DataFrame.unionByName, parts)

    def _discard(self, segments: dict[str, str]) -> None:
        for folder in {d.rpartition("/")[0] for d in segments.values()}:
            self.store.delete(f"{self.root}/{folder}")

    def vacuum(self, retain_hours: float = 168.0, floor_hours: float = 168.0, now: float | None = None) -> list[int]:
        """Remove versions older than the retention, never the latest one, and the directories
        that no version left names."""
        if retain_hours < floor_hours:
            raise ValueError(f"retention under {floor_hours} hours")
        limit = (time.time() if now is None else now) - retain_hours * 3600
        entries = self.history()
        gone = [e for e in entries[:-1] if e["committed_at"] < limit]
        used = {d for e in entries if e not in gone for d in e["segments"].values()}
        for e in gone:
            for d in set(e["segments"].values()) - used:
                self.store.delete(f"{self.root}/{d}")
            self.store.delete(f"{self.root}/_changes/{e['version']}")
            self.store.delete(f"{self.root}/_commits/{e['version']}.json")
        return [e["version"] for e in gone]

    def optimise(self, sort_by: tuple[str, ...] = (), run_id: str = "", segments: Sequence[str] | None = None, buckets: int | None = None, target_bytes: int = 128 << 20) -> int:
        """Write the segments (or the given ones) anew, clustered by ``sort_by`` in files of about
        ``target_bytes``; with ``buckets`` the whole table is dealt into that many. The rows stay
        the same, so the version has no changes."""
        before = self.last()
        if before is None:
            raise LookupError(f"{self.root} has no version None")
        if buckets and segments is not None:
            raise ValueError("a new number of buckets concerns all segments")
        number = buckets or before["buckets"]
        chosen = {s: d for s, d in before["segments"].items() if segments is None or s in set(segments)}
        store = self.store
        files = sum(files_for(store.size(f"{self.root}/{d}"), target_bytes) for d in chosen.values())
        rows = self._load(chosen, before["schema"]).withColumn(SEGMENT, self.segment(number))
        order = [SEGMENT, *sort_by]
        laid = self._write(rows.repartitionByRange(max(1, files, buckets or 0), *order).sortWithinPartitions(*order).drop(SEGMENT), number, laid_out=True)
        segments = {s: d for s, d in before["segments"].items() if s not in chosen} | laid
        return self._publish(before, segments, before["schema"], "OPTIMISE", run_id, None, number, None, None, data_change=False)

    def statistics(self, columns: Sequence[str]) -> dict:
        """Row count and least, greatest, null and distinct values of columns, kept beside the latest version."""
        rows = self.read()
        per = [x for c in columns for x in (F.min(c).cast("string"), F.max(c).cast("string"), F.count_if(F.col(c).isNull()), F.approx_count_distinct(c))]
        found = list(rows.agg(F.count(F.lit(1)), *per).first())
        names = ("least", "greatest", "nulls", "distinct")
        out = {"rows": found[0], "columns": {c: dict(zip(names, found[1 + 4 * i : 5 + 4 * i], strict=True)) for i, c in enumerate(columns)}}
        path = f"{self.root}/_statistics/{self.latest()}.json"
        self.store.delete(path)
        self.store.create(path, json.dumps(out))
        return out


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
