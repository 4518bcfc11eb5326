"""Segmented tables, safe batches and the sources' upkeep."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quernflow import control, registry, session
from quernflow.functions.columns import digest
from quernflow.operators import asof, feed, contract, quality, reconcile, upsert
from quernflow.plans import facts, gold
from quernflow.sources import extract, landing
from quernflow.sources.versioned import VersionedTable
from quernflow.streaming import telemetry
from quernflow.streaming.silver import SilverProcessor

ROWS = "k long, v string, _sequence string, _is_deleted boolean, _row_hash string"


def rows(spark, *values):
    """(key, value, sequence, deleted) with a hash of the value."""
    return spark.createDataFrame([(k, v, s, d, v) for k, v, s, d in values], ROWS)


def keyed(spark, path, buckets=8):
    return VersionedTable(spark, f"file://{path}/t", ("k",), buckets=buckets)


class TestSegments:
    def test_untouched_segments_keep_their_directories(self, spark, tmp_path):
        t = keyed(spark, tmp_path)
        t.upsert(rows(spark, *[(k, "a", "1", False) for k in range(200)]))
        before = t.last()["segments"]
        t.upsert(rows(spark, (3, "b", "2", False)))
        after = t.last()["segments"]
        assert len(before) == 8 and sum(before[s] != after[s] for s in before) == 1
        assert {r["k"]: r["v"] for r in t.read().collect()} == {k: "b" if k == 3 else "a" for k in range(200)}
        assert t.read(0).where("v = 'b'").count() == 0

    def test_changes_of_an_upsert_are_those_of_a_comparison(self, spark, tmp_path):
        t = keyed(spark, tmp_path)
        t.upsert(rows(spark, *[(k, "a", "5", False) for k in range(20)]))
        t.upsert(rows(spark, (1, "b", "6", False), (2, "a", "6", True), (3, "late", "4", False), (4, "a", "6", False), (30, "n", "6", False), (31, "n", "6", True)))
        got = sorted((r["k"], r["_change_type"], r["_is_deleted"], r["_commit_version"]) for r in t.changes(0).collect())
        want = sorted((r["k"], r["_change_type"], r["_is_deleted"], r["_commit_version"]) for r in feed.changes(t.read(0), t.read(1), ("k",), version=1).collect())
        assert got == want and {(k, c) for k, c, _, _ in got} == {(1, "update_preimage"), (1, "update_postimage"), (2, "update_preimage"), (2, "update_postimage"), (30, "insert")}

    def test_hard_deletes_give_their_changes(self, spark, tmp_path):
        t = keyed(spark, tmp_path)
        t.upsert(rows(spark, (1, "a", "1", False), (2, "a", "1", False)), delete_mode="hard")
        t.upsert(rows(spark, (1, "a", "2", True), (9, "a", "2", True)), delete_mode="hard")
        assert [(r["k"], r["_change_type"]) for r in t.changes(0).collect()] == [(1, "delete")] and [r["k"] for r in t.read().collect()] == [2]

    def test_a_failed_audit_leaves_nothing(self, spark, tmp_path):
        t = keyed(spark, tmp_path)

        def refuse(written):
            raise reconcile.ReconciliationError(f"{written.count()} rows")

        with pytest.raises(reconcile.ReconciliationError, match="1 rows"):
            t.upsert(rows(spark, (1, "a", "1", False)), audit=refuse)
        assert not t.exists() and t.store.names(f"{t.root}/data") == []
        t.upsert(rows(spark, (1, "a", "1", False)), audit=lambda written: None)
        assert t.last()["metrics"]["changes"] == {"insert": 1}

    def test_partitions_are_replaced_alone(self, spark, tmp_path):
        t = VersionedTable(spark, f"file://{tmp_path}/t", ("k",), ("day",))
        make = lambda *x: spark.createDataFrame([(datetime(2024, 1, d).date() if d else None, k, v) for d, k, v in x], "day date, k long, v long")
        t.replace(make((1, 1, 1), (2, 2, 2), (3, 3, 3), (None, 4, 4)), None)
        before = t.last()["segments"]
        t.replace(make((2, 2, 9), (3, 3, 9)), [datetime(2024, 1, d).date() for d in (1, 2)])  # the third day is not asked for
        after = t.last()["segments"]
        assert set(after) == {"2024-01-02", "2024-01-03", "__none__"} and after["2024-01-03"] == before["2024-01-03"] and after["2024-01-02"] != before["2024-01-02"]
        assert {r["k"]: r["v"] for r in t.read().collect()} == {2: 9, 3: 3, 4: 4}
        assert sorted((r["k"], r["_change_type"]) for r in t.changes(0).collect()) == [(1, "delete"), (2, "update_postimage"), (2, "update_preimage")]

    def test_a_layout_rewrite_has_no_changes_and_vacuum_keeps_what_is_used(self, spark, tmp_path):
        t = keyed(spark, tmp_path)
        t.upsert(rows(spark, *[(k, "a", "1", False) for k in range(50)]))
        t.optimise(("k",), buckets=2)
        assert t.changes(0).count() == 0 and t.read().count() == 50 and len(t.last()["segments"]) == 2
        t.upsert(rows(spark, (1, "b", "2", False)))
        assert t.changes(0).count() == 2
        assert t.vacuum(now=t.last()["committed_at"] + 10**7) == [0, 1] and t.read().count() == 50
        assert t.statistics(["k", "v"]) == {"rows": 50, "columns": {"k": {"least": "0", "greatest": "49", "nulls": 0, "distinct": pytest.approx(50, abs=5)}, "v": {"least": "a", "greatest": "b", "nulls": 0, "distinct": 2}}}

    def test_consumers_survive_maintenance(self, spark, tmp_path):
        source, target = keyed(spark, tmp_path / "s"), VersionedTable(spark, f"file://{tmp_path}/serving", ("k",), buckets=4)
        marks = control.Watermarks(VersionedTable(spark, f"file://{tmp_path}/marks"))
        source.upsert(rows(spark, *[(k, "a", "1", False) for k in range(30)]))
        assert gold.publish_table(source, target, "t", marks).passed
        assert control.maintain({"s": ("gold", source)})["s"] is None
        before = target.last()["segments"]
        source.upsert(rows(spark, (5, "b", "2", False)))
        assert gold.publish_table(source, target, "t", marks).passed and target.read().where("v = 'b'").count() == 1
        after = target.last()["segments"]
        assert sum(before[s] != after[s] for s in before) == 1
        assert source.store.names(f"{source.root}/_statistics") == ["1.json"]

    def test_only_recent_days_are_clustered(self, spark, tmp_path):
        t = VersionedTable(spark, f"file://{tmp_path}/t", (), ("day",))
        t.replace(spark.range(40).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 4).cast("int")).alias("day"), "id", F.lit(0).alias("partition_id")), None, record_changes=False)
        before = t.last()["segments"]
        control.maintain({"t": ("telemetry_raw", t)})
        after = t.last()["segments"]
        assert [s for s in sorted(before) if before[s] != after[s]] == ["2024-01-03", "2024-01-04"] and t.read().count() == 40


class TestChanges:
    def test_a_delete_without_a_sequence_loses(self, spark):
        target = rows(spark, (1, "a", "1", False), (2, "a", "1", False))
        source = rows(spark, (1, "x", None, True), (2, "x", "2", True))
        assert [r["k"] for r in upsert.upsert(target, source, ["k"], delete_mode="hard").collect()] == [1]
        kept = {r["k"]: (r["v"], r["_is_deleted"]) for r in upsert.upsert(target, source, ["k"]).collect()}
        assert kept == {1: ("a", False), 2: ("x", True)}

    def test_different_rows_hash_differently(self, spark):
        pairs = [("a||b", "c"), ("a", "b||c"), ("~", None), (None, "~"), (None, None), ("", ""), ("1:a", ""), ("1:", "a")]
        frame = spark.createDataFrame(pairs, "x string, y string")
        assert frame.select(digest([F.col("x"), F.col("y")]).alias("h")).distinct().count() == len(pairs)

    def test_an_entity_without_rules(self, spark, tmp_path):
        free = registry.Entity("free", "S", registry.FULL, ("id",), ("id",), (registry.Attribute("id", "id", "bigint"),))
        batch = spark.createDataFrame([("1",), ("2",)], "id string")
        found = SilverProcessor(spark, free, VersionedTable(spark, f"file://{tmp_path}/t", ("id",)), f"file://{tmp_path}/q").process(batch, 0)
        assert found["read"] == 2 and found["rules"] == {}
        assert quality.rule_counts(quality.check(batch, ()), ()).count() == 0

    def test_a_contract_gap(self, spark):
        assert contract.gap(["a", "b"], ["b", "c"]) == (["a"], ["c"])
        assert contract.gap_rows(spark.range(3), spark.range(1, 4)).orderBy("id").collect() == [(0, "left"), (3, "right")]


class TestSilver:
    ENTITY = registry.Entity("e", "S", registry.FULL, ("id",), ("at",), (registry.Attribute("id", "id", "bigint"), registry.Attribute("v", "v"), registry.Attribute("at", "at")), {}, (registry.Rule("v", "v <> 'bad'"),))

    def batch(self, spark, *values):
        return spark.createDataFrame([(str(k), v, a) for k, v, a in values], "id string, v string, at string")

    def test_a_new_stream_is_not_a_replay(self, spark, tmp_path):
        make = lambda: SilverProcessor(spark, self.ENTITY, VersionedTable(spark, f"file://{tmp_path}/t", ("id",)), f"file://{tmp_path}/q", journal=control.Journal(spark, f"file://{tmp_path}/log"))
        assert make().process(self.batch(spark, (1, "a", "1")), 0, "one")["read"] == 1
        assert make().process(self.batch(spark, (1, "a", "1")), 0, "one")["replayed"]
        assert "replayed" not in make().process(self.batch(spark, (2, "b", "1")), 0, "two")
        assert sorted(r["id"] for r in make().table.read().collect()) == [1, 2]
        assert make().table.last()["streams"] == {"one": 0, "two": 0}
        journal = control.Journal(spark, f"file://{tmp_path}/log")
        log = journal.table("run_log")
        assert log.where("status = 'SUCCESS' AND layer = 'SILVER' AND rows_in = 1").count() == 2 and control.latest_status(log).first()["entity"] == "e"
        assert [json.loads(r["detail"])["version"] for r in journal.table("audit").orderBy("at").collect()] == [0, 1]
        assert journal.table("quality").count() == 2 and journal.table("results").where("passed").count() == 4
        reconcile.gate(journal.table("results"))

    def test_verification_reads_what_was_written(self, spark, tmp_path, monkeypatch):
        table = VersionedTable(spark, f"file://{tmp_path}/t", ("id",))
        journal = control.Journal(spark, f"file://{tmp_path}/log")
        processor = SilverProcessor(spark, self.ENTITY, table, f"file://{tmp_path}/q", journal=journal)
        real = upsert.upsert
        monkeypatch.setattr(upsert, "upsert", lambda *a, **k: real(*a, **k).where("id <> 2"))  # a write that loses a row
        with pytest.raises(reconcile.ReconciliationError, match="TARGET_VERIFY"):
            processor.process(self.batch(spark, (1, "a", "1"), (2, "b", "1")), 0)
        assert not table.exists() and journal.table("run_log").first()["status"] == control.FAILED and journal.table("audit").count() == 0
        with pytest.raises(reconcile.ReconciliationError, match="SILVER_TARGET_VERIFY"):
            reconcile.gate(journal.table("results"))
        monkeypatch.undo()
        assert processor.process(self.batch(spark, (1, "a", "1"), (2, "b", "1"), (3, "bad", "1")), 0)["quarantined"] == 1 and table.read().count() == 2

    def test_hard_mode_is_verified_too(self, spark, tmp_path, monkeypatch):
        gone = registry.Entity("e", "S", registry.FULL, ("id",), ("at",), self.ENTITY.attributes, {}, (), "v = 'gone'")
        table = VersionedTable(spark, f"file://{tmp_path}/t", ("id",))
        processor = SilverProcessor(spark, gone, table, f"file://{tmp_path}/q", delete_mode="hard")
        processor.process(self.batch(spark, (1, "a", "1"), (2, "a", "1")), 0)
        monkeypatch.setattr(upsert, "_newer", lambda s: F.lit(False))  # a merge that does not delete
        with pytest.raises(reconcile.ReconciliationError, match="TARGET_VERIFY"):
            processor.process(self.batch(spark, (1, "gone", "2")), 1)
        monkeypatch.undo()
        processor.process(self.batch(spark, (1, "gone", "2")), 1)
        assert [r["id"] for r in table.read().collect()] == [2]


class TestLookups:
    def test_sorted_lookup_by_slices(self, spark):
        at = lambda m, d: datetime(2024, m, d)
        versions = [("a", at(1, 5), 1), ("a", at(1, 20), 2), ("a", at(6, 1), 3), ("b", at(3, 3), 4)]
        asked = [("a", at(1, 1)), ("a", at(1, 5)), ("a", at(1, 19)), ("a", at(2, 2)), ("a", at(5, 31)), ("a", at(12, 1)), ("b", at(1, 1)), ("b", at(9, 9)), ("c", at(1, 1))]
        got = asof.asof_sorted(spark.createDataFrame(asked, "k string, at timestamp"), spark.createDataFrame(versions, "k string, since timestamp, v long"), "k", "at", "since", "v")
        want = {(k, t): max(((s, v) for key, s, v in versions if key == k and s <= t), default=(0, None), key=lambda x: x[1])[1] for k, t in asked}
        assert {(r["k"], r["at"]): r["v"] for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_key" in plan and "_slice" in plan

    def test_readings_meet_runs_by_time_slice(self, spark):
        runs = spark.createDataFrame([(1, "M", "P", datetime(2024, 3, 1, 8, 30), datetime(2024, 3, 1, 11), False), (2, "M", "P", datetime(2024, 3, 1, 10), None, False)], "production_log_id long, machine_id string, product_id string, start_ts timestamp, end_ts timestamp, _is_deleted boolean")
        times = [(8, 29), (8, 30), (9, 0), (9, 59), (10, 0), (11, 0), (11, 1)]
        readings = spark.createDataFrame([("M", "t", 1.0, datetime(2024, 3, 1, h, m)) for h, m in times], "machine_id string, sensor_type string, reading_value double, event_ts timestamp").withColumn("event_date", F.to_date("event_ts"))
        out = facts.process_run_sensor(runs, readings)
        assert [(r["production_log_id"], r["reading_count"]) for r in out.collect()] == [(1, 5)]
        joins = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "[" in line]
        assert joins and all("_slice" in line for line in joins)


class TestSources:
    def test_files_are_archived_after_their_rows_are_published(self, spark, tmp_path):
        root, drop, old = f"file://{tmp_path}", tmp_path / "drop", tmp_path / "old"
        drop.mkdir()
        (drop / "a.csv").write_text("x,y\n1,2\n3\n")
        (drop / "note.txt").write_text("stays")
        target = f"{root}/raw/run_id=r1"
        assert landing.land_csv(spark, root, f"{root}/drop", f"{root}/old", target, ["x", "y"]) == (1, 1)
        assert sorted(p.name for p in drop.iterdir() if not p.name.endswith(".crc")) == ["note.txt"] and (old / "a.csv").exists()
        assert spark.read.parquet(target).count() == 1 and landing.land_csv(spark, root, f"{root}/drop", f"{root}/old", target, ["x", "y"]) == (0, 0)
        assert landing.archive_drop(spark, root, f"{root}/drop", f"{root}/old", ["a.csv"]) == []  # moved before

    def test_a_paged_source_never_ends_early_in_silence(self, spark):
        pages = [json.dumps({"data": [{"k": str(n)}]}) for n in range(5)] + [json.dumps({"data": []})] * 9
        read = lambda most, **o: extract.paged_source("p", "k string", lambda n, t="t": pages[n - 1] if t == "t" else 1 / 0, most, 2, **o)
        spark.dataSource.register(read(5, token=lambda: "t", spacing=0.01))
        assert sorted(r["k"] for r in spark.read.format("p").load().collect()) == list("01234")
        spark.dataSource.register(read(4))
        with pytest.raises(Exception, match="still has rows"):
            spark.read.format("p").load().collect()

    def test_stream_settings(self, spark, tmp_path):
        before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
        try:
            session.tune_stream(spark, 3)
            (tmp_path / "in").mkdir()
            body = lambda m, v: json.dumps({"device_id": "d", "machine_id": "m", "sensor_type": "temperature", "reading_value": v, "event_ts": f"2024-03-01T08:{m:02d}:00Z"})
            (tmp_path / "in/a.jsonl").write_text("\n".join([body(0, 1.0), body(0, 1.0), body(1, 2.0), body(40, 3.0)]))
            places = telemetry.Places(f"file://{tmp_path}")
            telemetry.land_events(telemetry.raw_events(spark, f"file://{tmp_path}/in"), places).awaitTermination()
            for q in telemetry.start_queries(spark, places):
                q.awaitTermination()
            assert spark.read.parquet(places.data("sensor_reading")).count() == 3
            state = list((tmp_path / "_checkpoints/sensor_reading/state/0").iterdir())
            assert len([p for p in state if p.name.isdigit()]) == 3 and any(f.suffix == ".zip" for p in state for f in p.rglob("*"))  # RocksDB's snapshots
        finally:
            for k, v in before.items():
                spark.conf.set(k, v) if v is not None else spark.conf.unset(k)

    def test_batch_settings(self, spark):
        before = {k: spark.conf.get(k, None) for k in [*session.BATCH_CONF, "spark.sql.shuffle.partitions"]}
        try:
            assert session.tune(spark, 7).conf.get("spark.sql.shuffle.partitions") == "7" and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "64m"
        finally:
            for k, v in before.items():
                spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
