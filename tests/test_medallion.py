"""Sources, control plane, streams and gold on the two-day scenario."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quernflow import control, datagen, registry
from quernflow.operators import calendar, history, reconcile
from quernflow.plans import catalog, facts, gold, views
from quernflow.session import files_for
from quernflow.sources import extract, landing
from quernflow.sources.versioned import RetentionError, VersionedTable
from quernflow.streaming import telemetry
from quernflow.streaming.silver import SilverProcessor

EMPTY = {
    "dim_machine": ("machine_id", facts.MACHINE, "machine_sk"),
    "dim_product": ("product_id", facts.PRODUCT, "product_sk"),
}


DAILY = ("fact_production_daily", "fact_machine_daily", "fact_process_run_sensor")
KEYED = {"fact_production_daily": ("production_date", "machine_id", "product_id"), "fact_machine_daily": ("production_date", "machine_id"), "fact_process_run_sensor": ("production_log_id", "sensor_type")}


class Lakehouse:
    """Bronze, silver and gold under one folder."""

    def __init__(self, spark, root: str) -> None:
        self.spark, self.root, self.extracts = spark, root, datagen.Extracts()
        self.silver = {n: VersionedTable(spark, f"{root}/silver/{n}", e.keys) for n, e in registry.ENTITIES.items()}
        self.gold = {n: VersionedTable(spark, f"{root}/gold/{n}", KEYED.get(n, ()), ("production_date",) if n in DAILY else ()) for n in gold.PUBLISHED}
        self.watermarks = control.Watermarks(VersionedTable(spark, f"{root}/control/watermarks"))
        self.processors = {n: SilverProcessor(spark, e, self.silver[n], f"{root}/quarantine/{n}", run_id="r", as_of="2024-03-02") for n, e in registry.ENTITIES.items()}

    def day(self, day: str, names=tuple(registry.ENTITIES), **options) -> None:
        datagen.land(self.spark, self.root, self.extracts, day, **options)
        for n in names:
            e = registry.ENTITIES[n]
            landing.ingest_to_bronze(self.spark, landing.raw_folder(self.root, e), f"{self.root}/bronze/{n}", f"{self.root}/_check/bronze/{n}", e)
            self.processors[n].run(f"{self.root}/bronze/{n}", f"{self.root}/_check/silver/{n}")

    def dimensions(self) -> None:
        for name, build, source in (("dim_machine", facts.dim_machine, "mes_machine"), ("dim_product", facts.dim_product, "erp_product")):
            key, tracked, sk = EMPTY[name]
            rows = self.silver[source].read()
            if self.gold[name].exists():
                target = self.gold[name].read()
            else:
                typed = rows.withColumn("is_source_deleted", F.lit(False)) if name == "dim_machine" else rows
                target = history.empty_scd2(typed, [key], tracked, sk)
            self.gold[name].commit(build(target, rows), "SCD2")
        for name, build, source, key, tracked, sk in (("dim_plant", facts.dim_plant, "erp_plant", "plant_id", facts.PLANT, "plant_sk"), ("dim_supplier", facts.dim_supplier, "supplier_delivery", "supplier_id", ("supplier_name",), "supplier_sk")):
            rows = self.silver[source].read()
            empty = rows.limit(0).select(F.lit(0).cast("long").alias(sk), key, *tracked, F.lit("").alias("attr_hash"))
            self.gold[name].commit(build(self.gold[name].read() if self.gold[name].exists() else empty, rows), "SCD1")
        self.gold["dim_date"].commit(calendar.dim_date(self.spark, "2024-01-01", "2024-12-31"), "SEED")

    def builder(self) -> gold.Gold:
        return gold.Gold(self.spark, self.silver, self.gold, self.watermarks)


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    """Both days loaded, gold built after each."""
    h = Lakehouse(spark, f"file://{tmp_path_factory.mktemp('house')}")
    h.day(datagen.DAYS[0])
    h.first = {n: h.processors[n].metrics[-1] for n in h.processors}
    h.dimensions()
    h.first_dates = h.builder().build()
    h.first_production = {(r["production_date"], r["machine_id"], r["product_id"]): r for r in h.gold["fact_production_daily"].read().collect()}
    with pytest.raises(reconcile.ReconciliationError):
        h.day(datagen.DAYS[1])
        h.dimensions()
        h.builder().build(fail_after="fact_production_daily")
    h.after_failure = h.watermarks.get(gold.CONSUMER, "mes_production_log")
    h.second_dates = h.builder().build()
    return h


class TestSilver:
    def test_day_one_counts(self, house):
        m = house.first["mes_production_log"]
        assert (m["read"], m["valid"], m["quarantined"], m["duplicates"]) == (38, 36, 2, 2)
        assert m["rules"]["non_negative_units"] == 1 and m["rules"]["end_after_start"] == 1 and m["rules"]["shift_in_domain"] == 1
        assert house.first["mes_quality_inspection"]["quarantined"] == 1 and house.first["erp_product"]["rules"]["name_present"] == 1
        assert house.first["supplier_delivery"]["duplicates"] == 1 and house.first["supplier_delivery"]["quarantined"] == 1

    def test_day_two_repairs_updates_and_deletes(self, house):
        rows = {r["production_log_id"]: r for r in house.silver["mes_production_log"].read().collect()}
        run = lambda i: rows.get(100_000 + i)
        assert (run(datagen.CHANGED_AT_ONCE)["units_produced"], run(datagen.CHANGED_AT_ONCE)["units_scrapped"]) == (333, 7)  # not the late one's 1
        assert run(datagen.DELETED)["_is_deleted"] and not run(datagen.BROUGHT_BACK)["_is_deleted"] and run(datagen.BROUGHT_BACK)["operator_id"] == "OP99"
        assert run(14)["product_id"] == "PRD-1007" and run(27)["shift_code"] == "C" and run(31)["shift_code"] == "UNKNOWN" and run(30)["shift_code"] == "N"
        assert run(17)["end_ts"] > run(17)["start_ts"] and run(22) is None and run(33)["end_ts"] is None
        seen = {r["inspection_id"]: r for r in house.silver["mes_quality_inspection"].read().collect()}
        assert seen[500_002]["inspection_result"] == "PASS" and seen[500_002]["defect_code"] == "NONE" and seen[500_019]["defect_count"] == 0
        assert 500_025 not in seen and seen[500_000 + datagen.INSPECTION_DELETED]["_is_deleted"] and seen[500_000 + datagen.INSPECTED_AGAIN]["inspection_result"] == "FAIL"

    def test_lineage(self, house):
        got = house.spark.read.parquet(f"{house.root}/bronze/erp_plant").select("_ingestion_run_id", "_load_date", "_source_system").distinct().orderBy("_load_date").first()
        assert got["_ingestion_run_id"] == "erp_plant_20240301_01" and str(got["_load_date"]) == "2024-03-01" and got["_source_system"] == "ORACLE_ERP"

    def test_a_replayed_batch_changes_nothing(self, house):
        table = house.silver["erp_plant"]
        before = table.latest()
        assert house.processors["erp_plant"].process(house.spark.read.parquet(f"{house.root}/bronze/erp_plant"), 0, *table.last()["streams"])["replayed"]
        assert table.latest() == before

    def test_a_failed_check_leaves_the_table(self, spark, tmp_path, monkeypatch):
        h = Lakehouse(spark, f"file://{tmp_path}")
        monkeypatch.setattr(reconcile, "missing_or_older", lambda *a, **b: spark.range(1))
        with pytest.raises(Exception, match="TARGET_VERIFY"):
            h.day(datagen.DAYS[0], names=("erp_plant",))
        assert not h.silver["erp_plant"].exists()
        monkeypatch.undo()
        h.processors["erp_plant"].run(f"{h.root}/bronze/erp_plant", f"{h.root}/_check/silver/erp_plant")
        assert h.silver["erp_plant"].read().count() == 3

    def test_manifests(self, spark, tmp_path):
        h = Lakehouse(spark, f"file://{tmp_path}")
        h.day(datagen.DAYS[0], names=("erp_product",), overstate={"erp_product": 5})
        manifests = landing.read_manifests(spark, h.root, "erp_product")
        bronze = spark.read.parquet(f"{h.root}/bronze/erp_product")
        none = spark.createDataFrame([], "run_id string")
        gap = reconcile.manifest_gaps(manifests, bronze, none).first()
        assert not gap["passed"] and gap["rows_copied"] - gap["landed_rows"] == 5
        assert reconcile.manifest_gaps(manifests, bronze, manifests.select("run_id")).count() == 0
        assert landing.read_manifests(spark, h.root, "nothing").count() == 0

    def test_new_source_columns_reach_bronze(self, spark, tmp_path):
        e, root = registry.ENTITIES["erp_plant"], f"file://{tmp_path}"
        schema = landing.raw_schema(e)
        for day, extra in (("2024-03-01", False), ("2024-03-02", True)):
            df = spark.createDataFrame([tuple("x" for _ in schema)], schema)
            (df.withColumn("REGION", F.lit("south")) if extra else df).write.parquet(landing.raw_path(root, e, day, f"r{day}"))
            landing.ingest_to_bronze(spark, landing.raw_folder(root, e), f"{root}/bronze", f"{root}/_c", e)
        assert spark.read.option("mergeSchema", True).parquet(f"{root}/bronze").where("REGION = 'south'").count() == 1


class TestGold:
    def test_nothing_advances_on_failure(self, house):
        assert house.first_dates is None and house.after_failure == 0
        assert [str(d) for d in house.second_dates] == list(datagen.DAYS)
        assert house.watermarks.get(gold.CONSUMER, "mes_production_log") == house.silver["mes_production_log"].latest()

    def test_production_follows_corrections(self, house):
        rows = house.gold["fact_production_daily"].read()
        assert rows.where(f"production_date = DATE'{datagen.DAYS[0]}'").agg(F.sum("production_runs")).first()[0] == 34
        assert rows.where("machine_sk = -1 OR plant_sk = -1").count() == 0
        assert rows.where("ideal_units IS NULL").count() == 0
        assert rows.groupBy("production_date", "machine_id", "product_id").count().where("count > 1").count() == 0

    def test_versions_in_force(self, house):
        d = house.gold["dim_product"].read().where("product_id = 'PRD-1006'").orderBy("effective_from").collect()
        assert [r["std_cycle_time_sec"] for r in d] == [60, 52] and [r["is_current"] for r in d] == [False, True]
        m = house.gold["dim_machine"].read().where("machine_id = 'M-P01-03'").orderBy("effective_from").collect()
        assert [r["line_id"] for r in m] == ["L1", "L2"]
        day2 = f"production_date = DATE'{datagen.DAYS[1]}' AND machine_id = 'M-P01-03'"
        runs, days = house.gold["fact_production_daily"].read().where(day2).first(), house.gold["fact_machine_daily"].read().where(day2).first()
        assert runs["machine_sk"] == m[1]["machine_sk"] and days["machine_sk"] == m[0]["machine_sk"]  # first run against midnight

    def test_effectiveness_edges(self, house):
        f = house.gold["fact_machine_daily"].read()
        broken = f.where(f"machine_id = 'M-P01-02' AND production_date = DATE'{datagen.DAYS[1]}'").first()
        assert broken["available_minutes"] == 0 and broken["availability"] == 0.0
        idle = facts.effectiveness(house.spark.createDataFrame([(1440, 1440, 0, 0, None)], "planned_minutes long, available_minutes long, units_produced long, units_good long, ideal_units long")).first()
        assert idle["performance"] == 1.0 and idle["quality"] is None and idle["oee"] is None
        assert facts.effectiveness(house.spark.createDataFrame([(1440, 1440, 0, 0, None)], "planned_minutes long, available_minutes long, units_produced long, units_good long, ideal_units long"), True).first()["oee"] == 0.0

    def test_other_facts(self, house):
        assert house.gold["fact_quality_inspection"].read().where("defect_code IS NULL").count() == 0
        wo = {r["work_order_id"]: r for r in house.gold["fact_maintenance_event"].read().collect()}
        assert wo["WO-2"]["status"] == "COMPLETED" and wo["WO-2"]["response_minutes"] == 20 and wo["WO-2"]["repair_minutes"] == 220 and "WO-4" not in wo
        assert house.gold["fact_supplier_delivery"].read().where("accepted_qty <> delivered_qty - rejected_qty").count() == 0

    def test_rebuild_gives_the_same_rows(self, house):
        names = ("fact_production_daily", "fact_machine_daily")
        before = {n: sorted(map(str, house.gold[n].read().collect())) for n in names}
        assert house.builder().build() == []
        fresh = facts.production_daily(house.silver["mes_production_log"].read(), house.silver["mes_quality_inspection"].read(), *[house.gold[n].read() for n in ("dim_machine", "dim_product", "dim_plant")])
        assert {n: sorted(map(str, house.gold[n].read().collect())) for n in names} == before
        assert sorted(map(str, fresh.collect())) == before["fact_production_daily"]

    def test_publish(self, house, tmp_path):
        serving = {n: VersionedTable(house.spark, f"file://{tmp_path}/{n}", KEYED.get(n, ())) for n in gold.PUBLISHED}
        results = gold.publish_all(house.gold, serving, house.watermarks)
        assert all(r.passed for r in results) and {"dim_machine", "fact_machine_daily"} <= {r.entity for r in results}
        again = serving["fact_machine_daily"].latest()
        gold.publish_all(house.gold, serving, house.watermarks)
        assert serving["fact_machine_daily"].latest() == again

    def test_views(self, house):
        g = {n: house.gold[n].read() for n in ("fact_production_daily", "fact_machine_daily", "dim_plant", "dim_machine", "dim_product", "fact_maintenance_event", "fact_supplier_delivery", "dim_supplier", "fact_quality_inspection")}
        assert views.plant_oee_daily(g["fact_machine_daily"], g["dim_plant"]).count() == 6
        status = {r["machine_id"]: r["status"] for r in views.shop_floor_status(g["dim_machine"], g["fact_machine_daily"], g["fact_maintenance_event"], datagen.DAYS[1]).collect()}
        assert status["M-P01-01"] == "RED" and status["M-P01-02"] == "AMBER" and status["M-P03-05"] == "GREEN"
        assert views.scrap_cost_daily(g["fact_production_daily"], g["dim_product"]).where("scrap_cost > 0").count() > 0
        assert views.exec_monthly(g["fact_production_daily"], g["fact_machine_daily"], g["fact_supplier_delivery"]).count() == 1
        assert views.defect_pareto(g["fact_quality_inspection"], calendar.dim_defect_type(house.spark)).orderBy("rank").first()["cumulative_share"] > 0
        assert views.reject_rate_monthly(g["fact_supplier_delivery"], g["dim_supplier"]).where("reject_rate IS NULL").count() == 0
        assert views.mtbf_mttr_monthly(g["fact_production_daily"], g["fact_maintenance_event"]).where("breakdowns > 0").count() == 3
        priced = g["fact_production_daily"].join(g["dim_product"].select("product_sk", "unit_cost"), "product_sk").withColumn("_gold_updated_ts", F.lit(datetime(2024, 3, 3)))
        facts_by = {"production": priced, "machine": g["fact_machine_daily"], "maintenance": g["fact_maintenance_event"], "delivery": g["fact_supplier_delivery"]}
        for kind, fact in facts_by.items():
            names = [n for n, (k, _) in views.MEASURES.items() if k == kind]
            assert views.evaluate(fact, names).count() == 1
        assert len(views.MEASURES) + 5 == 32  # MTBF, MTD, PY, YoY and the rolling OEE are functions


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("iot")
    places = telemetry.Places(f"file://{root}")
    telemetry.send_events(spark.createDataFrame([("k", x) for x in datagen.telemetry()], "key string, value string").coalesce(1), f"file://{root}/in")
    with pytest.raises(ValueError):
        telemetry.send_events(spark.createDataFrame([("k", "v")], "key string, value string"))
    telemetry.land_events(telemetry.raw_events(spark, f"file://{root}/in"), places).awaitTermination()
    for q in telemetry.start_queries(spark, places):
        q.awaitTermination()
    late = json.loads(datagen.telemetry()[0]) | {"event_ts": "2024-03-01T07:00:00Z"}
    (root / "in/b.jsonl").write_text(json.dumps(late))
    telemetry.land_events(telemetry.raw_events(spark, f"file://{root}/in"), places).awaitTermination()
    for q in telemetry.start_queries(spark, places):
        q.awaitTermination()
    return places


class TestTelemetry:
    def test_quarantine_dedup_and_windows(self, spark, places):
        assert spark.read.parquet(places.data("quarantine")).count() == 3
        readings = spark.read.parquet(places.data("sensor_reading"))
        assert readings.where("sensor_type = 'temperature'").count() == 60  # the duplicate and the late one are gone
        minutes = spark.read.parquet(places.data("sensor_minute"))
        assert minutes.where("is_anomaly").select("sensor_type").distinct().collect()[0][0] == "temperature"
        assert minutes.where("is_anomaly").count() == 3 and minutes.where("sensor_type = 'humidity' AND is_anomaly").count() == 0
        assert minutes.agg(F.max("window_end")).first()[0] <= datetime(2024, 3, 1, 8, 20)
        assert spark.read.parquet(places.data("telemetry_raw")).count() == len(datagen.telemetry()) + 1  # late data stays in bronze

    def test_run_statistics_closed_at_both_ends(self, spark):
        runs = spark.createDataFrame([(1, "M", "P", datetime(2024, 3, 1, 8), datetime(2024, 3, 1, 9), False)], "production_log_id long, machine_id string, product_id string, start_ts timestamp, end_ts timestamp, _is_deleted boolean")
        rows = [("M", "t", float(v), datetime(2024, 3, 1, h, m, s)) for v, h, m, s in ((1, 7, 59, 59), (2, 8, 0, 0), (4, 9, 0, 0), (8, 9, 0, 1))]
        readings = spark.createDataFrame(rows, "machine_id string, sensor_type string, reading_value double, event_ts timestamp").withColumn("event_date", F.to_date("event_ts"))
        plain, salted = facts.process_run_sensor(runs, readings).collect(), facts.process_run_sensor(runs, readings, salts=8).collect()
        assert plain == salted and plain[0]["reading_count"] == 2 and float(plain[0]["avg_value"]) == 3.0
        one = facts.process_run_sensor(runs, readings.where("reading_value = 2")).first()
        assert one["stddev_value"] is None


class TestControl:
    C = control.Control("e", registry.WATERMARK, "2024-01-01")

    def test_a_retry_keeps_its_window(self):
        run = control.start_run(self.C, [], "2024-01-02", "2024-01-02")
        assert run.run_id == "e_20240102_01" and run.has_changes
        again = control.start_run(self.C, [control.fail_run(run, "net")], "2024-01-03", "2024-01-03")
        assert (again.run_id, again.window_end) == (run.run_id, run.window_end)

    def test_only_a_validated_run_moves_the_watermark(self):
        run = control.start_run(self.C, [], "2024-01-02", "2024-01-02")
        with pytest.raises(control.StateError):
            control.complete_run(run, self.C)
        bad = control.validate_counts(run, self.C, 10, 9, 9, 0)
        assert bad.status == control.RECON_FAILED and control.fail_run(bad, "x").status == control.RECON_FAILED
        assert control.validate_counts(run, self.C, 10, 10, 9, 1).status == control.RECON_FAILED
        assert control.validate_counts(run, replace(self.C, max_reject_pct=10), -1, 10, 9, 1).status == control.VALIDATED
        done, moved = control.complete_run(control.validate_counts(run, self.C, 3, 3, 3, 0), self.C)
        assert moved.watermark == "2024-01-02" and control.complete_run(done, moved) == (done, moved) and control.fail_run(done, "x").status == control.SUCCESS
        assert control.start_run(moved, [done], "2024-01-02", "2024-01-02").number == 2

    def test_reset(self):
        run = control.start_run(self.C, [], "2024-01-02", "2024-01-02")
        with pytest.raises(ValueError):
            control.reset_watermark(self.C, [run], "2023-01-01", "short")
        moved, runs = control.reset_watermark(self.C, [run], "2023-01-01", "reload after a fix")
        assert moved.watermark == "2023-01-01" and runs[0].status == control.ABANDONED

    def test_isolation_and_routes(self):
        def work(name):
            if name == "b":
                raise RuntimeError("no")

        out = control.run_isolated("abc", work)
        assert out["a"] is None and out["c"] is None and isinstance(out["b"], RuntimeError)
        assert {control.route(e.pattern) for e in registry.ENTITIES.values()} <= set(control.ROUTES.values())
        with pytest.raises(ValueError):
            control.route("FTP")

    def test_alert_never_raises(self):
        def broken(_):
            raise OSError("mail is down")

        control.alert("trouble", broken)


class TestSources:
    def test_versions_retention_and_changes(self, spark, tmp_path):
        t = VersionedTable(spark, f"file://{tmp_path}/t", ("k",))
        with pytest.raises(LookupError):
            t.read()
        make = lambda rows: spark.createDataFrame(rows, "k long, _row_hash string")
        t.commit(make([(1, "a")]), "CREATE", record_changes=True)
        t.commit(make([(1, "b"), (2, "c")]), "MERGE", record_changes=True)
        assert t.read(0).count() == 1 and t.read().count() == 2 and t.changes(None) is None and t.changes(1).count() == 0
        assert sorted(r["_change_type"] for r in t.changes(0).collect()) == ["insert", "update_postimage", "update_preimage"]
        with pytest.raises(ValueError):
            t.vacuum(retain_hours=1)
        assert t.vacuum(now=t.info(0)["committed_at"] + 3600 * 24 * 30) == [0] and t.versions() == [1]
        with pytest.raises(RetentionError):
            t.changes(-1)
        Path(tmp_path / "t/data/unfinished").mkdir()
        assert t.latest() == 1
        t.optimise(("k",))
        assert t.latest() == 2 and t.read().count() == 2
        with pytest.raises(FileExistsError):
            t.store.create(f"{t.root}/_commits/2.json", "{}")

    def test_lsn_gap(self, spark):
        log = spark.createDataFrame([(datagen.lsn(i),) for i in range(5, 9)], "cdc_start_lsn string")
        assert extract.lsn_window(log, datagen.lsn(5), datagen.lsn(7)).count() == 2
        with pytest.raises(extract.LsnGapError):
            extract.lsn_window(log, datagen.lsn(2), datagen.lsn(7))

    def test_paged_source_stops_at_the_empty_page(self, spark):
        pages = datagen.api_pages(datagen.Extracts()[datagen.DAYS[0]]["cmms_work_order"])
        empty = json.dumps({"data": []})
        source = extract.paged_source("work_orders", "work_order_id string, machine_id string", lambda n: pages[n - 1] if n <= len(pages) else empty, most=20, stride=2)
        spark.dataSource.register(source)
        assert sorted(r["work_order_id"] for r in spark.read.format("work_orders").load().collect()) == ["WO-1", "WO-2", "WO-3", "WO-4"]

    def test_paged_files(self, spark, tmp_path):
        for n, p in enumerate(datagen.api_pages(datagen.Extracts()[datagen.DAYS[0]]["cmms_work_order"])):
            (tmp_path / f"{n}.json").write_text(p)
        assert extract.explode_pages(spark, f"file://{tmp_path}", "work_order_id: string, machine_id: string").count() == 4

    def test_csv_drop_with_rejects(self, spark, tmp_path):
        (tmp_path / "a.csv").write_text("delivery_id,supplier_id\nD1,S1\nD2\nD3,S3,x\n")
        good, bad = landing.split_rejects(landing.read_csv_drop(spark, [f"file://{tmp_path}"], ["delivery_id", "supplier_id"]))
        assert [r["delivery_id"] for r in good.collect()] == ["D1"] and sorted(r["rejected_line"] for r in bad.collect()) == ["D2", "D3,S3,x"]

    def test_publish_replaces_its_own_run(self, spark, tmp_path):
        root = f"file://{tmp_path}"
        for n in (3, 5):
            landing.publish(spark.range(n), root, landing.raw_path(root, registry.ENTITIES["erp_plant"], "2024-01-01", "e_1"))
        assert spark.read.parquet(landing.raw_path(root, registry.ENTITIES["erp_plant"], "2024-01-01", "e_1")).count() == 5

    def test_option_builders_and_sizing(self):
        assert extract.kafka_options("h:9093", "t", sasl_jaas="x")["kafka.security.protocol"] == "SASL_SSL" and extract.kafka_options("h", "t")["failOnDataLoss"] == "false"
        assert extract.jdbc_options("jdbc:x", "SELECT 1", partition_column="id", bounds=(0, 9))["numPartitions"] == "8"
        assert [files_for(n) for n in (0, 1, 128 << 20, (128 << 20) + 1, 1 << 40)] == [1, 1, 1, 2, 8192]

    def test_maintenance_isolates_failures(self, spark, tmp_path):
        good = VersionedTable(spark, f"file://{tmp_path}/good", ("id",))
        good.commit(spark.range(10), "CREATE")
        out = control.maintain({"good": ("silver", good), "bad": ("silver", VersionedTable(spark, f"file://{tmp_path}/bad"))})
        assert out["good"] is None and isinstance(out["bad"], LookupError) and good.read().count() == 10

    def test_generator_is_deterministic(self):
        assert datagen.Extracts().days == datagen.Extracts().days and datagen.lsn(9) < datagen.lsn(10)


def test_filters_and_columns_reach_the_scan(spark, sf):
    """The facts read the columns they need, filtered where they are read, without all-pairs joins or Python."""
    plan = catalog.queries()["fact_supplier"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    orders = [line for line in plan.splitlines() if "FileScan" in line and "o_orderkey" in line]
    assert orders and all("o_totalprice" not in line for line in orders)
    assert any("PushedFilters: [" in line and "o_orderstatus" in line.split("PushedFilters")[1] for line in orders) or "NOT (o_orderstatus" in plan
    days = catalog.queries()["fact_effectiveness"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in days and "BroadcastNestedLoopJoin" not in days and "PythonUDF" not in days
    lines = [line for line in days.splitlines() if "FileScan" in line and "l_suppkey" in line]
    assert lines and any("l_extendedprice" not in line for line in lines)  # only inspections need a run's number, a hash of its whole line
