"""Deterministic two-day source extracts with planted dirt, for tests and demonstrations.

``extracts(day)`` gives rows as text, as sources land them. RUN_CASES and INSPECTION_CASES say
what is planted in these two sources, by the operator that has to cope with it; the small
sources have a renamed plant, a machine that moves line, a new machine, a changed cycle time and
cost, a closed order, a re-sent supplier line, rejects above deliveries, and values that
cannot be cast.
"""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import SparkSession

from quernflow import registry
from quernflow.sources import landing

SEED = 20250117
DAYS = ("2024-03-01", "2024-03-02")
PLANTS = ("P01", "P02", "P03")
MACHINES = tuple(f"M-{p}-{i:02d}" for p in PLANTS for i in range(1, 5))
PRODUCTS = tuple(f"PRD-{1001 + i}" for i in range(8))
SHIFT_START = {"A": 6, "B": 14, "C": 22}

#: What is planted in the first day's runs, by their number of the day.
RUN_CASES = {
    14: {"product_id": " prd-1007  "},  # string steps: padded and lower-case code
    27: {"shift_code": "c "},  # string steps, then the domain
    30: {"shift_code": "N"},  # a warning only: outside the domain
    31: {"shift_code": None},  # NULL default
    33: {"end_ts": None},  # a run that is still going on
    17: {"end_ts": "2024-03-01 00:00:00"},  # an error: ends before it starts; repaired on day two
    22: {"units_produced": "many"},  # an error: cannot be cast
}
#: Runs of the first day that are landed twice, changed in the same batch (the later sequence counts),
#: and on day two deleted, deleted and inserted again, and changed by a message that comes too late.
LANDED_TWICE, CHANGED_AT_ONCE, DELETED, BROUGHT_BACK, LATE = 8, 3, 11, 6, 3

#: The same for inspections, by the number of the inspected run.
INSPECTION_CASES = {
    2: {"inspection_result": " pass ", "defect_count": "0", "defect_code": ""},  # string steps and empty text
    19: {"defect_count": None, "defect_code": None, "inspection_result": "PASS"},  # NULL defaults
    25: {"sample_size": "0", "defect_count": "0"},  # an error
}
#: On day two: inspected again with another result (its run's day is to be built anew), deleted, and
#: one of a run that never was.
INSPECTED_AGAIN, INSPECTION_DELETED, NO_SUCH_RUN = 5, 12, 999_999

Row = dict[str, str | None]


def lsn(number: int) -> str:
    """Fixed width, so that text order is number order."""
    return f"0x{number:020X}"


def _text(**values) -> Row:
    return {k: None if v is None else str(v) for k, v in values.items()}


class Extracts:
    """One run of the generator; LSNs rise over both days."""

    def __init__(self, seed: int = SEED) -> None:
        self.draw = random.Random(seed)
        self.lsn = 0
        self.runs: dict[int, Row] = {}
        self.days: dict[str, dict[str, list[Row]]] = {}
        for number, day in enumerate(DAYS, 1):
            self.days[day] = self._day(number, day)

    def __getitem__(self, day: str) -> dict[str, list[Row]]:
        return self.days[day]

    def _change(self, operation: int, at: str, row: Row) -> Row:
        self.lsn += 1
        return _text(cdc_start_lsn=lsn(self.lsn), cdc_seqval=lsn(1), cdc_operation=operation, cdc_update_mask="0xFF", cdc_commit_ts=at) | row

    def _day(self, number: int, day: str) -> dict[str, list[Row]]:
        return {
            "mes_machine": self._machines(number, day), "mes_production_log": self._production(number, day), "mes_quality_inspection": self._inspections(number, day), "erp_product": self._products(number, day),
            "erp_plant": self._plants(number, day), "erp_production_order": self._orders(number, day), "cmms_work_order": self._work_orders(number, day), "supplier_delivery": self._deliveries(number, day),
        }

    def _machine(self, key: str, at: str, **other) -> Row:
        base = dict(machine_id=key, machine_name=f"Machine {key}", plant_id=key[2:5], line_id="L1", machine_type="PRESS" if key.endswith("1") else "LATHE", manufacturer="Acme", install_date="2020-01-15", status="ACTIVE", rated_units_per_hour=120, modified_at=at)
        return _text(**(base | other))

    def _machines(self, number: int, day: str) -> list[Row]:
        at = f"{day} 02:00:00"
        if number == 1:
            return [self._change(2, at, self._machine(m, at)) for m in MACHINES]
        return [
            self._change(4, at, self._machine("M-P01-03", at, line_id="L2")), self._change(4, at, self._machine("M-P02-01", at, status="MAINTENANCE")), self._change(2, at, self._machine("M-P03-05", at)),
        ]

    def _run(self, key: int, i: int, day: str) -> Row:
        machine, shift = MACHINES[i % len(MACHINES)], "ABC"[i // len(MACHINES)]
        start = datetime.fromisoformat(day) + timedelta(hours=SHIFT_START[shift], minutes=self.draw.randrange(20))
        return _text(
            production_log_id=key, order_id=f"ORD-{key}", machine_id=machine, product_id=PRODUCTS[i % len(PRODUCTS)], shift_code=shift, start_ts=start, end_ts=start + timedelta(minutes=self.draw.randrange(300, 460)),
            units_produced=self.draw.randrange(280, 420), units_scrapped=self.draw.randrange(15), operator_id=f"OP{i % 9}", modified_at=start + timedelta(hours=8),
        )

    def _production(self, number: int, day: str) -> list[Row]:
        first, at = 100_000 + 1000 * (number - 1), f"{day} 23:30:00"
        good = [self._run(first + i, i, day) for i in range(36)]
        self.runs |= {first + i: row for i, row in enumerate(good)}
        if number == 1:
            out = [self._change(2, at, row | RUN_CASES.get(i, {})) for i, row in enumerate(good)]
            changed = self._change(4, at, good[CHANGED_AT_ONCE] | {"units_produced": "333", "units_scrapped": "7"})
            return [*out, changed, dict(out[LANDED_TWICE])]
        old = lambda i: self.runs[100_000 + i]
        late = self._change(4, at, old(LATE) | {"units_produced": "1"}) | {"cdc_start_lsn": lsn(0)}
        changes = [self._change(4, at, old(17)), self._change(1, at, old(DELETED)), self._change(1, at, old(BROUGHT_BACK)), self._change(2, at, old(BROUGHT_BACK) | {"operator_id": "OP99"})]
        return [late, *changes, *(self._change(2, at, row) for row in good)]

    def _inspection(self, key: int, run: Row, i: int) -> Row:
        defects = self.draw.choice([0, 0, 0, 1, 3])
        return _text(
            inspection_id=key, production_log_id=run["production_log_id"], machine_id=run["machine_id"], product_id=run["product_id"], inspection_ts=run["end_ts"], sample_size=20, defect_count=defects,
            defect_code="SCRATCH" if defects else None, inspection_result="FAIL" if defects > 2 else "PASS", inspector_id=f"Q{i % 4}", modified_at=run["end_ts"],
        )

    def _inspections(self, number: int, day: str) -> list[Row]:
        first, at, runs = 500_000 + 1000 * (number - 1), f"{day} 23:40:00", 100_000 + 1000 * (number - 1)
        rows = [self._inspection(first + i, self.runs[runs + i], i) for i in range(36)]
        if number == 1:
            self.inspected = rows
            return [self._change(2, at, row | INSPECTION_CASES.get(i, {})) for i, row in enumerate(rows)]
        again = self.inspected[INSPECTED_AGAIN] | {"defect_count": "4", "inspection_result": "FAIL", "defect_code": "BURR"}
        nowhere = self._inspection(first + 99, self.runs[runs] | {"production_log_id": str(NO_SUCH_RUN)}, 0)
        changes = [(4, again), (1, self.inspected[INSPECTION_DELETED]), (2, nowhere)]
        return [self._change(operation, at, row) for operation, row in [*changes, *((2, row) for row in rows)]]

    def _products(self, number: int, day: str) -> list[Row]:
        at = f"{day} 03:00:00"
        make = lambda i, **other: _text(**(dict(PRODUCT_ID=PRODUCTS[i], SKU=f"SKU{i}", PRODUCT_NAME=f"Product {i}", PRODUCT_FAMILY="VALVES" if i % 2 else None, UNIT_COST=f"{10 + i}.50", STD_CYCLE_TIME_SEC=60, LAST_UPDATE_DATE=at) | other))
        if number == 1:
            return [make(i, **({"PRODUCT_NAME": " "} if i == 3 else {})) for i in range(len(PRODUCTS))]
        return [make(3), make(5, STD_CYCLE_TIME_SEC=52), make(6, UNIT_COST="19.75"), make(7, UNIT_COST="cheap")]

    def _plants(self, number: int, day: str) -> list[Row]:
        names = ("North", "South", "East" if number == 1 else "East Works")
        return [_text(PLANT_ID=p, PLANT_NAME=n, CITY="graz", COUNTRY_CODE="at", TIMEZONE="Europe/Vienna", LAST_UPDATE_DATE=f"{day} 00:10:00") for p, n in zip(PLANTS, names, strict=True)]

    def _orders(self, number: int, day: str) -> list[Row]:
        make = lambda i, status: _text(ORDER_ID=f"ORD-{i}", PRODUCT_ID=PRODUCTS[i % 8], PLANT_ID=PLANTS[i % 3], PLANNED_QTY=300, PLANNED_START=f"{day} 00:00:00", PLANNED_END=f"{day} 23:00:00", ORDER_STATUS=status, LAST_UPDATE_DATE=f"{day} 00:20:00")
        old = [make(100_000 + i, "OPEN" if number == 1 else "CLOSED") for i in range(24)]
        return old if number == 1 else [*old, *(make(101_000 + i, "OPEN") for i in range(24))]

    def _work_orders(self, number: int, day: str) -> list[Row]:
        at = datetime.fromisoformat(day)
        make = lambda key, machine, kind, status, minutes, done=True, day=at: _text(
            work_order_id=key, machine_id=machine, work_type=kind, priority=None, status=status, reported_at=day + timedelta(hours=7), started_at=day + timedelta(hours=7, minutes=20) if done else None,
            completed_at=day + timedelta(hours=7, minutes=20 + minutes) if done else None, downtime_minutes=minutes if done else None, technician="T1", updated_at=at + timedelta(hours=9),
        )
        if number == 1:
            return [make("WO-1", "M-P01-01", "BREAKDOWN", "COMPLETED", 90), make("WO-2", "M-P02-02", "BREAKDOWN", "OPEN", 0, False), make("WO-3", "M-P03-03", "PREVENTIVE", "COMPLETED", 45), make("WO-4", "M-P03-04", "PAINTING", "COMPLETED", 5)]
        return [make("WO-2", "M-P02-02", "BREAKDOWN", "COMPLETED", 200, day=datetime.fromisoformat(DAYS[0])), make("WO-5", "M-P01-02", "BREAKDOWN", "COMPLETED", 1500), make("WO-6", "M-P01-01", "CORRECTIVE", "OPEN", 0, False)]

    def _deliveries(self, number: int, day: str) -> list[Row]:
        make = lambda i, **other: _text(**(dict(delivery_id=f"DLV-{number}{i}", supplier_id=f"s{i % 2 + 1}", supplier_name=f"  supplier {'one' if i % 2 == 0 else 'two'}", material_code=f"MAT{i}", plant_id=PLANTS[i % 3], delivery_date=day, delivered_qty=100 + i, rejected_qty=i, lot_number=f"LOT{i}") | other))
        return [make(0), make(1), make(2, rejected_qty=None), make(3, rejected_qty=500), make(4), make(4, delivered_qty=140)]


def api_pages(rows: list[Row], size: int = 2) -> list[str]:
    """JSON pages; the last one has no data."""
    chunks = [rows[i : i + size] for i in range(0, len(rows), size)] + [[]]
    return [json.dumps({"meta": {"page": n, "page_size": size, "total_count": len(rows)}, "data": c}) for n, c in enumerate(chunks, 1)]


def telemetry(day: str = DAYS[0], minutes: int = 30, seed: int = SEED) -> list[str]:
    """JSON lines of one machine: an alarm episode, an exact duplicate, a broken body, an
    uncastable time, and at the end an event that comes too late."""
    draw, out = random.Random(seed), []
    at = datetime.fromisoformat(day) + timedelta(hours=8)
    body = lambda t, kind, value, **other: json.dumps({"device_id": f"d-{kind}", "machine_id": " m-p01-01", "sensor_type": kind.upper(), "reading_value": value, "unit": "u", "event_ts": t.strftime("%Y-%m-%dT%H:%M:%S.%fZ") if isinstance(t, datetime) else t, "firmware": "1.0"} | other)
    for m in range(minutes):
        for s in (0, 30):
            t = at + timedelta(minutes=m, seconds=s)
            hot = 99.5 if 10 <= m < 13 else round(60 + draw.random() * 5, 2)
            out += [body(t, "temperature", hot), body(t, "vibration", round(2 + draw.random(), 3)), body(t, "humidity", 9999.0)]
    return [*out, out[0], '{"device_id": "d-temperature", "broken', body("soon", "temperature", 50.0), body(at, "pressure", None)]


def land(spark: SparkSession, root: str, extracts: Extracts, day: str, overstate: dict[str, int] | None = None) -> None:
    """Write a day's extracts and manifests in the landing layout; all values are text."""
    for name, rows in extracts[day].items():
        entity = registry.ENTITIES[name]
        schema = landing.raw_schema(entity)
        run_id = landing.run_id_of(name, day, 1)
        frame = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
        landing.publish(frame.coalesce(1), root, landing.raw_path(root, entity, day, run_id))
        n = len(rows) + (overstate or {}).get(name, 0)
        landing.write_manifest(spark, root, {
            "run_id": run_id, "entity_name": name, "source_system": entity.system, "load_pattern": entity.pattern, "status": "SUCCESS", "pipeline_run_id": "local", "source_count": n, "rows_read": n, "rows_copied": n, "rows_skipped": 0,
            "load_date": day, "window_start": "", "window_end": day,
        })
