"""The entity registry: how each source table is read, typed, keyed, checked and sequenced."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quernflow.functions.columns import STRING_STEPS

CDC, WATERMARK, FULL, API, FILE = "SQLSERVER_CDC", "ORACLE_WATERMARK", "ORACLE_FULL", "REST_API", "ADLS_FILE"
LOAD_PATTERNS = frozenset({CDC, WATERMARK, FULL, API, FILE})
SEVERITIES = frozenset({"ERROR", "WARN"})
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Columns with these prefixes pass through cleansing untouched.
TECHNICAL_PREFIXES = ("cdc_", "_")


def identifier(name: str) -> str:
    """The name itself, if it is a plain identifier (also dotted, up to three parts)."""
    parts = name.split(".")
    if len(parts) > 3 or not all(IDENTIFIER.fullmatch(p) for p in parts):
        raise ValueError(f"not an identifier: {name!r}")
    return name


@dataclass(frozen=True)
class Attribute:
    source: str
    name: str
    kind: str = "string"
    steps: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    name: str
    check: str
    severity: str = "ERROR"


@dataclass(frozen=True)
class Entity:
    name: str
    system: str
    pattern: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    attributes: tuple[Attribute, ...]
    defaults: dict[str, object] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    deleted_when: str | None = None
    folder: str = ""

    def __post_init__(self) -> None:
        names = {a.name for a in self.attributes}
        technical = lambda c: c.startswith(TECHNICAL_PREFIXES)
        problems = [
            *([f"load pattern {self.pattern}"] if self.pattern not in LOAD_PATTERNS else []),
            *([] if self.keys else ["no key"]),
            *(f"key {k}" for k in self.keys if k not in names),
            *(f"sequence {c}" for c in self.order if c not in names and not technical(c)),
            *(["a CDC entity needs a delete condition"] if self.pattern == CDC and not self.deleted_when else []),
            *(f"step {s}" for a in self.attributes for s in a.steps if s not in STRING_STEPS),
            *(f"severity {r.severity}" for r in self.rules if r.severity not in SEVERITIES),
            *(f"default of {c}" for c in self.defaults if c not in names),
        ]
        identifier(self.name)
        if problems:
            raise ValueError(f"{self.name}: " + "; ".join(problems))

    def kind_of(self, column: str) -> str:
        return next((a.kind for a in self.attributes if a.name == column), "string")


# String steps of codes and of names, and the sequence columns of change data.
CODE, NAME = ("trim", "upper"), ("trim", "initcap")
CDC_ORDER = ("cdc_start_lsn", "cdc_seqval")

# The source tables' columns, defaults, domains and rules. Two are our own: the rule
# start_not_null, and the file name that settles ties between deliveries.
_TABLES = (
    Entity(
        name="mes_machine",
        system="SQLSERVER_MES",
        pattern=CDC,
        keys=("machine_id",),
        order=CDC_ORDER,
        attributes=(
            Attribute("machine_id", "machine_id", "string", CODE),
            Attribute("machine_name", "machine_name", "string", ("trim", "empty_to_null")),
            Attribute("plant_id", "plant_id", "string", CODE),
            Attribute("line_id", "line_id", "string", CODE),
            Attribute("machine_type", "machine_type", "string", CODE),
            Attribute("manufacturer", "manufacturer", "string", NAME),
            Attribute("install_date", "install_date", "date"),
            Attribute("status", "status", "string", CODE),
            Attribute("rated_units_per_hour", "rated_units_per_hour", "int"),
            Attribute("modified_at", "source_modified_at", "timestamp"),
        ),
        defaults={"machine_type": "UNKNOWN", "status": "UNKNOWN"},
        rules=(
            Rule("machine_id_not_null", "machine_id IS NOT NULL"),
            Rule("plant_id_not_null", "plant_id IS NOT NULL"),
            Rule("rated_capacity_positive", "rated_units_per_hour IS NULL OR rated_units_per_hour > 0"),
            Rule("status_in_domain", "status IN ('ACTIVE', 'IDLE', 'MAINTENANCE', 'RETIRED', 'UNKNOWN')", "WARN"),
        ),
        deleted_when="cdc_operation = 1",
        folder="sqlserver_mes/machine",
    ),
    Entity(
        name="mes_production_log",
        system="SQLSERVER_MES",
        pattern=CDC,
        keys=("production_log_id",),
        order=CDC_ORDER,
        attributes=(
            Attribute("production_log_id", "production_log_id", "bigint"),
            Attribute("order_id", "order_id", "string", CODE),
            Attribute("machine_id", "machine_id", "string", CODE),
            Attribute("product_id", "product_id", "string", CODE),
            Attribute("shift_code", "shift_code", "string", CODE),
            Attribute("start_ts", "start_ts", "timestamp"),
            Attribute("end_ts", "end_ts", "timestamp"),
            Attribute("units_produced", "units_produced", "int"),
            Attribute("units_scrapped", "units_scrapped", "int"),
            Attribute("operator_id", "operator_id", "string", CODE),
            Attribute("modified_at", "source_modified_at", "timestamp"),
        ),
        defaults={"units_scrapped": 0, "shift_code": "UNKNOWN"},
        rules=(
            Rule("key_not_null", "production_log_id IS NOT NULL"),
            Rule("machine_not_null", "machine_id IS NOT NULL AND product_id IS NOT NULL"),
            Rule("non_negative_units", "units_produced >= 0 AND units_scrapped >= 0"),
            Rule("scrap_not_above_produced", "units_scrapped <= units_produced"),
            Rule("end_after_start", "end_ts IS NULL OR end_ts >= start_ts"),
            Rule("start_not_null", "start_ts IS NOT NULL"),
            Rule("shift_in_domain", "shift_code IN ('A', 'B', 'C', 'UNKNOWN')", "WARN"),
        ),
        deleted_when="cdc_operation = 1",
        folder="sqlserver_mes/production_log",
    ),
    Entity(
        name="mes_quality_inspection",
        system="SQLSERVER_MES",
        pattern=CDC,
        keys=("inspection_id",),
        order=CDC_ORDER,
        attributes=(
            Attribute("inspection_id", "inspection_id", "bigint"),
            Attribute("production_log_id", "production_log_id", "bigint"),
            Attribute("machine_id", "machine_id", "string", CODE),
            Attribute("product_id", "product_id", "string", CODE),
            Attribute("inspection_ts", "inspection_ts", "timestamp"),
            Attribute("sample_size", "sample_size", "int"),
            Attribute("defect_count", "defect_count", "int"),
            Attribute("defect_code", "defect_code", "string", (*CODE, "empty_to_null")),
            Attribute("inspection_result", "inspection_result", "string", CODE),
            Attribute("inspector_id", "inspector_id", "string", CODE),
            Attribute("modified_at", "source_modified_at", "timestamp"),
        ),
        defaults={"defect_code": "NONE", "defect_count": 0},
        rules=(
            Rule("key_not_null", "inspection_id IS NOT NULL"),
            Rule("sample_positive", "sample_size > 0"),
            Rule("defects_within_sample", "defect_count BETWEEN 0 AND sample_size"),
            Rule("result_in_domain", "inspection_result IN ('PASS', 'FAIL')"),
        ),
        deleted_when="cdc_operation = 1",
        folder="sqlserver_mes/quality_inspection",
    ),
    Entity(
        name="erp_product",
        system="ORACLE_ERP",
        pattern=WATERMARK,
        keys=("product_id",),
        order=("last_update_date",),
        attributes=(
            Attribute("PRODUCT_ID", "product_id", "string", CODE),
            Attribute("SKU", "sku", "string", CODE),
            Attribute("PRODUCT_NAME", "product_name", "string", ("trim", "empty_to_null")),
            Attribute("PRODUCT_FAMILY", "product_family", "string", CODE),
            Attribute("UNIT_COST", "unit_cost", "decimal(12,2)"),
            Attribute("STD_CYCLE_TIME_SEC", "std_cycle_time_sec", "int"),
            Attribute("LAST_UPDATE_DATE", "last_update_date", "timestamp"),
        ),
        defaults={"product_family": "UNCLASSIFIED"},
        rules=(
            Rule("product_id_not_null", "product_id IS NOT NULL"),
            Rule("cycle_time_positive", "std_cycle_time_sec > 0"),
            Rule("cost_non_negative", "unit_cost IS NULL OR unit_cost >= 0"),
            Rule("name_present", "product_name IS NOT NULL", "WARN"),
        ),
        folder="oracle_erp/product",
    ),
    Entity(
        name="erp_plant",
        system="ORACLE_ERP",
        pattern=FULL,
        keys=("plant_id",),
        order=("last_update_date",),
        attributes=(
            Attribute("PLANT_ID", "plant_id", "string", CODE),
            Attribute("PLANT_NAME", "plant_name", "string", ("trim",)),
            Attribute("CITY", "city", "string", NAME),
            Attribute("COUNTRY_CODE", "country_code", "string", CODE),
            Attribute("TIMEZONE", "timezone", "string", ("trim",)),
            Attribute("LAST_UPDATE_DATE", "last_update_date", "timestamp"),
        ),
        rules=(
            Rule("plant_id_not_null", "plant_id IS NOT NULL"),
            Rule("country_iso2", "length(country_code) = 2", "WARN"),
        ),
        folder="oracle_erp/plant",
    ),
    Entity(
        name="erp_production_order",
        system="ORACLE_ERP",
        pattern=WATERMARK,
        keys=("order_id",),
        order=("last_update_date",),
        attributes=(
            Attribute("ORDER_ID", "order_id", "string", CODE),
            Attribute("PRODUCT_ID", "product_id", "string", CODE),
            Attribute("PLANT_ID", "plant_id", "string", CODE),
            Attribute("PLANNED_QTY", "planned_qty", "int"),
            Attribute("PLANNED_START", "planned_start", "timestamp"),
            Attribute("PLANNED_END", "planned_end", "timestamp"),
            Attribute("ORDER_STATUS", "order_status", "string", CODE),
            Attribute("LAST_UPDATE_DATE", "last_update_date", "timestamp"),
        ),
        defaults={"order_status": "UNKNOWN"},
        rules=(
            Rule("order_id_not_null", "order_id IS NOT NULL"),
            Rule("planned_qty_positive", "planned_qty > 0"),
            Rule("planned_window_valid", "planned_end >= planned_start", "WARN"),
        ),
        folder="oracle_erp/production_order",
    ),
    Entity(
        name="cmms_work_order",
        system="CMMS_API",
        pattern=API,
        keys=("work_order_id",),
        order=("updated_at",),
        attributes=(
            Attribute("work_order_id", "work_order_id", "string", CODE),
            Attribute("machine_id", "machine_id", "string", CODE),
            Attribute("work_type", "work_type", "string", CODE),
            Attribute("priority", "priority", "string", CODE),
            Attribute("status", "status", "string", CODE),
            Attribute("reported_at", "reported_at", "timestamp"),
            Attribute("started_at", "started_at", "timestamp"),
            Attribute("completed_at", "completed_at", "timestamp"),
            Attribute("downtime_minutes", "downtime_minutes", "int"),
            Attribute("technician", "technician", "string", NAME),
            Attribute("updated_at", "updated_at", "timestamp"),
        ),
        defaults={"downtime_minutes": 0, "priority": "P3"},
        rules=(
            Rule("wo_id_not_null", "work_order_id IS NOT NULL AND machine_id IS NOT NULL"),
            Rule("downtime_non_negative", "downtime_minutes >= 0"),
            Rule("type_in_domain", "work_type IN ('PREVENTIVE', 'CORRECTIVE', 'BREAKDOWN')"),
            Rule("completed_after_reported", "completed_at IS NULL OR completed_at >= reported_at", "WARN"),
        ),
        folder="cmms_api/work_order",
    ),
    Entity(
        name="supplier_delivery",
        system="SUPPLIER_FILES",
        pattern=FILE,
        keys=("delivery_id",),
        order=("_ingest_ts", "_source_file"),
        attributes=(
            Attribute("delivery_id", "delivery_id", "string", CODE),
            Attribute("supplier_id", "supplier_id", "string", CODE),
            Attribute("supplier_name", "supplier_name", "string", NAME),
            Attribute("material_code", "material_code", "string", CODE),
            Attribute("plant_id", "plant_id", "string", CODE),
            Attribute("delivery_date", "delivery_date", "date"),
            Attribute("delivered_qty", "delivered_qty", "int"),
            Attribute("rejected_qty", "rejected_qty", "int"),
            Attribute("lot_number", "lot_number", "string", CODE),
        ),
        defaults={"rejected_qty": 0},
        rules=(
            Rule("delivery_id_not_null", "delivery_id IS NOT NULL"),
            Rule("qty_valid", "delivered_qty > 0 AND rejected_qty BETWEEN 0 AND delivered_qty"),
            Rule("date_not_future", "delivery_date <= {as_of}", "WARN"),
        ),
        folder="supplier_files/delivery",
    ),
)

ENTITIES = {e.name: e for e in _TABLES}

# Sensor alarm limits (low, high). An unknown sensor is never in alarm.
ALARM_LIMITS = {"temperature": (0.0, 95.0), "vibration": (0.0, 9.0), "pressure": (20.0, 160.0), "spindle_speed": (0.0, 11000.0)}
