"""Serving views and BI measures. Ratios are always re-derived from summed components."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernflow.functions.columns import at_most_one, ratio
from quernflow.operators.asof import is_small

OEE_TARGET = 0.85


def day(df: DataFrame) -> DataFrame:
    return df if "production_date" in df.columns else df.withColumn("production_date", F.to_date(F.col("date_key").cast("string"), "yyyyMMdd"))


def plant_oee_daily(machine_days: DataFrame, plants: DataFrame) -> DataFrame:
    sums = machine_days.join(plants.select("plant_sk", "plant_id", "plant_name"), "plant_sk").groupBy("production_date", "plant_id", "plant_name").agg(
        F.count_distinct("machine_id").alias("machines"), *[F.sum(c).alias(c) for c in ("units_produced", "units_good", "ideal_units", "planned_minutes", "available_minutes", "downtime_minutes", "breakdowns")]
    )
    return with_oee(sums)


def with_oee(sums: DataFrame) -> DataFrame:
    a, p, q = ratio(F.col("available_minutes"), F.col("planned_minutes")), at_most_one(ratio(F.col("units_produced"), F.col("ideal_units"))), ratio(F.col("units_good"), F.col("units_produced"))
    return sums.select("*", a.alias("availability"), p.alias("performance"), q.alias("quality"), (a * p * q).alias("oee"))


def shop_floor_status(machines: DataFrame, machine_days: DataFrame, work_orders: DataFrame, as_of: str, explicit_unknown: bool = False) -> DataFrame:
    """RED with open work orders, AMBER with over 30 anomaly minutes or OEE under 0.60, else GREEN."""
    today = machine_days.where(F.col("production_date") == F.lit(as_of).cast("date")).select("machine_id", "oee", "anomaly_minutes")
    open_ = work_orders.where("status <> 'COMPLETED'").groupBy("machine_id").agg(F.count(F.lit(1)).alias("open_work_orders"))
    rows = machines.where("is_current").select("machine_id", "machine_name", "plant_id").join(today, "machine_id", "left").join(open_, "machine_id", "left")
    rows = rows.withColumn("open_work_orders", F.coalesce("open_work_orders", F.lit(0)))
    status = F.when(F.col("open_work_orders") > 0, "RED").when((F.col("anomaly_minutes") > 30) | (F.col("oee") < 0.60), "AMBER")
    if explicit_unknown:
        status = status.when(F.col("oee").isNull(), "UNKNOWN")
    return rows.withColumn("status", status.otherwise("GREEN"))


def scrap_cost_daily(production: DataFrame, products: DataFrame) -> DataFrame:
    """Scrap at the unit cost of the product version that the fact points to."""
    rows = production.join(products.select("product_sk", "unit_cost", "product_family"), "product_sk")
    return rows.groupBy("production_date", "product_family").agg(F.sum("units_scrapped").alias("units_scrapped"), F.sum(F.col("units_scrapped") * F.col("unit_cost")).alias("scrap_cost"))


def exec_monthly(production: DataFrame, machine_days: DataFrame, deliveries: DataFrame) -> DataFrame:
    month = lambda df: F.to_date(F.date_trunc("month", F.col("production_date"))).alias("month")
    made = production.groupBy(month(production)).agg(*[F.sum(c).alias(c) for c in ("units_produced", "units_good", "units_scrapped", "sampled_units", "defect_units")])
    time = machine_days.groupBy(month(machine_days)).agg(F.sum("planned_minutes").alias("planned_minutes"), F.sum("downtime_minutes").alias("downtime_minutes"))
    bought = day(deliveries).groupBy(month(deliveries)).agg(F.sum("delivered_qty").alias("delivered_qty"), F.sum("rejected_qty").alias("rejected_qty"))
    rows = made.join(time, "month", "left").join(bought, "month", "left")
    return rows.select(
        "month", "units_produced", "units_good", "units_scrapped", ratio(F.col("units_scrapped"), F.col("units_produced")).alias("scrap_rate"), (1 - ratio(F.col("defect_units"), F.col("sampled_units"))).alias("first_pass_yield"),
        (1 - ratio(F.col("downtime_minutes"), F.col("planned_minutes"))).alias("availability"), ratio(F.col("rejected_qty"), F.col("delivered_qty")).alias("supplier_reject_rate"),
    )


def mtbf_mttr_monthly(production: DataFrame, events: DataFrame) -> DataFrame:
    month = F.to_date(F.date_trunc("month", F.col("production_date"))).alias("month")
    ran = production.groupBy(month, "machine_id").agg(F.sum("run_minutes").alias("run_minutes"))
    at = events.withColumn("production_date", F.to_date("reported_at")).where("work_type = 'BREAKDOWN' AND status = 'COMPLETED'")
    broke = at.groupBy(month, "machine_id").agg(F.count(F.lit(1)).alias("breakdowns"), F.sum("repair_minutes").alias("repair_minutes"))
    rows = ran.join(broke, ["month", "machine_id"], "left").withColumn("breakdowns", F.coalesce("breakdowns", F.lit(0)))
    return rows.select("month", "machine_id", "run_minutes", "breakdowns", (ratio(F.col("run_minutes"), F.col("breakdowns")) / 60).alias("mtbf_hours"), ratio(F.col("repair_minutes"), F.col("breakdowns")).alias("mttr_minutes"))


def pareto(rows: DataFrame, code: str, measure: str) -> DataFrame:
    """Counts by code, heaviest first, with the running share. The codes are few, the rows are not."""
    sums = rows.groupBy(code).agg(F.count(F.lit(1)).alias("occurrences"), F.sum(measure).alias("total"))
    order = Window.orderBy(F.desc("total"), code)
    running = F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sums.select("*", F.row_number().over(order).alias("rank"), ratio(running, F.sum("total").over(Window.partitionBy())).alias("cumulative_share"))


def defect_pareto(inspections: DataFrame, defects: DataFrame) -> DataFrame:
    named = inspections.where("defect_code <> 'NONE'").join(F.broadcast(defects) if is_small(defects) else defects, "defect_code", "left")
    return pareto(named, "defect_code", "defect_count")


def reject_rate_monthly(deliveries: DataFrame, suppliers: DataFrame) -> DataFrame:
    rows = day(deliveries).join(suppliers, "supplier_sk")
    sums = rows.groupBy(F.to_date(F.date_trunc("month", "production_date")).alias("month"), "supplier_id", "supplier_name").agg(F.sum("delivered_qty").alias("delivered_qty"), F.sum("rejected_qty").alias("rejected_qty"))
    return sums.withColumn("reject_rate", ratio(F.col("rejected_qty"), F.col("delivered_qty")))


def running_total(df: DataFrame, date: str, measure: str, parts: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Period-to-date: the sum since the period's start. ``parts``: year and month, or year."""
    period = [F.date_trunc(parts[-1], F.col(date))]
    window = Window.partitionBy(*by, *period).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"{measure}_{parts[-1]}_to_date", F.sum(measure).over(window))


def prior_year(df: DataFrame, date: str, measure: str, by: Sequence[str] = ()) -> DataFrame:
    """The measure of the same calendar day a year earlier and the change to it."""
    old = df.select(*by, F.add_months(date, 12).alias("_d"), F.col(measure).alias(f"{measure}_py"), F.dayofmonth(date).alias("_dom"))
    old = old.where(F.dayofmonth("_d") == F.col("_dom")).drop("_dom")  # 29 February has no counterpart
    on = [F.col(f"a.{date}") == F.col("b._d"), *[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]]
    joined = df.alias("a").join(old.alias("b"), on, "left").select("a.*", f"b.{measure}_py")
    return joined.withColumn(f"{measure}_yoy", ratio(F.col(measure) - F.col(f"{measure}_py"), F.col(f"{measure}_py")))


def rolling(df: DataFrame, date: str, measures: Sequence[str], days: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Sums over the last ``days`` calendar days, the current one included; gaps stay gaps."""
    number = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    window = Window.partitionBy(*by).orderBy("_n").rangeBetween(-(days - 1), 0)
    return df.withColumn("_n", number).select(*df.columns, *[F.sum(m).over(window).alias(f"{m}_{days}d") for m in measures])


def _sum(c: str) -> Column:
    return F.sum(c)


def _breakdowns() -> Column:
    return F.count_if((F.col("work_type") == "BREAKDOWN") & (F.col("status") == "COMPLETED"))


def _oee() -> Column:
    return ratio(_sum("available_minutes"), _sum("planned_minutes")) * at_most_one(ratio(_sum("units_produced"), _sum("ideal_units"))) * ratio(_sum("units_good"), _sum("units_produced"))


#: name -> (fact it is computed on, aggregate over any grouping of that fact).
MEASURES: dict[str, tuple[str, Callable[[], Column]]] = {
    "Units Produced": ("production", lambda: _sum("units_produced")),
    "Good Units": ("production", lambda: _sum("units_good")),
    "Scrapped Units": ("production", lambda: _sum("units_scrapped")),
    "Scrap Rate %": ("production", lambda: ratio(_sum("units_scrapped"), _sum("units_produced"))),
    "Production Runs": ("production", lambda: _sum("production_runs")),
    "Run Hours": ("production", lambda: _sum("run_minutes").cast("double") / 60),
    "Ideal Units": ("production", lambda: _sum("ideal_units")),
    "Sampled Units": ("production", lambda: _sum("sampled_units")),
    "Defect Units": ("production", lambda: _sum("defect_units")),
    "First Pass Yield %": ("production", lambda: 1 - ratio(_sum("defect_units"), _sum("sampled_units"))),
    "Defects PPM": ("production", lambda: ratio(_sum("defect_units"), _sum("sampled_units")) * 1e6),
    "Inspection Fail Rate %": ("production", lambda: ratio(_sum("failed_inspections"), _sum("inspections"))),
    "Planned Minutes": ("machine", lambda: _sum("planned_minutes")),
    "Downtime Minutes": ("machine", lambda: _sum("downtime_minutes")),
    "Availability %": ("machine", lambda: ratio(_sum("available_minutes"), _sum("planned_minutes"))),
    "Performance %": ("machine", lambda: at_most_one(ratio(_sum("units_produced"), _sum("ideal_units")))),
    "Quality %": ("machine", lambda: ratio(_sum("units_good"), _sum("units_produced"))),
    "OEE %": ("machine", _oee),
    "OEE Target": ("machine", lambda: F.max(F.lit(OEE_TARGET))),
    "OEE vs Target": ("machine", lambda: _oee() - OEE_TARGET),
    "Sensor Anomaly Minutes": ("machine", lambda: _sum("anomaly_minutes")),
    "Breakdowns": ("maintenance", _breakdowns),
    "MTTR (min)": ("maintenance", lambda: ratio(F.sum(F.when((F.col("work_type") == "BREAKDOWN") & (F.col("status") == "COMPLETED"), F.col("repair_minutes"))), _breakdowns())),
    "Open Work Orders": ("maintenance", lambda: F.count_if(F.col("status") != "COMPLETED")),
    "Scrap Cost": ("production", lambda: F.sum(F.col("units_scrapped") * F.col("unit_cost"))),
    "Supplier Reject Rate %": ("delivery", lambda: ratio(_sum("rejected_qty"), _sum("delivered_qty"))),
    "Data As Of": ("production", lambda: F.max("_gold_updated_ts")),
}


def evaluate(fact: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Measures of one fact at any level of aggregation, in one pass."""
    kinds = {MEASURES[n][0] for n in names}
    if len(kinds) > 1:
        raise ValueError(f"measures of several facts: {sorted(kinds)}")
    return fact.groupBy(*by).agg(*[MEASURES[n][1]().alias(n) for n in names])


def mtbf_hours(production: DataFrame, maintenance: DataFrame, by: Sequence[str]) -> DataFrame:
    """The measure that needs two facts: run hours per breakdown."""
    hours = evaluate(production, ["Run Hours"], by)
    broken = evaluate(maintenance, ["Breakdowns"], by)
    return hours.join(broken, list(by), "left").withColumn("MTBF (hrs)", ratio(F.col("Run Hours"), F.col("Breakdowns")))


def time_intelligence(production_days: DataFrame, date: str = "production_date") -> DataFrame:
    """Units Produced with MTD, PY and YoY %, over a table of one row a day."""
    return prior_year(running_total(production_days, date, "units_produced", ("year", "month")), date, "units_produced")


def oee_7d(machine_days: DataFrame, date: str = "production_date", by: Sequence[str] = ()) -> DataFrame:
    """OEE 7D Rolling: components summed over seven days, then the ratios."""
    parts = ("available_minutes", "planned_minutes", "units_produced", "ideal_units", "units_good")
    daily = machine_days.groupBy(*by, date).agg(*[F.sum(c).alias(c) for c in parts])
    r = rolling(daily, date, parts, 7, by)
    c = lambda n: F.col(f"{n}_7d")
    return r.withColumn("oee_7d", ratio(c("available_minutes"), c("planned_minutes")) * at_most_one(ratio(c("units_produced"), c("ideal_units"))) * ratio(c("units_good"), c("units_produced")))
