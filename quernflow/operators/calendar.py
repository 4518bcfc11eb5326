"""Static dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernflow.functions.columns import date_key

FISCAL_START = 4

# Shifts and defect types.
SHIFTS = [("A", "Morning", 6, 14, False), ("B", "Afternoon", 14, 22, False), ("C", "Night", 22, 6, True), ("UNKNOWN", "Unknown", None, None, False)]
DEFECTS = [
    ("NONE", "No defect", "NONE", "NONE"),
    ("SCRATCH", "Surface scratch", "COSMETIC", "MINOR"),
    ("DIMENSION_OOT", "Dimension out of tolerance", "DIMENSIONAL", "MAJOR"),
    ("POROSITY", "Casting porosity", "MATERIAL", "MAJOR"),
    ("BURR", "Burr on machined edge", "COSMETIC", "MINOR"),
    ("CRACK", "Crack", "STRUCTURAL", "CRITICAL"),
    ("WELD_SPATTER", "Weld spatter", "COSMETIC", "MINOR"),
]


def dim_date(spark: SparkSession, first: str = "2024-01-01", last: str = "2030-12-31") -> DataFrame:
    """One row a day. The week day is 1 for Sunday; a fiscal year is named after the year it ends in."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 DAY"))).alias("d"))
    d = F.col("d")
    fiscal = F.year(d) + F.when(F.month(d) >= FISCAL_START, 1).otherwise(0)
    return days.select(
        date_key(d).alias("date_key"), d.alias("calendar_date"), F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"),
        F.weekofyear(d).alias("iso_week"), F.dayofweek(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.dayofweek(d).isin(1, 7).alias("is_weekend"), F.concat(F.lit("FY"), fiscal.cast("string")).alias("fiscal_year"),
    )


def dim_shift(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SHIFTS, "shift_code string, shift_name string, start_hour int, end_hour int, crosses_midnight boolean")


def dim_defect_type(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFECTS, "defect_code string, defect_description string, defect_category string, severity string")
