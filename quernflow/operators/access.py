"""Row-level entitlement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANY = "*"


def entitled(df: DataFrame, entitlements: DataFrame, user: str, column: str = "plant_id", exempt: bool = False) -> DataFrame:
    """Rows whose plant the user may see; ``*`` entitles to all, an exempt role sees everything."""
    if exempt:
        return df
    mine = entitlements.where(F.upper("user_email") == user.upper()).select(F.col("plant_id").alias("_may")).distinct()
    everything = mine.agg(F.coalesce(F.bool_or(F.col("_may") == ANY), F.lit(False))).scalar()
    listed = df.join(mine, F.col(column) == F.col("_may"), "left")
    return listed.where(F.col("_may").isNotNull() | everything).drop("_may")
