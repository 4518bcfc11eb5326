"""Registry of the engine's own queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernflow.plans import bindings

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(bindings.QUERIES)


def oracles() -> dict[str, str]:
    return dict(bindings.ORACLES)
