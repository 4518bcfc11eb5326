"""Source extraction windows: LSN ranges, watermarks, full loads and paged APIs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class LsnGapError(RuntimeError):
    """The source no longer holds changes the window needs."""


def lsn_window(log: DataFrame, low: str, high: str, column: str = "cdc_start_lsn") -> DataFrame:
    """Changes with low < lsn <= high. LSNs have a fixed width, so text order is their order.

    Raises if the log's oldest change is newer than the start: cleaned-up changes are lost.
    """
    oldest = log.agg(F.min(column)).first()[0]
    if low and low != "0x" + "0" * 20 and oldest is not None and oldest > low:
        raise LsnGapError(f"oldest change {oldest} is after {low}")
    return log.where((F.col(column) > low) & (F.col(column) <= high))


def watermark_window(table: DataFrame, column: str, low: str, high: str) -> DataFrame:
    """Rows with low < watermark <= high; the count gate uses the same predicate."""
    return table.where((F.col(column) > F.lit(low).cast("timestamp")) & (F.col(column) <= F.lit(high).cast("timestamp")))


def count_gate(table: DataFrame, column: str, low: str, high: str) -> int:
    return watermark_window(table, column, low, high).count()


def jdbc_options(url: str, query: str, fetch_size: int = 10_000, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> dict[str, str]:
    """Options of Spark's JDBC reader; a partition column splits the read."""
    options = {"url": url, "dbtable": f"({query}) q", "fetchsize": str(fetch_size)}
    if partition_column and bounds:
        options |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return options


def kafka_options(servers: str, topic: str, max_offsets: int = 50_000, starting: str = "earliest", sasl_jaas: str | None = None) -> dict[str, str]:
    """Options of Spark's Kafka source, for clusters that have its package."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "maxOffsetsPerTrigger": str(max_offsets), "failOnDataLoss": "false"}
    if sasl_jaas:
        options |= {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": sasl_jaas}
    return options


class PagedReader(DataSourceReader):
    """Reads pages until one is empty: page 1, 2, ... each a partition of its own if the count is known."""

    def __init__(self, schema: StructType, fetch: Callable[..., str], most: int, stride: int, token: Callable[[], str] | None, spacing: float) -> None:
        self.schema, self.fetch, self.most, self.stride, self.token, self.spacing = schema, fetch, most, stride, token, spacing

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.stride)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = partition.value + 1
        while rows := self._rows(page):
            if page > self.most:
                raise RuntimeError(f"page {page} still has rows: raise the limit of {self.most} pages")
            for row in rows:
                yield tuple(row.get(f.name) for f in self.schema)
            page += self.stride
            if self.spacing:
                time.sleep(self.spacing * self.stride)

    def _rows(self, page: int) -> list[dict]:
        return json.loads(self.fetch(page, self.token()) if self.token else self.fetch(page)).get("data") or []


def paged_source(name: str, schema: str, fetch: Callable[..., str], most: int = 5000, stride: int = 4, token: Callable[[], str] | None = None, spacing: float = 0.0) -> type[DataSource]:
    """A data source class over ``fetch(page) -> JSON text``; register it with the session.

    ``stride`` readers take every ``stride``-th page, all of them together at most one page in
    ``spacing`` seconds. With ``token`` each call is ``fetch(page, token())``, so that a token that
    runs out is fetched anew. A source of over ``most`` pages is an error, not a shorter table.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> PagedReader:
            return PagedReader(schema, fetch, most, stride, token, spacing)

    return Paged


def explode_pages(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Pages saved as JSON files, one row per element of ``data``."""
    schema = f"meta struct<page:int,page_size:int,total_count:int>, data array<struct<{row_schema}>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("data"))
