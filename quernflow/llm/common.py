"""Shared folder, written intermediate tables and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import quernflow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made for sessions that name none, by application id.
_LOCAL: dict[str, str] = {}

#: Applications whose executors have this package.
_SHIPPED: set[str] = set()

ROWS_PER_FILE = 1 << 19

#: A key is heavy if it has over one in HOT of all rows; fewer than HOT keys can be.
HOT = 4096

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Only a single-process session may leave that unset;
    then a temporary folder serves, as all tasks run on this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quernflow-")
    return _LOCAL[context.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quernflow/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, most_rows: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it again; also its path.

    The lineage ends here: a lost executor costs a re-read, not a recomputation. If a bound of
    the rows is known, they go into as few files as hold them at ROWS_PER_FILE each.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, tag: str, most_rows: int | None = None) -> DataFrame:
    return written(df, tag, most_rows)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, whatever their Python path is."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(quernflow.__file__).resolve().parent
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="quernflow-")), "quernflow.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(target)


def give_back() -> None:
    """Return the freed memory of this process, of Arrow and of the C library, to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, TypeError, AttributeError):  # not the GNU library
        pass


def frugal(function):
    """The function of a task; a worker serves many tasks and stages, and else keeps the most that any of them took."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(frugal(function), schema)


def in_pandas(df: DataFrame, function, schema) -> DataFrame:
    """``mapInPandas`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInPandas(frugal(function), schema)


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined ("inner" or "left") with ``keyed``, which has a row per key, on non-null keys.

    ``count`` is the column of ``keyed`` (not kept) that says how many of the ``total`` rows have
    the key. Heavy keys are fewer than HOT rows, whatever the data, so these are broadcast and
    their rows stay where they are; all other keys meet by shuffle.
    """
    heavy = F.col(count) * HOT > total
    values = [c for c in keyed.columns if c not in (*on, count)]
    hot = F.broadcast(keyed.where(heavy).select(*on, F.struct(*values).alias("_hot")))
    met = rows.join(hot, on, "left")  # both uses of this share one broadcast
    rest = met.where("_hot IS NULL").drop("_hot").join(keyed.where(~heavy).drop(count), on, how)
    found = met.where("_hot IS NOT NULL")
    return found.select(*rows.columns, *[F.col("_hot")[c].alias(c) for c in values]).unionByName(rest)


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z; every other character stays. Text that is all ASCII takes the faster function."""
    ascii_only = F.octet_length(column) == F.length(column)
    return F.when(ascii_only, F.lower(column)).otherwise(F.translate(column, ASCII_UPPER, ASCII_UPPER.lower()))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out of all learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """A row without id counts as held out: it has no fold to learn from."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partition_sum(df: DataFrame, task, length: int):
    """Sum over all partitions of ``task(batches)``, a vector of ``length`` doubles.

    The partial vectors meet in a tree of tasks; the driver gets a few of them.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(task(batches), np.float64).tobytes()], pa.binary())], ["part"])

    parts = in_arrow(df, run, "part binary").rdd.map(lambda row: np.frombuffer(row[0], np.float64))
    return parts.treeAggregate(np.zeros(length), lambda a, b: a + b, lambda a, b: a + b, depth=2)
