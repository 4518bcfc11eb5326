"""Landing zone: lineage, incremental bronze ingest, manifests, CSV drops, publish by rename."""

from __future__ import annotations

import json
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quernflow.registry import Entity
from quernflow.sources.versioned import FileStore

RUN_ID = r"run_id=([^/]+)"
LOAD_DATE = r"load_date=(\d{4}-\d{2}-\d{2})"
MANIFEST = (
    "run_id string, entity_name string, source_system string, load_pattern string, status string, pipeline_run_id string, "
    "source_count long, rows_read long, rows_copied long, rows_skipped long, load_date string, window_start string, window_end string"
)
CORRUPT = "_corrupt_record"


def raw_folder(root: str, entity: Entity) -> str:
    return f"{root}/raw/{entity.folder or entity.name}"


def raw_path(root: str, entity: Entity, load_date: str, run_id: str) -> str:
    return f"{raw_folder(root, entity)}/load_date={load_date}/run_id={run_id}"


def run_id_of(entity: str, day: str, number: int) -> str:
    return f"{entity}_{day.replace('-', '')}_{number:02d}"


def raw_schema(entity: Entity) -> StructType:
    """Source columns land as text; a CDC entity has its change columns in front."""
    prefix = ["cdc_start_lsn", "cdc_seqval", "cdc_operation", "cdc_update_mask", "cdc_commit_ts"] if entity.deleted_when else []
    return StructType([StructField(c, StringType()) for c in [*prefix, *(a.source for a in entity.attributes)]])


def lineage(path: Column) -> dict[str, Column]:
    """Run id and load date from the path; a path without them gives NULL, not an error."""
    run, day = F.regexp_extract(path, RUN_ID, 1), F.regexp_extract(path, LOAD_DATE, 1)
    return {"_ingestion_run_id": F.when(run != "", run), "_load_date": F.try_to_date(F.when(day != "", day), "yyyy-MM-dd")}


def add_lineage(df: DataFrame, system: str, ingest_ts: Column | None = None) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.select(
        *[c for c in df.columns if c not in ("load_date", "run_id")], path.alias("_source_file"), F.col("_metadata.file_modification_time").alias("_source_file_ts"),
        *[c.alias(n) for n, c in lineage(path).items()], F.lit(system).alias("_source_system"), (F.current_timestamp() if ingest_ts is None else ingest_ts).alias("_ingest_ts"),
    )


def merged_schema(spark: SparkSession, path: str, declared: StructType) -> StructType:
    """The declared columns plus what newer files add: read from the footers before a stream starts."""
    found = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path).schema
    have = {f.name for f in declared}
    return StructType([*declared, *[f for f in found if f.name not in have and f.name not in ("load_date", "run_id")]])


def read_raw_stream(spark: SparkSession, path: str, entity: Entity, schema: StructType | None = None, max_files: int = 500) -> DataFrame:
    """New raw files of the entity, each seen once."""
    stream = spark.readStream.schema(schema or raw_schema(entity)).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True)
    return add_lineage(stream.parquet(path), entity.system)


def ingest_to_bronze(spark: SparkSession, raw: str, bronze: str, checkpoint: str, entity: Entity, evolve: bool = True) -> None:
    """Append what is new and stop; a repeated call adds nothing."""
    schema = merged_schema(spark, raw, raw_schema(entity)) if evolve else raw_schema(entity)
    stream = read_raw_stream(spark, raw, entity, schema)
    stream.writeStream.format("parquet").option("path", bronze).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_bronze_stream(spark: SparkSession, bronze: str, schema: StructType, max_files: int = 200) -> DataFrame:
    """Bronze as the source of silver."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(bronze)


def write_manifest(spark: SparkSession, root: str, manifest: dict) -> str:
    path = f"{root}/raw/_manifests/{manifest['entity_name']}/{manifest['run_id']}.json"
    store = FileStore(spark, root)
    store.delete(path)
    store.create(path, json.dumps(manifest, indent=1))
    return path


def read_manifests(spark: SparkSession, root: str, entity: str) -> DataFrame:
    """All manifests of an entity; none yet gives an empty table."""
    folder = f"{root}/raw/_manifests/{entity}"
    if not FileStore(spark, root).names(folder):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)


def publish(df: DataFrame, root: str, target: str) -> None:
    """Write-audit-publish: write to staging, then rename. A repeated run id replaces its own files."""
    staging = f"{root}/_staging/{target.rstrip('/').rsplit('/', 1)[-1]}"
    df.write.mode("overwrite").parquet(staging)
    store = FileStore(df.sparkSession, root)
    store.delete(target)
    store.fs.mkdirs(store.path(target).getParent())
    store.rename(staging, target)


def read_csv_drop(spark: SparkSession, paths: list[str], columns: list[str], modified_after: str | None = None, modified_before: str | None = None, pattern: str = "*.csv") -> DataFrame:
    """CSV files of a landing folder by modification window, all columns as text.

    A line with too many or too few fields keeps its text in a column; fields are counted
    even if a query needs only some of them.
    """
    schema = StructType([StructField(c, StringType()) for c in [*columns, CORRUPT]])
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).option("pathGlobFilter", pattern)
    for name, value in (("modifiedAfter", modified_after), ("modifiedBefore", modified_before)):
        if value:
            reader = reader.option(name, value)
    return reader.csv(paths).select("*", F.col("_metadata.file_name").alias("_landing_file_name"))


def split_rejects(drop: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, reject log). The log has the first field too: Spark does not read the corrupt column alone."""
    good = drop.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, drop.where(F.col(CORRUPT).isNotNull()).select("_landing_file_name", F.col(drop.columns[0]).alias("first_field"), F.col(CORRUPT).alias("rejected_line"))


def archive_drop(spark: SparkSession, root: str, folder: str, archive: str, names: list[str]) -> list[str]:
    """Move landed files out of the drop folder once their rows are published; a file that an
    earlier attempt has moved already is no error. The moved ones are returned."""
    store, moved = FileStore(spark, root), []
    store.fs.mkdirs(store.path(archive))
    there = set(store.names(folder))
    for name in names:
        if name in there:
            store.delete(f"{archive}/{name}")
            store.rename(f"{folder}/{name}", f"{archive}/{name}")
            moved.append(name)
    return moved


def land_csv(spark: SparkSession, root: str, folder: str, archive: str, target: str, columns: list[str], pattern: str = "*.csv") -> tuple[int, int]:
    """Publish the good lines of a drop folder, keep the rejects beside them, then archive the files.

    The files are listed once, so a file that arrives meanwhile waits for the next run.
    Gives the counts of good and rejected lines.
    """
    names = [n for n in FileStore(spark, root).names(folder) if fnmatch(n, pattern)]
    if not names:
        return 0, 0
    good, rejected = split_rejects(read_csv_drop(spark, [f"{folder}/{n}" for n in names], columns, pattern=pattern))
    publish(good, root, target)
    log = f"{root}/_rejects/{target.rstrip('/').rsplit('/', 1)[-1]}"
    rejected.write.mode("overwrite").parquet(log)
    counts = tuple(spark.read.parquet(p).count() for p in (target, log))  # of what was written, before the files go
    archive_drop(spark, root, folder, archive, names)
    return counts
