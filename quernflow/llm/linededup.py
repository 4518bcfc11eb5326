"""Line dedup over levelled sorted runs of line hashes.

The index of lines seen so far is a set of *runs*: tables of (128-bit line hash, first
document), bucketed and sorted by hash; a bucket is one file, so that merge joins read the runs
in their order and sort only the batch. A batch of documents is merge-anti-joined with
the runs; what it alone holds becomes a run of its own, and once a level has ``fanout``
runs they are compacted into one run of the next level. Batches come in ascending ranges
of ``doc_id``, so the first holder of a line is the smallest ``doc_id`` that has it. There are
``batches`` of them at least, and more so that none has over ``batch_rows`` documents.

Defined results for odd input: a null text is one empty line; rows that repeat a
``doc_id`` are the same document; a row without ``doc_id`` neither holds nor loses lines;
an empty table gives an empty result; other columns pass through ``deduplicate``, also those
named like its counts if it is called without counts (with them, the counts take their place).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernflow.llm.common import ASCII_SPACE, ascii_lower, hot_join, materialise, new_path, remove, written

HASH = ["_h1", "_h2"]
#: Lets a scan of a table with one sorted file a bucket say that it is sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def ordered_scans(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ORDERED)
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before)


def stripped(line: Column) -> Column:
    """The line without white space at its ends. Most lines have none to take."""
    padded = reduce(or_, (line.startswith(c) | line.endswith(c) for c in ASCII_SPACE))
    return F.when(padded, F.trim(line, F.lit(ASCII_SPACE))).otherwise(line)


def line_key(line: Column) -> Column:
    return ascii_lower(stripped(line))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_hash(text: Column) -> Column:
    """Tells rows apart that repeat a doc_id with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that can be dropped: doc_id, _text, _pos, _h1, _h2."""
    lines = docs.where("doc_id IS NOT NULL").select(
        "doc_id", _text_hash(F.col("text")).alias("_text"), F.posexplode(split_lines(F.col("text"))).alias("_pos", "_line")
    )
    # lower-casing keeps the length, so short lines go before it
    keyed = lines.where(F.length(stripped(F.col("_line"))) >= min_chars).select("doc_id", "_text", "_pos", line_key(F.col("_line")).alias("_key"))
    return keyed.select("doc_id", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))


@dataclass
class LineRuns:
    """The levelled runs; each is an external table of the shared folder."""

    spark: SparkSession
    buckets: int
    fanout: int = 2
    levels: list[list[tuple[str, str]]] = field(default_factory=list)

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"quern_run_{uuid.uuid4().hex}", new_path(self.spark, "run")
        (
            rows.select(*HASH, "_first")
            .repartition(self.buckets, *HASH)
            .write.bucketBy(self.buckets, *HASH)
            .sortBy(*HASH)
            .option("path", path)
            .saveAsTable(name)
        )
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        remove(self.spark, run[1])

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def seen(self, hashes: DataFrame) -> DataFrame:
        """Adds the first holder that any run knows: one merge join per run, null if none."""
        out = hashes.withColumn("_known", F.lit(None).cast("long"))
        for run in self.runs():
            hit = run.select(*HASH, F.col("_first").alias("_hit"))
            out = out.join(hit, HASH, "left").withColumn("_known", F.coalesce("_known", "_hit")).drop("_hit")
        return out

    def add(self, fresh: DataFrame) -> None:
        """Append a run of hashes no other run holds; compact full levels."""
        self._push(0, self._write(fresh))

    def _push(self, level: int, run: tuple[str, str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fanout:
            return
        full, self.levels[level] = self.levels[level], []
        merged = self.spark.table(full[0][0])
        for name, _ in full[1:]:
            merged = merged.unionByName(self.spark.table(name))
        run = self._write(merged)
        for old in full:
            self._drop(old)
        self._push(level + 1, run)

    def close(self) -> None:
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = []


def dropped_lines(docs: DataFrame, min_chars: int = 10, batches: int = 3, fanout: int = 2, batch_rows: int = 1 << 26) -> DataFrame:
    """doc_id, _text, _drop: positions of the lines that an earlier document holds."""
    spark = docs.sparkSession
    batches = max(batches, -(-docs.count() // batch_rows))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    batch = sum(((F.col("doc_id") > c).cast("int") for c in cuts), F.lit(0))
    used, losses = [], []
    runs = LineRuns(spark, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), fanout)
    try:
        with ordered_scans(spark):
            path = new_path(spark, "lines")
            used.append(path)
            hashes = line_hashes(docs, min_chars).withColumn("_batch", batch)
            hashes.write.partitionBy("_batch").parquet(path)
            hashes = spark.read.schema(hashes.schema).parquet(path)
            for number in range(len(cuts) + 1):
                part = hashes.where(F.col("_batch") == number).drop("_batch")
                own = part.groupBy(*HASH).agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
                own, path = written(runs.seen(own), "seen")
                used.append(path)
                if number < len(cuts):
                    runs.add(own.where("_known IS NULL"))
                total = own.agg(F.sum("_n")).first()[0] or 0
                shared = own.where("_known IS NOT NULL OR _first < _last").select(*HASH, F.coalesce("_known", "_first").alias("_first"), "_n")
                lost = hot_join(part, shared, HASH, "_n", total).where(F.col("doc_id") > F.col("_first"))
                losses.append(lost.select("doc_id", "_text", "_pos"))
            lost = reduce(DataFrame.unionByName, losses)
            return materialise(lost.groupBy("doc_id", "_text").agg(F.collect_set("_pos").alias("_drop")), "lost")
    finally:
        runs.close()
        for path in used:
            remove(spark, path)


def deduplicate(docs: DataFrame, counts: bool = True, **options) -> DataFrame:
    """Every row of ``docs`` with its text after dropping and, with ``counts``, ``n_lines`` and
    ``n_dropped``. ``options``: those of ``dropped_lines``."""
    lost = dropped_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), "_drop")
    own = [c for c in docs.columns if c != "text" and not (counts and c in ("n_lines", "n_dropped"))]
    # the other columns travel in a struct, where no name of theirs can clash; the lines are split
    # below the join, so that the row that comes out of it holds them ready
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), _text_hash(F.col("text")).alias("_own"), split_lines(F.col("text")).alias("_lines")
    )
    joined = rows.join(lost, (F.col("_doc") == F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop")
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.transform(left, lambda i: F.get("_lines", i)))
    out = joined.select("_row", F.array_join(kept, "\n").alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))
    extra = ["n_lines", "n_dropped"] if counts else []
    return out.select(*[F.col("_row")[c].alias(c) for c in own], "text", *extra)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = deduplicate(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'pos': i, 'line': x})) AS u FROM documents)),
firsts AS (SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT l.doc_id, l.pos, l.line, f.first IS NOT NULL AND l.doc_id > f.first AS lost
  FROM lines l LEFT JOIN firsts f ON l.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
