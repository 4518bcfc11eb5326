"""The corpus pipeline: five stages from raw documents to packed token windows.

Each stage is written as Parquet and read again as the next one's documents; ``run`` removes a
stage's table once the next one is written. All but the last return the columns of
``documents``, also those named like a column that some operator adds; the last returns the
pieces of the windows. An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernflow.llm import contamination, langid, linededup, packing, simhash
from quernflow.llm.common import remove, written

#: A document is rejected if no language has so large a share of its words.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a recognised language; ``und`` and undecided ones go.

    Null and empty texts and texts without a letter go. Every letter of a long text counts. A row is
    judged by its text alone, so repeated rows stay or go together; ties of two languages do not
    matter, as only the largest share is compared. Without a labelled row nothing is recognised.
    """
    return langid.recognised(docs, langid.train(docs), LEAST_SHARE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds; ``n_chars`` follows the new text.

    Every row stays, with an empty text if all its lines go; a null text becomes empty. Rows that
    repeat a ``doc_id`` are one document and keep their own lines; rows without one lose none.
    """
    out = linededup.deduplicate(docs, counts=False)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the smallest id.

    All texts without words are one group. Exact repeats of a row go; rows that repeat a ``doc_id``
    with other texts are documents of their own; rows without ``doc_id`` stay.
    """
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, wherever in the text and however long it is.

    Null and wordless texts and items match nothing; each row is judged for itself, with or
    without an id; an empty benchmark removes nothing.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.without_leaks(docs, bench)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, packed into windows of 4096 tokens.

    A null or empty text is the end token alone; longer texts than a window are cut; repeated rows
    are packed each for itself.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Language, near-dedup, decontamination and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            remove(spark, before)
        before = path
    return docs
