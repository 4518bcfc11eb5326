"""Small tables for the operator tests."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang), with a column of a clashing name."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(spark):
    """Null ids and texts, empty and repeated rows, a very long text, texts without letters."""
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, ""), (None, "a line without an id, long enough"), (4, "word " * 60_000), (5, "Twice the same row here"), (5, "Twice the same row here"), (6, "12 34 !!"), (7, "éè 中文 \U0001f600\n\n\t x")]
    return docs(spark, rows).withColumns({c: F.lit("clash") for c in ("fingerprint", "score", "n_lines", "component_id", "start", "license", "_drop", "w0", "rep")})


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
