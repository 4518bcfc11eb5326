"""WARC archives: index first, then coalesced byte-range reads.

``write_archive`` turns pages into gzip-per-record WARC files and returns the index (page,
file, offset, length, URL, digest). ``read_records`` takes any selection of index rows,
sorts them by file and offset, joins neighbouring byte ranges into one read and parses the
records. A retried task writes a file of its own and the index names only files of tasks
that ended, so files of lost tasks are never read.

Defined results for odd input: null html is an empty payload; a null URL has no target
header; a page without ``page_id`` is always a response; rows that repeat the smallest
``page_id`` of a payload are all responses, a page that repeats a larger one with its payload
is a revisit each time; an empty table gives an empty index. A URL is read back as it is
written, percent-encoded where it holds blanks, controls or letters beyond ASCII.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernflow.llm.common import hot_join, in_pandas, materialise, new_path, remove, written

INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LEVEL = 3


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url if page_id is None else ''}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, not yet compressed."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url or '')}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    block = HTTP_HEAD
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, '')}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    headers = {k.lower(): v for k, v in headers.items()}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def mark_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to.

    Repeats are found on (digest, page_id) alone; payloads meet the table of revisits, which is
    broadcast if Spark's size check allows it and otherwise joined by page, so that neither a
    common payload nor the many small ones gather in a task. A revisit leaves its payload behind
    before anything is written.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    base = base.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    narrow = base.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", F.unhex("payload_digest").alias("digest"))
    narrow, path = written(narrow, "payloads")
    total = narrow.count()
    repeated = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = hot_join(narrow, repeated, ["digest"], "n", total).where("page_id > refers_to").distinct()
    revisits = materialise(revisits.select(F.col("page_id").alias("_page"), F.lower(F.hex("digest")).alias("_digest"), "refers_to"), "revisits", total)
    remove(pages.sparkSession, path)
    joined = base.join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("").alias("payload"), "payload_bytes", "payload_digest", "refers_to"
    )


def write_archive(pages: DataFrame, target: str, min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the records of ``pages`` under ``target`` and return the written index."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(target)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if out is None and len(batch):
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            rows = []
            for page, url, text, size, digest, refers in zip(*(batch[c] for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")), strict=True):
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                url = None if pd.isna(url) else url
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = packer.compress(record(page, url, text.encode(), int(size), digest, refers, date)) + packer.flush()
                out.write(data)
                rows.append((page, url, name, at, len(data), int(size), digest, "response" if refers is None else "revisit", refers))
                at += len(data)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if out is not None:
            out.close()

    return materialise(in_pandas(mark_revisits(pages, min_bytes), write, INDEX), "warc-index")


def read_records(index: DataFrame, target: str, payload: bool = True, gap: int = 1 << 16, most: int = 1 << 23) -> DataFrame:
    """Read the records that ``index`` selects.

    Neighbours at most ``gap`` bytes apart are read at once, ``most`` bytes at a time (a
    longer record is read alone). Every payload is checked against its digest.
    """
    schema = RECORD + (", html string" if payload else "")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(target)
        name, source = None, None
        for batch in batches:
            files, starts, sizes = batch["file"].tolist(), batch["offset"].tolist(), batch["length"].tolist()
            rows, i = [], 0
            while i < len(files):
                j, end = i + 1, starts[i] + sizes[i]
                while j < len(files) and files[j] == files[i] and starts[j] - end <= gap and starts[j] + sizes[j] - starts[i] <= most:
                    end = max(end, starts[j] + sizes[j])
                    j += 1
                if files[i] != name:
                    if source is not None:
                        source.close()
                    name, source = files[i], store.open_input_file(f"{root}/{files[i]}")
                block = source.read_at(end - starts[i], starts[i])
                for k in range(i, j):
                    at = starts[k] - starts[i]
                    headers, body = parse(zlib.decompress(block[at : at + sizes[k]], 31))
                    digest, kind = headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"]
                    if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(headers["x-payload-length"])):
                        raise ValueError(f"{name} at {starts[k]}: the payload does not match its digest")
                    page, refers = (int(headers[x]) if x in headers else None for x in ("x-page-id", "x-refers-to-page-id"))
                    row = (page, headers.get("warc-target-uri"), int(headers["x-payload-length"]), digest, kind, refers)
                    rows.append((*row, body.decode() if kind == "response" else None) if payload else row)
                i = j
                if len(rows) >= 512 or i == len(files):
                    yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
                    rows = []
        if source is not None:
            source.close()

    tasks = -(-(index.agg(F.sum("length")).first()[0] or 1) // most)
    ranges = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / (4 * most)))
    return in_pandas(ranges.sortWithinPartitions("file", "offset"), read, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    target = new_path(spark, "warc")
    index = write_archive(pages, target)
    return read_records(index, target, payload=False).drop("url")


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""
