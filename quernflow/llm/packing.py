"""Packing token ids into windows: best-fit decreasing over a segment tree.

Documents are tokenized where they are read; the ids never move, only piece lengths and
checksums do. Overlong documents are first cut into full windows, each a sequence of its
own. The rests are dealt evenly over groups of about ``group_rows`` pieces and packed
there, longest first, into the open window with the least capacity that still holds them.

Defined results for odd input: a null or empty text has only the end id; repeated rows are
packed each for itself; a null ``doc_id`` stays null; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernflow.llm.common import in_arrow, in_pandas, materialise

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Remembered chunks, and the longest chunk worth remembering.
CACHE, CHUNK = 600_000, 48
#: Punctuation that never joins the word before it (an apostrophe may).
MARKS = b".,!?;:#$%&*|"


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is a
    visible Latin-1 character, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in visible)}
    return [chr(hidden.get(b, b)) for b in range(256)]


class ChunkEncoder(dict):
    """Token ids of whole texts as little-endian 32-bit bytes; a dictionary of chunks.

    White space separates tokens in this vocabulary, so a text's ids are its chunks' ids
    in order, and chunks that come again are encoded once. Only ASCII white space is cut at:
    what it separates is not changed by the tokenizer's normal form. A word of Latin letters
    is one token run, whatever punctuation follows it; it goes to the tokenizer's model
    itself, lower-cased and as byte letters, and is remembered without the punctuation.
    Anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[bytes, bytes] = {}
        self.letters = dict(enumerate(byte_letters()))

    def _whole(self, chunk: bytes) -> bytes:
        ids = self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, word: str) -> bytes:
        found = [x.id for x in self.model.tokenize(word)]
        return struct.pack(f"<{len(found)}I", *found)

    def _word(self, word: bytes) -> bytes | None:
        """Ids of a word of Latin letters, else None."""
        if word.isalpha():  # ASCII letters are their own byte letters
            word = word.lower()
            if word not in self.parts:
                self.parts[word] = self._run(word.decode())
            return self.parts[word]
        if word not in self.parts:
            text = word.decode()
            # below U+0180 letters are in normal form and lower-case one by one; a dotted capital I is not
            if not text.isalpha() or max(text) >= "\u0180" or "\u0130" in text:
                return None
            self.parts[word] = self._run(text.lower().encode().decode("latin-1").translate(self.letters))
        return self.parts[word]

    def __missing__(self, chunk: bytes) -> bytes:
        word = chunk.rstrip(MARKS)
        ids = self._word(word) if word else None
        if ids is None:
            ids = self._whole(chunk)
        elif len(word) < len(chunk):
            tail = chunk[len(word) :]
            if tail not in self.parts:
                self.parts[tail] = self._whole(tail)
            ids += self.parts[tail]
        if len(chunk) <= CHUNK:
            if len(self) > CACHE:
                self.clear()
                self.parts.clear()
            self[chunk] = ids
        return ids

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            yield b"".join(map(self.__getitem__, text.encode().split()))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Every document cut into full windows and a rest: one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = ChunkEncoder(tokenizer), struct.pack("<I", end_id)
        for batch in batches:
            rows = []
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                rows += [(doc, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECE.split(", ")])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECE)


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree of counts."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.ids: list[list[int]] = [[] for _ in range(window + 1)]

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, ident: int) -> None:
        self.ids[capacity].append(ident)
        self._change(capacity, 1)

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that a window has."""
        node, count = least + self.size, self.count
        if count[node]:
            return least
        while node > 1:  # up to the first subtree on the right that has a window
            if not node & 1 and count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.size:
            node <<= 1
            if not count[node]:
                node += 1
        return node - self.size

    def take(self, capacity: int) -> int:
        self._change(capacity, -1)
        return self.ids[capacity].pop()


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of each length; longest come first."""
    free, out, windows = OpenWindows(window), [], 0
    for n in lengths:
        capacity = free.tightest(n)
        if capacity is None:
            capacity, ident = window, windows
            windows += 1
        else:
            ident = free.take(capacity)
        out.append((ident, window - capacity))
        if capacity > n:
            free.put(capacity - n, ident)
    return out


def pack(cut: DataFrame, window: int, group_rows: int) -> DataFrame:
    """Adds sequence_id and offset. ``cut`` is read twice, so it should be a written table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [b for b in batches if len(b)]
        if not whole:
            return
        rows = pd.concat(whole, ignore_index=True)
        # a fixed order, whatever order the shuffle brought: a repeated task gives the same rows
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        placed = np.array(best_fit(rows["length"].tolist(), window), np.int64)
        base = TaskContext.get().partitionId() << 40
        yield rows.assign(sequence_id=base + placed[:, 0], offset=placed[:, 1])

    groups = max(1, -(-cut.count() // group_rows))
    # dealt in turn, so that rows repeated any number of times spread as well; Spark sorts before
    # it deals, which makes a repeated task deal alike
    spread = cut.withColumn("doc_id", F.col("doc_id").cast("long")).repartition(groups)
    return in_pandas(spread, run, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, group_rows: int = 1 << 16) -> DataFrame:
    return pack(materialise(pieces(docs, tokenizer, end_id, window), "pieces"), window, group_rows)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
