"""Benchmark decontamination by latent semantic retrieval.

1. Words: every text is split once; its words become numbers of the benchmark's vocabulary
   (0: not in it), written beside the row. All further steps read these numbers.
2. Word weights: inverse document frequencies, counted over the passages of *all* documents.
3. Latent space: a randomised SVD of the TF-IDF passages of all documents and of the benchmark.
   Every partition sums its part of the sketch A'A(Omega) in one pass; the leading directions
   follow from it by the Nystroem formula. ``rank`` does not depend on the number of items.
4. Candidates: document passages (two neighbouring blocks of words, sliding by a block) whose
   cosine with an item is at least ``latent`` in that space. A space of few directions blurs
   what tells items apart, so copies are found exactly beside it: by postings of the items'
   words, passages whose full TF-IDF cosine is at least ``cosine``, or that hold the share
   ``own`` of the weight of an item, however small that is beside the passage's other words;
   one of the passages that an unchanged copy touches holds half. Items longer than a passage
   are searched for by overlapping pieces of a passage's length too.
5. Check: longest common subsequence of the item and the text around the passage, and the
   share of the item's *answer* (its most telling words) found there. A hit has a
   subsequence of 0.8 of the item, or of half the item together with most of the answer.
   For items of at most SHORT words both must be in twice as many neighbouring words.

Items go in blocks of ``block`` rows, which bounds what is sent to the executors.
Defined results for odd input: null and wordless texts and items match nothing; rows that
repeat a ``doc_id`` give one row per item, the best; repeated items are items of their own
unless the ``item_id`` is the same; a null id takes no part (``without_leaks`` needs no id);
an item of a single word is found wherever that word is; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quernflow.llm.common import in_arrow, materialise, partition_sum

WORD = re.compile(r"\w+")
BLOCK = 16
SLICE = 512
#: Blocks that are projected at once; largest full table of words and items.
ROWS, DENSE = 1 << 12, 1 << 23
SHORT = 8
HIT = "doc_id long, item_id long, subsequence double, answer double, cosine double, start_word long"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def encode(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[DataFrame, str]:
    """The rows with the numbers of their words, written; and the name of that column."""
    name, at = "_words", docs.columns.index("text")
    while name in docs.columns:
        name += "_"
    kind = np.uint16 if len(vocabulary) < 1 << 16 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE):
                batch = whole.slice(s, SLICE)
                found = []
                for x in batch.column(at):
                    words = words_of(x.as_py())
                    found.append(np.fromiter(map(vocabulary.get, words, repeat(0)), kind, len(words)).tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, BinaryType())])
    return materialise(in_arrow(docs, run, schema), "words"), name


def numbers(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    kind = np.uint16 if size < 1 << 16 else np.int32
    for whole in batches:
        for s in range(0, whole.num_rows, SLICE):
            batch = whole.slice(s, SLICE)
            yield batch, [np.frombuffer(x.as_py(), kind) for x in batch.column(column)]


def blocks_of(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers in rows of BLOCK, an empty row after each document; and the number of the
    first row of each document."""
    size = np.array([len(d) for d in docs], np.int64)
    rows = -(-size // BLOCK) + 1
    first = np.cumsum(rows) - rows
    out = np.zeros((int(rows.sum()), BLOCK), np.int32)
    at = np.arange(size.sum()) + np.repeat(first * BLOCK - (np.cumsum(size) - size), size)
    out.reshape(-1)[at] = np.concatenate(docs) if docs else []
    return out, first


def word_weights(words: DataFrame, size: int) -> np.ndarray:
    """Inverse document frequency by word number, over all non-empty blocks of all texts.

    Words that most blocks have weigh next to nothing, so they alone bring no passage near an item.
    """

    def count(batches):
        total = np.zeros(size + 1)
        for _, found in numbers(batches, 0, size - 1):
            ids = np.sort(blocks_of(found)[0], axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = 0  # once a block
            total[:size] += np.bincount(ids.ravel(), minlength=size)
            total[size] += sum(-(-len(d) // BLOCK) for d in found)
        return total

    total = partition_sum(words, count, size + 1)
    weight = np.log((2 + total[size]) / (1 + total[:size]))
    weight[0] = 0
    return weight


def projected(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of the table's rows for the word numbers of each row."""
    out = table.take(ids[:, 0], axis=0)
    for k in range(1, ids.shape[1]):
        out += table.take(ids[:, k], axis=0)
    return out


def passage_norms(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square[:-1] + square[1:])


def add_sketch(total: np.ndarray, ids: np.ndarray, weight: np.ndarray, omega: np.ndarray) -> None:
    """Adds A'A(omega) of the passages of neighbouring rows of ``ids`` to ``total``."""
    if len(ids) < 2:
        return
    norm = passage_norms((weight * weight)[ids].sum(axis=1))
    inverse = np.where(norm > 0, 1 / np.maximum(norm, 1e-12) ** 2, 0).astype(np.float32)[:, None]
    part = projected(ids, omega)
    both = (part[:-1] + part[1:]) * inverse  # a passage's inner product with omega, over its norm twice
    back = np.zeros_like(part)
    back[:-1] += both
    back[1:] += both
    row, place = np.nonzero(ids)
    word = ids[row, place]
    for k, column in enumerate(np.ascontiguousarray(back.T)):
        total[:, k] += np.bincount(word, column.take(row), len(total))


def latent_basis(words: DataFrame, items: list[np.ndarray], weight: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """Leading right singular vectors (words x rank) of the TF-IDF passages of all documents
    and of the items (each a passage, or its pieces)."""
    size = len(weight)
    rank = min(rank, size)
    omega = np.random.default_rng(seed).standard_normal((size, rank))
    lifted = (weight[:, None] * omega).astype(np.float32)

    def sketch(batches):
        out = np.zeros((size, rank))
        for _, found in numbers(batches, 0, size - 1):
            ids, _ = blocks_of(found)
            for s in range(0, len(ids), ROWS):
                add_sketch(out, ids[s : s + ROWS + 1], weight, lifted)
        return out.ravel()

    out = partition_sum(words, sketch, size * rank).reshape(size, rank)
    add_sketch(out, blocks_of(items)[0], weight, lifted)
    out *= weight[:, None]
    small = omega.T @ out
    value, vector = np.linalg.eigh((small + small.T) / 2)
    keep = value > 1e-9 * max(value.max(), 1e-300)
    basis, single, _ = np.linalg.svd(out @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
    return basis[:, single > 1e-6 * max(single.max(initial=0), 1e-300)]


def mask(words: list[int]) -> dict[int, int]:
    """Bit positions of each word."""
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def pieces_of(words: list[int]) -> list[list[int]]:
    """Overlapping pieces of a passage's length that cover a longer text."""
    return [words[k : k + 2 * BLOCK] for k in range(0, len(words) - BLOCK, BLOCK)] if len(words) > 2 * BLOCK else []


def common_length(bits: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of the first text."""
    full = (1 << size) - 1
    row = full
    for w in words:
        m = bits.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


@dataclass
class Index:
    """What a task needs to search the items of a block; items and texts are word numbers."""

    weight: np.ndarray
    basis: np.ndarray
    items: list[tuple[int, list[int]]]
    cosine: float
    latent: float
    strict: float
    loose: float
    answer: float
    own: float
    bits: list[dict[int, int]] = field(default_factory=list)
    telling: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        size, owner, word, value = len(self.weight), [], [], []
        # the items, then the pieces of the long ones
        sought = [(i, words) for i, (_, words) in enumerate(self.items)]
        sought += [(i, piece) for i, words in sought for piece in pieces_of(words)]
        self.item = np.array([i for i, _ in sought])
        self.floor = np.full(len(sought), np.inf)
        inside = np.zeros((len(sought), self.basis.shape[1]), np.float32)
        for k, (i, words) in enumerate(sought):
            ids, times = np.unique(words, return_counts=True)
            v = times * self.weight[ids]
            length = np.linalg.norm(v)
            v /= length
            owner.append(np.full(len(ids), k))
            word.append(ids)
            value.append(v)
            inside[k] = v @ self.basis[ids]
            if len(words) <= 2 * BLOCK:
                self.floor[k] = self.own * length
            if k >= len(self.items):
                continue
            self.bits.append(mask(words))
            distinct = sorted(set(words), key=lambda w: (-self.weight[w], w))
            self.telling.append(distinct[: max(3, math.ceil(len(distinct) / 4))])
        self.inside = inside / np.maximum(np.linalg.norm(inside, axis=1, keepdims=True), 1e-12)
        owner, word, value = map(np.concatenate, (owner, word, value))
        self.square = (self.weight**2).astype(np.float32)
        self.project = (self.weight[:, None] * self.basis).astype(np.float32)
        order = np.argsort(word, kind="stable")
        self.owner, self.value = owner[order], (value * self.weight[word])[order]
        self.count = np.bincount(word, minlength=size)
        self.start = np.cumsum(self.count) - self.count
        self.table = None
        if size * len(sought) <= DENSE:  # then the postings are kept as a full table of words and items
            self.table = np.zeros((size, len(sought)), np.float32)
            self.table[word, owner] = value * self.weight[word]

    def products(self, words: np.ndarray) -> np.ndarray:
        """Exact inner products (block x item or piece) of the blocks' words."""
        if self.table is not None:
            return projected(words, self.table)
        n, row = len(self.item), np.repeat(np.arange(len(words)), BLOCK)
        there = np.flatnonzero(words)
        word, row = words.ravel()[there], row[there]
        c = self.count[word]
        begin = np.cumsum(c) - c
        at = np.repeat(self.start[word] - begin, c) + np.arange(c.sum())
        return np.bincount(np.repeat(row * n, c) + self.owner[at], self.value[at], len(words) * n).reshape(-1, n)

    def _exact(self, ids: np.ndarray, norm: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, item or piece, cosine) of the full TF-IDF space."""
        step, least = max(16, min(2048, (1 << 16) // len(self.item))), self.floor.min()  # small enough for the cache
        for s in range(0, len(norm), step):
            part, size = self.products(ids[s : s + step + 1]), np.maximum(norm[s : s + step], 1e-12)
            near = part[:-1] + part[1:]
            some = np.flatnonzero(near.max(axis=1) >= np.minimum(self.cosine * size, least))
            near, size = near[some], size[some, None]
            passage, sought = np.nonzero((near >= self.cosine * size) | (near >= self.floor))
            yield some[passage] + s, sought, near[passage, sought] / size[passage, 0]

    def _latent(self, ids: np.ndarray, norm: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, item or piece, cosine) of the latent space."""
        step = max(16, min(4096, (1 << 19) // len(self.item)))
        for s in range(0, len(norm), step):
            part = projected(ids[s : s + step + 1], self.project)
            part = part[:-1] + part[1:]
            size = np.sqrt((part * part).sum(axis=1))
            near, least = part @ self.inside.T, self.latent * np.maximum(size, 1e-9)
            some = np.flatnonzero(near.max(axis=1) >= least)
            passage, sought = np.nonzero(near[some] >= least[some, None])
            passage = some[passage]
            yield passage + s, sought, near[passage, sought] / size[passage]

    def candidates(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """(document, first word, item, cosine) of passages near an item."""
        ids, first = blocks_of(docs)
        if len(ids) < 2:
            return
        norm, items = passage_norms(self.square[ids].sum(axis=1)), len(self.items)
        found = [*self._exact(ids, norm), *(self._latent(ids, norm) if self.basis.shape[1] else ())]
        if not found:
            return
        passage, sought, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
        pair = passage * items + self.item[sought]
        order = np.lexsort((-cosine, pair))
        order = order[np.diff(pair[order], prepend=-1) != 0]  # the best of an item and its pieces
        block, item, cosine = passage[order], pair[order] % items, cosine[order]
        doc = np.searchsorted(first, block, side="right") - 1
        yield from zip(doc.tolist(), ((block - first[doc]) * BLOCK).tolist(), item.tolist(), cosine.tolist(), strict=True)

    def hits(self, docs: list[np.ndarray]) -> dict[tuple[int, int], tuple[float, float, float, int]]:
        """By (document, item): best subsequence, answer share, cosine, first word."""
        out: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        here, sets = None, {}
        for doc, start, i, near in self.candidates(docs):
            if here != (doc, start):
                here, sets = (doc, start), {}
            words, telling = self.items[i][1], self.telling[i]
            n = len(words)
            margin = 1 << n.bit_length()
            if margin not in sets:
                sets[margin] = set(docs[doc][max(0, start - margin) : start + 2 * BLOCK + margin].tolist())
            near_by = sets[margin]
            # what the text near by lacks, no subsequence can have
            least = self.loose if len(near_by.intersection(telling)) >= self.answer * len(telling) else self.strict
            if sum(map(near_by.__contains__, words)) < least * n:
                continue
            around = docs[doc][max(0, start - n) : start + 2 * BLOCK + n].tolist()
            if n <= SHORT:
                windows = [around[k : k + 2 * n] for k in range(0, max(1, len(around) - n), max(1, n // 2))]
            else:
                windows = [around]
            for window in windows:
                told = len(set(window).intersection(telling)) / len(telling)
                share = common_length(self.bits[i], n, window) / n
                if share >= (self.loose if told >= self.answer else self.strict):
                    out[doc, i] = max(out.get((doc, i), (-1.0, 0.0, 0.0, 0)), (share, told, near, -start))
        return out


def item_blocks(bench: DataFrame, block: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items with words, ``block`` at a time."""
    bench = bench.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-bench.count() // block))
    for number in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        items = sorted((x["item_id"], w) for x in part.collect() if (w := words_of(x["text"])))
        if items:
            yield items


def prepare(docs: DataFrame, items: list[tuple[int, list[str]]], rank: int = 64, cosine: float = 0.3, latent: float = 0.9, strict: float = 0.8, loose: float = 0.5, answer: float = 0.6, own: float = 0.4) -> tuple[DataFrame, int, Index]:
    """The rows with their word numbers, the place of that column, and the index of the items;
    weights and latent space are taken from all rows."""
    vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
    encoded, name = encode(docs, vocabulary)
    coded = [(i, [vocabulary[w] for w in ws]) for i, ws in items]
    weight = word_weights(encoded.select(name), len(vocabulary) + 1)
    basis = latent_basis(encoded.select(name), [np.array(ws, np.int32) for _, ws in coded], weight, rank)
    return encoded, encoded.columns.index(name), Index(weight, basis, coded, cosine, latent, strict, loose, answer, own)


def find_leaks(docs: DataFrame, bench: DataFrame, block: int = 4096, **options) -> DataFrame:
    """One row per document and item that it holds. ``options``: those of ``prepare``."""
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for items in item_blocks(bench, block):
        encoded, at, one = prepare(docs, items, **options)
        index = spark.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            mine = index.value
            for batch, words in numbers(batches, 1, len(mine.weight) - 1):
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], mine.items[i][0], s, a, c, -at) for (d, i), (s, a, c, at) in mine.hits(words).items()]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in HIT.split(", ")])

        hits = materialise(in_arrow(encoded.select("doc_id", encoded.columns[at]), run, HIT), "hits")
        index.unpersist()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], HIT)
    best = F.max(F.struct("subsequence", "answer", "cosine", (-F.col("start_word")).alias("_at"))).alias("best")
    best = found.groupBy("doc_id", "item_id").agg(best)
    return best.select("doc_id", "item_id", "best.subsequence", "best.answer", "best.cosine", (-F.col("best._at")).alias("start_word"))


def without_leaks(docs: DataFrame, bench: DataFrame, block: int = 4096, **options) -> DataFrame:
    """The rows, all columns, that hold no item: a filter where the rows are read, once for each
    block of items over what the blocks before it left."""
    kept, columns = docs, docs.columns
    for items in item_blocks(bench, block):
        encoded, at, one = prepare(kept, items, **options)
        index = docs.sparkSession.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch], index=index, at=at) -> Iterator[pa.RecordBatch]:
            for batch, words in numbers(batches, at, len(index.value.weight) - 1):
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, _ in index.value.hits(words)]] = False
                yield batch.filter(pa.array(clean)).select(columns)

        kept = in_arrow(encoded, run, docs.schema)
    return kept


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
