"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to length one, centred on the corpus mean and turned by a random
rotation; a code is the sign of each coordinate, packed, plus two scalars (the residual's
length and the code's inner product with it). A turned query is rounded to BITS bits a
coordinate, kept as bit planes, so that its inner product with a code is a sum of counts of
common bits; scaled by the scalars that estimates the inner product with the vector, and the
estimate has an error bound of ``epsilon`` standard deviations. Only vectors whose upper bound
reaches the query's k-th best score are scored exactly.

The queries are a written table in files of ``query_rows`` rows. A task takes ``chunk`` rows at a
time, reads their vectors and codes once, and goes through the query files; so neither
the driver nor a task holds more than a file of queries. Every row is compared with every
query by its code: cells (inverted lists) would save most of that where vectors form clusters,
but without such structure reach the wanted recall only if most of them are searched.

Defined results for odd input: null, zero and non-finite vectors and those of another
length than most take no part; rows repeating a ``vec_id`` are not each other's
neighbours, and those that repeat its vector too count once; equal scores go to the smaller ``vec_id``; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernflow.llm.common import in_arrow, materialise, written

#: Bits of a coordinate of a turned query; rows estimated at once.
BITS, TILE = 4, 1024
RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest coordinate first, against overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their largest coordinate, and their squared lengths then."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, (x * x).sum(axis=1)


def packed_words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words; the bits beyond a row's end are zero."""
    data = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(data, ((0, 0), (0, -data.shape[1] % 8)))).view(np.uint64)


def encode(vectors: DataFrame, dim: int, mean: np.ndarray, seed: int) -> DataFrame:
    """Adds bits (packed signs), norm (residual length) and fit (code against residual)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            residual = (unit(_matrix(batch.column(1), dim)) - mean) @ turn
            norm = np.sqrt((residual * residual).sum(axis=1))
            fit = np.abs(residual).sum(axis=1) / np.sqrt(dim) / np.where(norm > 0, norm, 1)
            bits = packed_words(residual > 0)
            packed = pa.array([x.tobytes() for x in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(norm), pa.array(np.where(norm > 0, fit, 1.0))], ["vec_id", "v", "bits", "norm", "fit"])

    return in_arrow(vectors, run, "vec_id long, v array<double>, bits binary, norm double, fit double")


class Best:
    """The k best exact scores of each query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.ident = np.full((queries, k), np.iinfo(np.int64).max)

    def bar(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, ident: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((ident, -score, query))
        query, ident, score = query[order], ident[order], score[order]
        new = np.append(True, (np.diff(query) != 0) | (np.diff(ident) != 0) | (np.diff(score) != 0))[: len(query)]
        query, ident, score = query[new], ident[new], score[new]  # repeated rows count once
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = rank < self.k
        query, ident, score, rank = query[top], ident[top], score[top], rank[top]
        rows = np.unique(query)
        more_s = np.full((len(rows), self.k), -np.inf)
        more_i = np.full((len(rows), self.k), np.iinfo(np.int64).max)
        at = np.searchsorted(rows, query)
        more_s[at, rank], more_i[at, rank] = score, ident
        s = np.concatenate([self.score[rows], more_s], axis=1)
        i = np.concatenate([self.ident[rows], more_i], axis=1)
        order = np.lexsort((i, -s), axis=1)
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        again = np.zeros(s.shape, bool)
        again[:, 1:] = (s[:, 1:] == s[:, :-1]) & (i[:, 1:] == i[:, :-1])
        s, i = np.where(again, -np.inf, s), np.where(again, np.iinfo(np.int64).max, i)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(s, order, 1)
        self.ident[rows] = np.take_along_axis(i, order, 1)


class Queries:
    """A block of queries, turned and rounded."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray, epsilon: float) -> None:
        self.ids, dim = ids, vectors.shape[1]
        self.vectors, self.square = scaled(vectors)
        flat = unit(vectors)
        centred = flat - mean
        turned = centred @ turn
        self.reach = np.sqrt((centred * centred).sum(axis=1)).astype(np.float32)
        self.offset = (flat @ mean).astype(np.float32)
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (2**BITS - 1), 1e-12)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        self.planes = [packed_words(level >> b & 1 == 1) for b in range(BITS)]
        self.low, self.step = low.astype(np.float32), step.astype(np.float32)
        self.total = (dim * low + step * level.sum(axis=1)).astype(np.float32)
        # squared deviations: of the estimate, and of what rounding the query brings
        self.noise = np.stack([self.reach**2, (epsilon * step) ** 2 * dim / 12]).astype(np.float32)

    def products(self, codes: np.ndarray) -> np.ndarray:
        """Inner products (row x query) of sign codes and rounded queries, by counts of common bits."""
        common = np.zeros((len(codes), len(self.ids)), np.float32)
        for b, plane in enumerate(self.planes):
            count = np.bitwise_count(codes[:, 0, None] & plane[None, :, 0])
            for w in range(1, codes.shape[1]):
                count = count.astype(np.uint16) + np.bitwise_count(codes[:, w, None] & plane[None, :, w])
            common += count * np.float32(1 << b)
        ones = np.bitwise_count(codes).sum(axis=1).astype(np.float32)
        return 2 * (ones[:, None] * self.low[None, :] + common * self.step[None, :]) - self.total[None, :]


class Rows:
    """A chunk of rows with their codes."""

    def __init__(self, table: pa.Table, mean: np.ndarray, dim: int, epsilon: float) -> None:
        self.ids = table.column(0).to_numpy()
        vectors = _matrix(table.column(1).combine_chunks(), dim)
        self.vectors, self.square = scaled(vectors)
        self.codes = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint64).reshape(len(self.ids), -1)
        norm, fit = (table.column(i).to_numpy().astype(np.float32) for i in (3, 4))
        self.scale = norm / fit / np.float32(np.sqrt(dim))
        self.along = (unit(vectors) @ mean - mean @ mean).astype(np.float32)  # <vector - mean, mean>
        spread = epsilon * norm * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit / np.sqrt(max(1, dim - 1))
        self.noise = np.stack([spread**2, self.scale**2], axis=1).astype(np.float32)


def search(rows: Rows, asked: Queries, k: int) -> Best:
    """The k best of the rows for each query."""
    best = Best(len(asked.ids), k)
    for s in range(0, len(rows.ids), TILE):
        part = slice(s, s + TILE)
        # <q, x> = <q - m, x - m> + <m, x - m> + <q, m>
        guess = asked.products(rows.codes[part]) * rows.scale[part, None] + rows.along[part, None] + asked.offset[None, :]
        slack = np.sqrt(rows.noise[part] @ asked.noise) + np.float32(1e-5)
        other = rows.ids[part, None] != asked.ids[None, :]
        bar = best.bar()
        if np.isinf(bar).any():  # lower bounds of this part give a first bar
            # rows that repeat an id and a vector have one place, as in Best
            _, first = np.unique(np.column_stack([rows.ids[part], (rows.vectors[part] + 0.0).view(np.int64)]), axis=0, return_index=True)
            own = np.where(other, guess - slack, -np.inf)[first]
            if own.shape[0] > k:
                bar = np.maximum(bar, np.partition(own, -k, axis=0)[-k])
        row, query = np.nonzero((guess + slack >= bar[None, :]) & other)
        for c in range(0, len(row), 1 << 16):
            r, q = row[c : c + (1 << 16)] + s, query[c : c + (1 << 16)]
            # row by row, so that equal rows have equal scores wherever they stand
            score = (asked.vectors[q] * rows.vectors[r]).sum(axis=1) / np.sqrt(asked.square[q] * rows.square[r])
            best.add(q, rows.ids[r], score)
    return best


def _search_task(path: str, mean: np.ndarray, dim: int, seed: int, k: int, epsilon: float, query_rows: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        store, root = fs.FileSystem.from_uri(path)
        files = sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet"))
        for table in chunks(batches, chunk):
            rows = Rows(table, mean, dim, epsilon)
            for file in files:
                for block in pq.ParquetFile(file, filesystem=store).iter_batches(query_rows, columns=["vec_id", "v"]):
                    asked = Queries(block.column(0).to_numpy(), _matrix(block.column(1), dim), mean, turn, epsilon)
                    best = search(rows, asked, k)
                    query, rank = np.nonzero(np.isfinite(best.score))
                    yield pa.RecordBatch.from_arrays([pa.array(asked.ids[query]), pa.array(best.ident[query, rank]), pa.array(best.score[query, rank])], ["query_id", "vec_id", "score"])

    return run


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches put together to tables of about so many rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, epsilon: float = 1.4, seed: int = 20240501, query_rows: int = 2048, chunk: int = 1 << 15) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths["dim"]
    rows = rows.where(F.size("v") == dim)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            if batch.num_rows:
                total, n = total + unit(_matrix(batch.column(1), dim)).sum(axis=0), n + batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total), pa.array(np.full(dim, float(n)))], ["i", "s", "n"])

    parts = in_arrow(rows, sums, "i long, s double, n double").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    mean = np.array([x["s"] / x["n"] for x in parts])
    codes = materialise(encode(rows, dim, mean, seed), "codes")
    asked = codes.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    _, path = written(asked.repartition(max(1, -(-asked.count() // query_rows))), "queries")
    found = in_arrow(codes, _search_task(path, mean, dim, seed, k, epsilon, query_rows, chunk), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
