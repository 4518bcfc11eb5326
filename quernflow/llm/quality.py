"""Quality classifier: ridge regression on random Fourier features of document statistics.

Statistics of every whole text are standardised, mapped through ``features`` random
cosines (a Gaussian kernel in expectation) and fitted to the labels by normal equations
that each partition sums for itself. Isotonic regression over fine bins of the training
scores turns the ridge score into a probability. Statistics beyond six deviations count as six
deviations, and ridge scores below -0.5 or above 1.5 as these, in fitting and scoring alike.

Defined results for odd input: a null or empty text has all statistics zero and is scored
like any other; labels that are null are not learned from; a document with several labels
is learned from with each; with no label to learn from every score is 0.5; repeated rows
are scored each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernflow.llm.common import held_out, in_arrow, materialise, partition_sum

UPPER, DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
LETTER = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
SPACE, MARK = b" \t\n\x0b\x0c\r", b".,;:'\"()-?!"
SYMBOL = bytes(set(range(33, 127)) - set(LETTER) - set(DIGIT) - set(MARK))
STATS = 20


def _share(data: bytes, kind: bytes) -> float:
    return (len(data) - len(data.translate(None, kind))) / len(data)


def statistics(text: str | None) -> list[float]:
    """Twenty language-free figures of a whole text."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * STATS
    n, lines = len(words), data.split(b"\n")
    counts = Counter(words)
    filled = [x for x in lines if x.strip()]
    often = counts.most_common(1)[0][1]
    entropy = -sum(c * math.log(c / n) for c in counts.values()) / n
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n
    lead = Counter(x.split(None, 1)[0] for x in filled)
    return [
        math.log1p(len(data)),
        math.log1p(n),
        mean,
        math.sqrt(sum(s * s for s in sizes) / n - mean * mean + 1e-12),
        max(sizes) ** 0.5,
        _share(data, UPPER),
        _share(data, DIGIT),
        _share(data, LETTER),
        _share(data, MARK),
        _share(data, SYMBOL),
        data.count(b"!") / n,
        data.count(b"|") / n,
        sum(w[-1:].isalnum() or w[-1] > 127 for w in words) / n,
        len(counts) / n,
        often / n,
        entropy / math.log(n + 1),
        math.log1p(len(data) / len(lines)),
        len(set(filled)) / max(1, len(filled)),
        lead.most_common(1)[0][1] / len(filled),
        sum(x.rstrip()[-1:] in (b".", b"?", b"!") for x in filled) / len(filled),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array<double>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(x.as_py()) for x in batch.column(1)], pa.list_(pa.float64()))], ["doc_id", "stats"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, stats array<double>")


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to ``value`` in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


@dataclass
class QualityModel:
    """Everything a task needs to score; its size depends on ``features`` alone."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weight: np.ndarray | None = None
    knots: np.ndarray | None = None
    level: np.ndarray | None = None

    def lift(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.turn + self.shift) * math.sqrt(2 / len(self.shift))
        return np.concatenate([np.ones((len(z), 1)), z / math.sqrt(z.shape[1]), waves], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.knots, self.level), 0, 1)


def _stats(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(-1, STATS)


def fit(labelled: DataFrame, features: int = 256, ridge: float = 1e-4, bins: int = 2048, seed: int = 11) -> QualityModel | None:
    """``labelled``: stats, label (0 or 1); it is read three times."""

    def moments(batches):
        total = np.zeros(2 * STATS + 1)
        for b in batches:
            x = _stats(b)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        return total

    sums = partition_sum(labelled, moments, 2 * STATS + 1)
    n = sums[0]
    if not n:
        return None
    mean = sums[1 : STATS + 1] / n
    scale = np.sqrt(np.maximum(sums[STATS + 1 :] / n - mean * mean, 0))
    draw = np.random.default_rng(seed)
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), draw.standard_normal((STATS, features)) / math.sqrt(STATS), draw.uniform(0, 2 * math.pi, features))
    width = 1 + STATS + features

    def equations(batches):
        total = np.zeros((width, width + 1))
        for b in batches:
            x = model.lift(_stats(b))
            total += x.T @ np.concatenate([x, b.column(b.schema.get_field_index("label")).to_numpy()[:, None]], axis=1)
        return total.ravel()

    total = partition_sum(labelled, equations, width * (width + 1)).reshape(width, width + 1)
    model.weight = np.linalg.solve(total[:, :width] + ridge * n * np.eye(width), total[:, width])

    def histogram(batches):
        count, ones = np.zeros(bins), np.zeros(bins)
        for b in batches:
            at = np.clip(((model.raw(_stats(b)) + 0.5) / 2 * bins).astype(int), 0, bins - 1)
            np.add.at(count, at, 1)
            np.add.at(ones, at, b.column(b.schema.get_field_index("label")).to_numpy())
        return np.concatenate([count, ones])

    count, ones = np.split(partition_sum(labelled, histogram, 2 * bins), 2)
    full = np.flatnonzero(count)
    centre = (full + 0.5) / bins * 2 - 0.5
    level = pool_adjacent((ones[full] + 0.02) / (count[full] + 0.04), count[full])
    edges = np.flatnonzero(np.concatenate([[True], np.diff(level) != 0]))
    ends = np.append(edges[1:], len(level))
    model.knots = np.array([np.average(centre[a:b], weights=count[full][a:b]) for a, b in zip(edges, ends, strict=True)])
    model.level = level[edges]
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score of every document; ``labels``: doc_id, quality."""
    stats = materialise(document_statistics(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    known = known.where("label IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    labelled = materialise(stats.join(known, "doc_id").select("stats", "label"), "labelled")
    model = fit(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(_stats(b)) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    scored = in_arrow(stats, run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")


def op9_quality(spark: SparkSession, sf_dir: str, cut: float = 0.3) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_documents(docs, labels).withColumn("predicted", (F.col("score") >= cut).cast("int"))
