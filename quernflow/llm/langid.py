"""Language identification by a linear-chain conditional random field over words.

Each word has hashed features (the word, affixes, character n-grams, membership of the
learned lexicons) that give it a score a language; learned transitions tie neighbours
together, so code-switched text changes language where the words do. Forward-backward
gives each word a distribution; a document's language is that with the largest share.

The field is fitted on the driver on a bounded sample: at most ``rows_per_lang`` documents of
each language, picked by a hash of the id, about ``most_chars`` characters of each (longer
texts give runs of words from all over), and at most ``words_per_lang`` words of them in runs
of 8 to 31 words. Training sequences splice runs from
different documents, so the transitions see changes of language. ``most_langs`` bounds the
languages that are learned, the most frequent first.

Every letter is read: a run of over LETTERS letters, as in scripts without blanks, is a
sequence of words of so many letters. A text of over CHUNK words is labelled in parts of
so many, each a sequence of its own, and the parts' shares are weighted by their words;
memory is bounded by a part.

Defined results for odd input: a null text or one without a letter is ``und`` with score
0; rows with null ``lang`` or ``doc_id`` are not learned from; with nothing to learn from
all are ``und``; repeated rows are labelled each for itself; equal shares go to the
language that sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernflow.llm.common import held_out, in_arrow

LETTERS = 32
WORD = re.compile(rf"[^\W\d_]{{1,{LETTERS}}}")
UNKNOWN = "und"
BITS = 17
BUCKETS = 1 << BITS
#: Remembered words, and padded words labelled at once.
CACHE, PADDED = 300_000, 1 << 18
#: Words of a text labelled as one sequence; characters of a text that are split at once.
CHUNK, SLICE = 1 << 15, 1 << 20


def words_of(text: str | None) -> list[str]:
    """Runs of up to LETTERS letters, lower-cased. Numerals that are no digits are word characters, but no letters."""
    lower = (text or "").lower()
    words = WORD.findall(lower)
    if lower.isascii() or all(map(str.isalpha, words)):
        return words
    return ["".join(run) for w in words for letters, run in groupby(w, str.isalpha) if letters]


def parts_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text in lists of at most CHUNK; long texts are split slice by slice, at white space if there is any."""
    text, at, held = text or "", 0, []
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            blank = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = blank if blank > at else end
        held += words_of(text[at:end])
        while len(held) >= CHUNK:
            yield held[:CHUNK]
            held = held[CHUNK:]
        at = end
    if held:
        yield held


def _bucket(kind: int, value: np.ndarray) -> np.ndarray:
    """A bucket for each value; values of different kinds are mixed differently."""
    mixed = (value + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int32)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the words' features, all words at once.

    The word, its first 1 to 3 and last 1 to 4 characters, its 1- to 3-grams with the ends
    marked, and its lexicon.
    """
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    last = np.cumsum(size + 2) - 1  # the closing mark of each word
    first = last - size - 1
    number = np.repeat(np.arange(len(words), dtype=np.int32), size + 2)
    place = np.arange(len(code)) - first[number]
    step = np.uint64(1_000_003)
    power = step ** np.arange(int(size.max()) + 2, dtype=np.uint64)
    owners, buckets = [np.arange(len(words), dtype=np.int32)], [_bucket(1, np.add.reduceat(code * power[place], first))]
    gram = np.zeros(len(code), np.uint64)
    for k in (1, 2, 3, 4):
        # gram[i] becomes the hash of the k characters that end at i
        gram = np.concatenate([np.zeros(1, np.uint64), gram[:-1]]) * step + code if k > 1 else code.copy()
        there = np.flatnonzero(size >= k).astype(np.int32)
        if k <= 3:
            inside = np.flatnonzero(place >= k - 1)
            owners += [number[inside], there]
            buckets += [_bucket(10 + k, gram[inside]), _bucket(20 + k, gram[first[there] + k])]
        owners.append(there)
        buckets.append(_bucket(30 + k, gram[last[there] - 1]))
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if known:
        at, lang = np.array(known, np.int32).T
        owners.append(at)
        buckets.append(_bucket(2, lang.astype(np.uint64)))
    return np.concatenate(owners), np.concatenate(buckets)


def learn_lexicon(texts: list[list[str]], labels: np.ndarray, langs: int, size: int = 400) -> dict[str, int]:
    """Frequent words of one language that the others hardly use."""
    counts = [Counter() for _ in range(langs)]
    for ws, y in zip(texts, labels, strict=True):
        counts[y].update(ws)
    total = np.array([max(1, sum(c.values())) for c in counts], float)
    lexicon = {}
    for y, c in enumerate(counts):
        for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: 4 * size]:
            share = np.array([k[w] for k in counts]) / total
            if n >= 5 and share[y] >= 0.8 * share.sum():
                lexicon[w] = y
    return lexicon


@dataclass
class Field:
    langs: list[str]
    lexicon: dict[str, int]
    weight: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each language for each word."""
        owner, bucket = features(words, self.lexicon)
        return np.stack([np.bincount(owner, self.weight[bucket, c], len(words)) for c in range(len(self.langs))], axis=1)


def posteriors(emit: np.ndarray, alive: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences sorted by falling length.

    ``emit``: exponentials of scores, time x sequence x language; ``alive[t]``: how many
    sequences reach time t. Returns the word distributions (zero past the end) and the
    expected transitions, summed.
    """
    steps, n, langs = emit.shape
    move = np.exp(step)
    forward = np.zeros_like(emit)
    forward[0] = emit[0] * np.exp(start)
    forward[0] /= forward[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = alive[t]
        x = (forward[t - 1, :a] @ move) * emit[t, :a]
        forward[t, :a] = x / x.sum(axis=1, keepdims=True)
    back, moves = np.ones((n, langs)), np.zeros((langs, langs))
    for t in range(steps - 1, 0, -1):
        a = alive[t]
        ahead = emit[t, :a] * back[:a]
        x = ahead @ move.T
        scale = (forward[t - 1, :a] * x).sum(axis=1, keepdims=True)
        moves += (forward[t - 1, :a] / scale).T @ ahead * move
        forward[t, :a] *= back[:a]
        back[:a] = x / x.sum(axis=1, keepdims=True)
    forward[0] *= back
    forward /= np.maximum(forward.sum(axis=2, keepdims=True), 1e-300)
    return forward, moves


def fit(texts: list[list[str]], labels: list[str], words_per_lang: int = 40_000, rounds: int = 30, length: int = 64, seed: int = 5) -> Field:
    """Adam on the penalised likelihood of spliced sequences."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    lexicon = learn_lexicon(texts, y, len(langs))
    draw = np.random.default_rng(seed)
    runs = []  # (words, label) of 8 to 31 words each
    for ws, label in zip(texts, y, strict=True):
        at = 0
        while at < len(ws):
            n = int(draw.integers(8, 32))
            runs.append((ws[at : at + n], label))
            at += n
    order, taken, chosen = draw.permutation(len(runs)), Counter(), []
    for i in order:
        if taken[runs[i][1]] < words_per_lang:
            taken[runs[i][1]] += len(runs[i][0])
            chosen.append(runs[i])
    kinds = sorted({w for ws, _ in chosen for w in ws})
    index = {w: i for i, w in enumerate(kinds)}
    word = np.array([index[w] for ws, _ in chosen for w in ws], np.int32)
    truth = np.array([label for ws, label in chosen for _ in ws], np.int32)
    pad = -len(word) % length
    word, truth = np.append(word, word[:1].repeat(pad)), np.append(truth, truth[:1].repeat(pad))
    word, truth = word.reshape(-1, length).T, truth.reshape(-1, length).T  # time x sequence
    owner, flat = features(kinds, lexicon)
    used, local = np.unique(flat, return_inverse=True)
    k, alive = len(langs), np.full(length, word.shape[1])
    gold = np.eye(k)[truth]
    gold_moves = np.einsum("tni,tnj->ij", gold[:-1], gold[1:])
    params = [np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)]
    first_moment, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        scores = np.stack([np.bincount(owner, params[0][local, c], len(kinds)) for c in range(k)], axis=1)
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        post, moves = posteriors(scores[word], alive, params[1], params[2])
        gap = (post - gold).reshape(-1, k)
        by_kind = np.stack([np.bincount(word.ravel(), gap[:, c], len(kinds)) for c in range(k)], axis=1)
        by_bucket = np.stack([np.bincount(local, by_kind[owner, c], len(used)) for c in range(k)], axis=1)
        for i, grad in enumerate((by_bucket, moves - gold_moves, (post[0] - gold[0]).sum(axis=0))):
            grad = grad + (0.05 if i == 0 else 1.0) * params[i]
            first_moment[i] = 0.9 * first_moment[i] + 0.1 * grad
            second[i] = 0.99 * second[i] + 0.01 * grad * grad
            params[i] -= 0.15 * (first_moment[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
    weight = np.zeros((BUCKETS, k))
    weight[used] = params[0]
    return Field(langs, lexicon, weight, params[1], params[2])


class Labeller:
    """Language shares of whole documents; words that come again are scored once."""

    def __init__(self, field: Field) -> None:
        self.field, self.index = field, {}
        self.emit = np.zeros((CACHE, len(field.langs)))

    def _indices(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            at, scores = len(self.index), self.field.emissions(new)
            while at + len(new) > len(self.emit):
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
            self.emit[at : at + len(new)] = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))

    def shares(self, texts: Iterator[str | None]) -> np.ndarray:
        """One row a text: the mean of its words' distributions; zero without words."""
        if len(self.index) > CACHE:
            self.index, self.emit = {}, self.emit[:CACHE]
        docs, owner, rows = [], [], 0
        for x in texts:
            docs += [self._indices(part) for part in parts_of(x)]
            owner += [rows] * (len(docs) - len(owner))
            rows += 1
        size, owner = np.array([len(x) for x in docs], np.int64), np.array(owner, np.int64)
        order = np.argsort(-size, kind="stable")
        out, s = np.zeros((rows, len(self.field.langs))), 0
        while s < len(order):
            longest = size[order[s]]
            part = order[s : s + max(1, PADDED // longest)]
            n = size[part]
            word = np.zeros((len(part), longest), np.int32)
            for i, doc in enumerate(part):
                word[i, : n[i]] = docs[doc]
            alive = np.searchsorted(-n, -np.arange(longest), side="left")
            post, _ = posteriors(self.emit[word.T], alive, self.field.step, self.field.start)
            there = np.arange(longest)[:, None] < n[None, :]
            np.add.at(out, owner[part], (post * there[:, :, None]).sum(axis=0))
            s += len(part)
        return out / np.maximum(np.bincount(owner, size, rows), 1)[:, None]


def excerpt(text: str, most_chars: int, run: int = 32) -> str:
    """A text of up to ``most_chars`` as it is, of a longer one about so much: runs of words,
    evenly spaced from its start to its end."""
    if len(text) <= most_chars:
        return text
    words = words_of(text)
    runs = int(most_chars / (sum(map(len, words)) + len(words) + 1) * len(words) / run)
    if runs * run >= len(words):
        return " ".join(words)
    starts = np.linspace(0, max(0, len(words) - run), max(1, runs)).astype(int).tolist()
    return " ".join(w for s in starts for w in words[s : s + run])


def sample(docs: DataFrame, rows_per_lang: int, most_chars: int, most_langs: int) -> DataFrame:
    """text, lang of at most so many learnable documents a language, for the most frequent
    languages; long texts by an excerpt."""
    known = docs.where(~held_out(F.col("doc_id"))).where("lang IS NOT NULL AND text IS NOT NULL")
    langs = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).select("lang")
    known = known.join(F.broadcast(langs), "lang", "left_semi")  # at most most_langs rows
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.select("doc_id", "lang").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows_per_lang)
    # at most rows_per_lang rows a language and most_langs languages, which bounds what is broadcast
    chosen = known.select("doc_id", "lang", "text").join(F.broadcast(picked.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi").select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [excerpt(x.as_py(), most_chars) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1)], ["text", "lang"])

    return in_arrow(chosen, run, chosen.schema)


def train(docs: DataFrame, rows_per_lang: int = 150, most_chars: int = 20_000, most_langs: int = 256) -> Field | None:
    rows = [(words_of(x["text"]), x["lang"]) for x in sample(docs, rows_per_lang, most_chars, most_langs).collect()]
    rows = sorted((w, y) for w, y in rows if w)
    return fit([w for w, _ in rows], [y for _, y in rows]) if rows else None


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, lang_pred, score of every row, from the text alone."""
    model = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        labeller = Labeller(field) if field else None
        for whole in batches:
            for s in range(0, whole.num_rows, 2048):
                batch = whole.slice(s, 2048)
                if field:
                    share = labeller.shares(x.as_py() for x in batch.column(1))
                    top = share.argmax(axis=1)
                    score = np.clip(share[np.arange(len(top)), top], 0, 1)
                    lang = [field.langs[i] if p > 0 else UNKNOWN for i, p in zip(top, score, strict=True)]
                else:
                    score, lang = np.zeros(batch.num_rows), [UNKNOWN] * batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, field: Field | None, least: float) -> DataFrame:
    """The rows, all columns, whose text is in one language by a share of at least ``least``.

    A filter where the rows are read: nothing is shuffled or joined.
    """
    model, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model.value) if model.value else None
        for whole in batches:
            for s in range(0, whole.num_rows, 2048):
                batch = whole.slice(s, 2048)
                share = labeller.shares(x.as_py() for x in batch.column(at)).max(axis=1) if labeller else np.zeros(batch.num_rows)
                yield batch.filter(pa.array(share >= max(least, 1e-9)))

    return in_arrow(docs, run, docs.schema)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
