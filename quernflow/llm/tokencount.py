"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. Where a trie node cannot go on, the greedy
longest-match pieces of what has been read so far are known beforehand: their number is
popped and matching goes on in the failure node. Each character is read once and no piece
is ever built. Words that come again are counted once a task.

A word is what white space separates, with ``mark`` put in front. A character that is no
piece counts as its UTF-8 bytes (byte fallback). Defined results for odd input: a null or
empty text has no words and no tokens; a null ``doc_id`` stays null; repeated rows are
counted each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernflow.llm.common import in_arrow

#: Remembered words, and the longest word worth remembering.
CACHE, LONG = 400_000, 48
MARK = "▁"


class LongestMatch:
    """Counts the greedy longest-match pieces of a word in time linear in its length."""

    def __init__(self, pieces: Iterable[str], mark: str = MARK) -> None:
        self.mark = mark
        weight: dict[str, int] = {p: 1 for p in pieces if p}
        for c in {c for p in weight for c in p}:
            weight.setdefault(c, len(c.encode()))
        # node 0 is the root; a node has its edges, the pieces popped on failing and where to go on
        self.next: list[dict[str, int]] = [{}]
        cost: list[int] = [0]
        for piece, tokens in sorted(weight.items()):
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    cost.append(0)
                node = self.next[node][c]
            cost[node] = tokens
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [0]
        while level:  # breadth first: a link leads to a shorter string
            below = []
            for parent in level:
                for c, node in self.next[parent].items():
                    below.append(node)
                    if cost[node]:
                        self.fail[node], self.popped[node] = 0, cost[node]
                        continue
                    pops, at = self.popped[parent], self.fail[parent]
                    while at >= 0 and c not in self.next[at]:
                        pops, at = pops + self.popped[at], self.fail[at]
                    # every character is a piece, so the root always has the edge
                    self.fail[node], self.popped[node] = self.next[at][c], pops
            level = below

    def count(self, word: str) -> int:
        edges, fail, popped = self.next, self.fail, self.popped
        node = tokens = 0
        for c in self.mark + word:
            while (ahead := edges[node].get(c)) is None:
                if not node:  # unknown character
                    tokens += len(c.encode())
                    ahead = 0
                    break
                tokens += popped[node]
                node = fail[node]
            node = ahead
        while node:
            tokens += popped[node]
            node = fail[node]
        return tokens


def vocabulary(model: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_words, n_tokens, longest_word_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = LongestMatch(vocabulary(model)), {}
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                new = set(words).difference(known)
                if len(known) + len(new) > CACHE:
                    known, new = {}, set(words)
                for w in new:
                    known[w] = automaton.count(w)
                counts = list(map(known.__getitem__, words))
                rows.append((len(words), sum(counts), max(counts, default=0)))
                for w in new:
                    if len(w) > LONG:
                        del known[w]
            columns = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[:, i]) for i in range(3))], ["doc_id", "n_words", "n_tokens", "longest_word_tokens"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, n_tokens long, longest_word_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
