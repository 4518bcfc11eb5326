"""License scans by patience alignment.

Text and template are aligned on the words that are unique in both: the longest increasing
run of such anchors is kept and the gaps between them are aligned in the same way. A gap
without anchors is aligned by its common ends and, between those, by the longest common
subsequence. Coverage is the share of the template's words that are aligned, density the
share of the words between the first and the last aligned word; a hit has both at
``least`` or more.

A template can only be covered if the text has one of its *gate* words: so many of its
longest words that without them too few words remain. Texts are searched around each gate
word, all of them, whatever the text's length. An unchanged copy is always covered fully; where
words of the template also stand right beside an edited copy, patience may align fewer words
than the longest common subsequence would.

Defined results for odd input: a null or empty text has no hits; copies of a notice in one
text are hits of their own; of overlapping hits the one with more aligned words stays, ties to
the higher coverage and then the template named first; repeated rows are scanned each for itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernflow.llm.common import in_arrow
from quernflow.llm.license_texts import TEMPLATES

WORD = re.compile(r"\w+")
HIT = "doc_id long, license string, start_word long, n_words long, matched_words long, coverage double"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, in which the second rises too."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[k], ends[k] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by the usual table."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list[str], b: list[str], at: int = 0, bt: int = 0, outer: bool = True) -> list[tuple[int, int]]:
    """Aligned index pairs (into a and b), in order.

    What stands before the first anchor of the whole text is aligned from its end, so that
    the pairs lie as close together as they can.
    """
    if not a or not b:
        return []
    count_a, count_b = Counter(a), Counter(b)
    place = {w: j for j, w in enumerate(b) if count_b[w] == 1}
    anchors = increasing([(i, place[w]) for i, w in enumerate(a) if count_a[w] == 1 and w in place])
    if not anchors:
        head = 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            head += 1
        tail = 0
        while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        out = [(at + k, bt + k) for k in range(head)]
        middle_a, middle_b = a[head : len(a) - tail], b[head : len(b) - tail]
        if head or tail:
            out += patience(middle_a, middle_b, at + head, bt + head, False)
        else:
            out += [(at + i, bt + j) for i, j in common_subsequence(middle_a, middle_b)]
        return out + [(at + len(a) - k, bt + len(b) - k) for k in range(tail, 0, -1)]
    out, i, j = [], 0, 0
    for x, y in [*anchors, (len(a), len(b))]:
        if outer and not i:
            out += [(at + x - 1 - k, bt + y - 1 - m) for k, m in reversed(patience(a[:x][::-1], b[:y][::-1], outer=False))]
        else:
            out += patience(a[i:x], b[j:y], at + i, bt + j, False)
        if x < len(a):
            out.append((at + x, bt + y))
        i, j = x + 1, y + 1
    return out


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    gates: dict[str, tuple[int, ...]]
    bag: Counter

    @classmethod
    def of(cls, name: str, text: str, least: float) -> Template:
        words = words_of(text)
        spare = len(words) - -int(-len(words) * least // 1)  # words that may be missing
        places = defaultdict(list)
        for i, w in enumerate(words):
            places[w].append(i)
        gates, covered = {}, 0
        for w in sorted(places, key=lambda w: (-len(w), w)):
            if covered > spare:
                break
            gates[w] = tuple(places[w])
            covered += len(places[w])
        return cls(name, tuple(words), gates, Counter(words))


class Scanner:
    """Finds the templates in lists of words."""

    def __init__(self, templates: dict[str, str], least: float = 0.8) -> None:
        self.templates = [Template.of(n, t, least) for n, t in templates.items()]
        self.gates = frozenset(w for t in self.templates for w in t.gates)
        self.least = least

    def _around(self, words: list[str], template: Template, at: int, place: int) -> tuple[int, int, int] | None:
        """(start, end, aligned words) of a hit near word ``at``, taken for the template's word ``place``."""
        size = len(template.words)
        slack = int(size * (1 / self.least - 1)) + 1
        lo, hi = max(0, at - place - slack), min(len(words), at - place + size + slack)
        if (Counter(words[lo:hi]) & template.bag).total() < self.least * size:
            return None  # no alignment can cover enough
        pairs = patience(words[lo:hi], list(template.words))
        # words aligned far outside the dense part only stretch the hit: take the best stretch
        best = None
        for i in range(len(pairs)):
            for j in range(len(pairs) - 1, i - 1, -1):
                n = j - i + 1
                if n < self.least * size or (best and n <= best[2]):
                    break
                if n >= self.least * (pairs[j][0] - pairs[i][0] + 1):
                    best = (lo + pairs[i][0], lo + pairs[j][0] + 1, n)
                    break
        return best

    def scan(self, words: list[str]) -> list[tuple[str, int, int, int, float]]:
        """(template, start, words, aligned, coverage) of the hits, by start."""
        if self.gates.isdisjoint(words):
            return []
        found = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.gates:
                found[w].append(i)
        hits = []
        for rank, template in enumerate(self.templates):
            # each gate word in the text may stand for each of its places in the template
            starts = {i - p: (i, p) for w, places in template.gates.items() for i in found.get(w, ()) for p in places}
            done: set[int] = set()
            for start in sorted(starts):
                if start in done:
                    continue
                hit = self._around(words, template, *starts[start])
                if hit:
                    hits.append((-hit[2], len(template.words), rank, hit[0], hit[1]))
                    if hit[2] == len(template.words):
                        done.update(range(hit[0], hit[1]))
        out, taken = [], set()
        for aligned, _, rank, start, end in sorted(hits):
            if taken.isdisjoint(range(start, end)):
                taken.update(range(start, end))
                template = self.templates[rank]
                out.append((template.name, start, end - start, -aligned, -aligned / len(template.words)))
        return sorted(out, key=lambda x: x[1])


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row per hit; documents without a notice have none."""
    wanted = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted, least)
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in scanner.scan(words_of(text.as_py()))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in HIT.split(", ")])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, HIT)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
