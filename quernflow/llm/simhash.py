"""SimHash near-dedup by a binary-trie self-join.

A fingerprint has ``words`` times 64 bits over word shingles. Distinct fingerprints are dealt
into groups; inside a group the trie join finds the pairs within the bit budget and sends on
only a spanning forest of them. Components join the forests.

``near_duplicates`` (one word, three bands, two bits): codes meet in groups that share a
*band*, a third of the bits; two differing bits leave one band equal, so no link is lost.

``one_of_each`` (512 bits): similarity 0.8 means some 78 differing bits, for which no band need
be equal. Codes meet in ``trees``, each by ``width`` bits drawn at random; width grows with the
corpus so that groups keep about ``GROUP`` codes, and the number of trees with it, so that a
pair at 0.8 misses all of them with a probability of MISS (at ERROR, a little over the share of
bits that differ at 0.8). In a group the trie runs over 128 other bits, where a pair is dropped
as soon as its prefix differs in more bits than a pair at ERROR does but in one of thousands.
Links are candidates only: the similarity of the shingle sets is checked exactly.

A group of over ``group_rows`` fingerprints is dealt into chunks; each pair of chunks is a
group of its own, so no task holds more than two chunks of one group.

Defined results for odd input: a null text is empty; a text without words has fingerprint
zero and links like any other; equal fingerprints share a component; a row without
``doc_id`` has the component of its fingerprint, null if no row with an id has it. Rows
that repeat a ``doc_id`` are the same document to ``near_duplicates``, each with its own
fingerprint, which ties these together; to ``one_of_each`` they are rows of their own, of
which exact repeats go and different texts stay. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernflow.llm.common import hot_join, in_arrow, materialise, ship
from quernflow.llm.components import connected_components
from quernflow.llm.trie import Forest, close_pairs

SEED = 42
SLICE = 1 << 15
#: Codes a group of the trees has on average; share of differing bits and of lost pairs that the trees are laid out for.
GROUP, ERROR, MISS = 256, 0.17, 1e-3


def shingles(text: str | None, size: int) -> list[bytes]:
    """Space-joined word shingles of the ASCII-lower-cased text, repeats included."""
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    return [joined[a : b - 1] for a, b in zip([0, *ends[: len(words) - size]], ends[size - 1 :], strict=True)]


def digests(parts: list[bytes], words: int) -> np.ndarray:
    """Hash bytes, a row a shingle: XXH64 for one word, else XXH3 with 128 bits a seed."""
    if words == 1:
        digest = xxhash.xxh64_digest
        data = b"".join([digest(x, SEED) for x in parts])
    else:
        digest = xxhash.xxh3_128_digest
        data = b"".join([digest(x, seed) for x in parts for seed in range(SEED, SEED + words // 2)])
    return np.frombuffer(data, np.uint8).reshape(len(parts), 8 * words)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the hashes, as big-endian 64-bit words."""
    total = np.zeros(8 * hashes.shape[1], np.int64)
    for s in range(0, len(hashes), SLICE):
        bits = np.unpackbits(hashes[s : s + SLICE], axis=1).view(np.uint64)  # byte-wide counters, added eight at a time
        for k in range(0, len(bits), 255):
            total += bits[k : k + 255].sum(axis=0).view(np.uint8)
    return np.packbits(total * 2 > len(hashes)).view(">u8")


def fingerprint(text: str | None, size: int, words: int = 1, once: bool = False) -> np.ndarray:
    """``words``: one, or an even number; ``once``: each distinct shingle counts once."""
    parts = shingles(text, size)
    parts = list(dict.fromkeys(parts)) if once else parts
    return majority(digests(parts, words)) if parts else np.zeros(words, ">u8")


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1, once: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, w0, w1, ... (the fingerprint's 64-bit words as signed longs) and the carried columns."""
    names = [f"w{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(x.as_py(), size, words, once) for x in batch.column(1)], np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(codes[:, i])) for i in range(words)), *batch.columns[2:]], ["doc_id", *names, *carried])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    kinds = dict(docs.dtypes)
    schema = "doc_id long, " + ", ".join([f"{n} long" for n in names] + [f"{c} {kinds[c]}" for c in carried])
    return in_arrow(docs, run, schema)


def bands(codes: DataFrame, count: int) -> tuple[DataFrame, int]:
    """key, node, c0: one-word codes once for each band, turned so that it comes first; and the
    number of leading bits that a group shares."""
    edges = [round(64 * i / count) for i in range(count + 1)]
    parts = []
    for band, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        turned = F.shiftleft("w0", a).bitwiseOR(F.shiftrightunsigned("w0", 64 - a)) if a else F.col("w0")
        value = F.shiftrightunsigned(turned, 64 - (b - a))
        parts.append(F.struct(F.shiftleft(F.lit(band).cast("long"), 48).bitwiseOR(value).alias("key"), turned.alias("c0")))
    dealt = codes.select("node", F.explode(F.array(*parts)).alias("b")).select("b.key", "node", "b.c0")
    return dealt, min(b - a for a, b in zip(edges, edges[1:], strict=False))


def tree_layout(words: int, width: int, seed: int = 17) -> list[tuple[np.ndarray, int, int]]:
    """For each tree the bits that deal its groups, and two words of other bits for its trie."""
    draw = np.random.default_rng(seed)
    count = math.ceil(math.log(MISS) / math.log1p(-((1 - ERROR) ** width)))
    out = []
    for t in range(count):
        one, two = t % words, (t + 1 + t // words % (words - 1)) % words
        other = [i for i in range(64 * words) if i >> 6 not in (one, two)]
        out.append((np.sort(draw.choice(other, width, replace=False)), one, two))
    return out


def trees(codes: DataFrame, words: int, rows: int) -> tuple[DataFrame, int]:
    """key, node, c0, c1: codes once for each tree; and the number of trees."""
    width = max(8, math.ceil(math.log2(max(1, rows / GROUP))))
    layout = tree_layout(words, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.stack([batch.column(i + 1).to_numpy() for i in range(words)], axis=1)
            bits = np.unpackbits(code.view(np.uint64).astype(">u8").view(np.uint8).reshape(len(code), -1), axis=1)
            for t, (picked, one, two) in enumerate(layout):
                key = np.full(len(code), t, np.int64)
                for b in picked:
                    key = key << 1 | bits[:, b]
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), pa.array(np.ascontiguousarray(code[:, one])), pa.array(np.ascontiguousarray(code[:, two]))], ["key", "node", "c0", "c1"])

    dealt = in_arrow(codes.select("node", *[f"w{i}" for i in range(words)]), run, "key long, node long, c0 long, c1 long")
    return dealt, len(layout)


def prefix_limits(bits: int) -> np.ndarray:
    """How many of the first d bits may differ: the mean at ERROR and three and a half deviations."""
    d = np.arange(bits + 1)
    return np.ceil(ERROR * d + 3.5 * np.sqrt(ERROR * (1 - ERROR) * d)).astype(np.int64)


def _join_task(words: int, depth: int, budget: int, allowed: np.ndarray | None):
    """Spanning edges of the close pairs in the groups of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        table = pa.Table.from_batches(batches).combine_chunks() if batches else None
        if table is None or not table.num_rows:
            return
        col = {n: table.column(n).to_numpy() for n in table.column_names}
        code = np.stack([col[f"c{i}"] for i in range(words)], axis=1).view(np.uint64)
        order = np.lexsort((*[code[:, i] for i in reversed(range(words))], col["side"], col["two"], col["one"], col["key"]))
        code, key, node, side, one, two = code[order], *(col[n][order] for n in ("key", "node", "side", "one", "two"))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0) | (np.diff(side) != 0)]))
        end = np.append(new[1:], len(key))
        alone = one[new] == two[new]
        nodes = np.stack([new, end, new, end])[:, alone & (end - new > 1)]
        cut = np.flatnonzero(~alone[:-1] & (key[new[:-1]] == key[new[1:]]) & (one[new[:-1]] == one[new[1:]]) & (two[new[:-1]] == two[new[1:]]))
        nodes = np.concatenate([nodes, np.stack([new[cut], end[cut], new[cut + 1], end[cut + 1]])], axis=1)
        forest = Forest(len(key))
        for i, j in close_pairs(code, nodes, depth, budget, allowed):
            forest.link(i, j)
        # every tree points to its smallest node, so that the groups of a task agree on it
        least = node.copy()
        np.minimum.at(least, forest.parent, node)
        root = least[forest.parent]
        away = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[away]), pa.array(root[away])], ["a", "b"])

    return run


def links(dealt: DataFrame, words: int, depth: int, budget: int, allowed: np.ndarray | None, rows: int, group_rows: int = 1 << 20) -> DataFrame:
    """a, b: a spanning forest of the links between the nodes of each of the groups of ``dealt``;
    ``rows``: how many it has."""
    if rows > group_rows:
        large = materialise(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).withColumn("chunks", F.ceil(F.col("n") / group_rows).cast("int")), "large-groups", 1 << 10)
        if not large.isEmpty():
            dealt = hot_join(dealt, large, ["key"], "n", rows, "left")
    chunks = F.coalesce("chunks", F.lit(1)) if "chunks" in dealt.columns else F.lit(1)
    dealt = dealt.withColumn("chunks", chunks).withColumn("side", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("one", F.least("side", "other")).withColumn("two", F.greatest("side", "other"))
    parts = dealt.select("key", "node", *[f"c{i}" for i in range(words)], "side", "one", "two").repartition("key", "one", "two")
    return in_arrow(parts, _join_task(words, depth, budget, allowed), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, count: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, w0, component_id: the smallest doc_id that links of at most ``budget`` bits reach."""
    marks = materialise(fingerprints(docs, size), "fingerprints")
    total = marks.count()
    codes = materialise(marks.groupBy("w0").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "codes")
    # a band's forest has fewer edges than codes
    dealt, depth = bands(codes.where("node IS NOT NULL"), count)
    groups = connected_components(links(dealt, 1, depth, budget, None, count * total), most_rows=count * total)
    named = codes.join(groups.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = materialise(named.select("w0", F.coalesce("component", "node").alias("component_id"), "n"), "named")
    return hot_join(marks, named, ["w0"], "n", total, "left").select("doc_id", "w0", "component_id")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    return np.unique(np.array([xxhash.xxh3_64_intdigest(x, SEED) for x in shingles(text, size)], np.uint64))


def similar_edges(codes: np.ndarray, sets: list[np.ndarray], least: float, budget: int) -> list[tuple[int, int]]:
    """A spanning forest (by position) of the pairs whose sets have a Jaccard similarity of at least ``least``.

    Breadth first: a row is compared with those not yet reached whose codes are within the
    budget. Rows of one similar group are reached from a few of them, not pair by pair.
    """
    left, edges = np.arange(len(sets)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(codes[left] ^ codes[i]).sum(axis=1, dtype=np.int64) <= budget
            reached = np.zeros(len(left), bool)
            for k in np.flatnonzero(near):
                reached[k] = _similar(sets[i], sets[left[k]], least)
            edges += [(i, j) for j in left[reached]]
            queue += left[reached].tolist()
            left = left[~reached]
    return edges


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted arrays, as sets, have a Jaccard similarity of at least ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return shared >= least * (len(a) + len(b) - shared)


def verified_links(texts: DataFrame, codes: DataFrame, names: list[str], size: int, budget: int, least: float, group_rows: int, group_bytes: int) -> DataFrame:
    """node, component: what links of similarity ``least`` join inside the candidate components,
    exact by shingle sets; nodes without links and smallest nodes may be left out.

    ``codes``: node, component, the code's words, and doc_id, row and bytes of the text that stands
    for it. A component of over ``group_rows`` codes or ``group_bytes`` of text is dealt into
    chunks; each pair of chunks is a group of its own, which bounds a task's share of a component.
    """
    total = codes.count()
    most = F.greatest(F.count(F.lit(1)) / group_rows, F.sum("bytes") / group_bytes)
    chunks = codes.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.ceil(most).cast("int").alias("chunks")).where("n > 1")
    chunks = materialise(chunks, "chunks", total)
    dealt = hot_join(codes, chunks, ["component"], "n", total).withColumn("side", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    dealt = dealt.join(texts, ["doc_id", "row"])
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("one", F.least("side", "other")).withColumn("two", F.greatest("side", "other"))

    def check(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")
        sets = [shingle_set(x, size) for x in group["text"]]
        edges = np.array(similar_edges(group[names].to_numpy(np.int64).view(np.uint64), sets, least, budget), np.int64).reshape(-1, 2)
        forest, node = Forest(len(group)), group["node"].to_numpy()
        forest.link(edges[:, 0], edges[:, 1])
        away = forest.parent != np.arange(len(group))  # rows are sorted by node, so a root is the smallest of its tree
        return pd.DataFrame({"a": node[away], "b": node[forest.parent[away]]})

    ship(texts.sparkSession)
    found = dealt.select("component", "one", "two", "node", "text", *names).groupBy("component", "one", "two").applyInPandas(check, "a long, b long")
    found = materialise(found, "verified")
    if chunks.where("chunks > 1").isEmpty():  # then every tree lies in one group and points to its smallest node
        return found.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return connected_components(found)


def one_of_each(docs: DataFrame, size: int = 5, words: int = 8, budget: int = 124, least: float = 0.8, group_rows: int = 1 << 14, group_bytes: int = 1 << 26) -> DataFrame:
    """The row with the smallest id of each near-duplicate group, all columns kept.

    Rows are linked if their sets of five-word shingles have a Jaccard similarity of ``least``
    (at 0.8 about 78 of 512 bits differ, up to 96 in texts of a few shingles). Equal codes count
    as equal sets. Of rows that repeat a ``doc_id``, exact repeats go; with other texts they
    are documents of their own. Ties of the smallest id go to the smallest hash of the whole row.
    Rows without ``doc_id`` stay.
    """
    names = [f"w{i}" for i in range(words)]
    # a row is known by its id and the hash of all its columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")).withColumn("row", F.xxhash64("d"))
    rows = inner.where("d.doc_id IS NOT NULL").select(F.col("d.doc_id").cast("long").alias("doc_id"), F.col("d.text").alias("text"), "row")
    marks = fingerprints(rows.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), size, words, True, ("row", "bytes"))
    # equal codes become one node, which the smallest (doc_id, row) stands for; its number is
    # given once, when the table is written
    each = marks.groupBy(*names, "doc_id").agg(F.min("row").alias("row"), F.min("bytes").alias("bytes"))
    codes = each.groupBy(*names).agg(F.min("doc_id").alias("least"), F.min_by("row", "doc_id").alias("row"), F.min_by("bytes", "doc_id").alias("bytes"))
    codes = materialise(codes.withColumnRenamed("least", "doc_id").withColumn("node", F.monotonically_increasing_id()), "codes")
    total = codes.count()
    dealt, count = trees(codes, words, total)
    found = links(dealt, 2, 0, int(prefix_limits(128)[-1]), prefix_limits(128), count * total)
    groups = materialise(connected_components(found, most_rows=count * total), "candidates")
    inside = materialise(codes.join(groups, "node"), "candidate-codes")
    linked = verified_links(rows.select("doc_id", "row", "text"), inside, names, size, budget, least, group_rows, group_bytes)
    kept = codes.join(linked, "node", "left").groupBy(F.coalesce("component", "node").alias("group"), "doc_id").agg(F.min("row").alias("row"))
    kept = kept.groupBy("group").agg(F.min("doc_id").alias("least"), F.min_by("row", "doc_id").alias("row")).select(F.col("least").alias("doc_id"), "row")
    named = inner.withColumn("doc_id", F.col("d.doc_id").cast("long"))
    chosen = named.where("doc_id IS NOT NULL").join(kept, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    return chosen.unionByName(named.where("doc_id IS NULL")).select(*[F.col("d")[c].alias(c) for c in docs.columns])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")
