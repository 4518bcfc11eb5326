"""The pipeline's stages take effect, and keep what is clean."""

from __future__ import annotations

import math
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tokenizers

from quernflow.llm import contamination, langid, simhash
from quernflow.llm.common import materialise
from tests.llm.frames import docs, write
from tests.llm.test_operators import brute_lines

ENGLISH = "the and of to in is that for with was on are by this from have not be at which".split()
FRENCH = "le la les des une est dans pour que qui avec sur par plus pas sont cette ont mais nous".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents in two languages, and planted ones that each stage must act on."""
    draw = random.Random(7)
    text = lambda words, n: " ".join(draw.choice(words) if draw.random() < 0.4 else draw.choice(words)[:2] + draw.choice(words) + str(draw.randrange(9)).translate(str.maketrans("0123456789", "abcdefghij")) + draw.choice(words) for _ in range(n))
    rows = [(i, text(ENGLISH if i % 2 else FRENCH, draw.randrange(80, 200)), "en" if i % 2 else "fr") for i in range(160)]
    item = text(ENGLISH, 40)
    rows += [(200, "1234 5678 !!! 99", "en"), (201, None, "en"), (202, rows[3][1], "en"), (203, rows[4][1].replace(" ", "\n", 1), "fr")]
    rows += [(204, text(ENGLISH, 60) + " " + item + " " + text(ENGLISH, 60), "en"), (205, text(ENGLISH, 30) + "\nA line that is repeated here.\n" + text(ENGLISH, 90), "en"), (206, text(ENGLISH, 90) + "\na line that is repeated here.", "en")]
    folder = tmp_path_factory.mktemp("corpus")
    write(docs(spark, rows), folder, "documents")
    write(spark.createDataFrame([(1, item)], "item_id long, text string"), folder, "benchmark")
    return str(folder)


def test_stages(spark, corpus):
    current = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = current.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        current = materialise(stage(spark, current, corpus), name)
        seen[name] = {r["doc_id"]: r for r in current.collect()}
        if name != "pack":
            assert current.columns == columns
    clean = set(range(160))
    assert set(seen["language"]) == clean | {202, 203, 204, 205, 206}
    assert seen["line_dedup"][205]["text"].count("\n") == 2 and seen["line_dedup"][206]["text"].count("\n") == 0
    assert seen["line_dedup"][206]["n_chars"] == len(seen["line_dedup"][206]["text"])
    assert set(seen["near_dedup"]) >= clean | {204, 205, 206} and 203 not in seen["near_dedup"]
    assert 204 not in seen["decontaminate"] and clean | {205, 206} <= set(seen["decontaminate"])
    assert set(seen["pack"]) == set(seen["decontaminate"])


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() >= 160


def test_empty(spark, corpus, tmp_path):
    write(spark.read.parquet(f"{corpus}/documents.parquet").limit(0), tmp_path, "documents")
    write(spark.read.parquet(f"{corpus}/benchmark.parquet"), tmp_path, "benchmark")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_against_brute_force(spark, sf):
    """Each stage over the smallest tables, against a plain version of what it is to keep of its input."""
    current, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, current, sf), name)
        seen.append(({r["doc_id"]: r["text"] for r in current.collect()}, after.collect()))
        current = after
    (raw, spoken), (_, lines), (edited, distinct), (single, clean), (left, packed) = seen

    labeller = langid.Labeller(langid.train(spark.read.parquet(f"{sf}/documents.parquet")))
    assert {r["doc_id"] for r in spoken} == {d for d, t in raw.items() if labeller.shares([t]).max() >= corpus_pipeline.LEAST_SHARE}

    assert sorted((r["doc_id"], r["text"]) for r in lines) == sorted((d, t) for d, t, _, _ in brute_lines([(r["doc_id"], r["text"]) for r in spoken]))

    ids, sets = sorted(edited), {d: set(simhash.shingles(t, 5)) for d, t in edited.items()}
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in distinct} == {d for d in ids if find(d) == d}

    items = [contamination.words_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {d: contamination.words_of(t) for d, t in single.items()}
    blocks = Counter(w for ws in texts.values() for k in range(0, len(ws), 16) for w in set(ws[k : k + 16]))
    total = sum(-(-len(ws) // 16) for ws in texts.values())
    weight = {w: math.log((2 + total) / (1 + blocks[w])) for ws in items for w in ws}

    def holds(words, item):
        n, distinct = len(item), sorted(set(item), key=lambda w: (-weight[w], w))
        telling, bits = distinct[: max(3, math.ceil(len(distinct) / 4))], contamination.mask(item)
        for start in range(0, len(words), 16):
            around = words[max(0, start - n) : start + 32 + n]
            share = contamination.common_length(bits, n, around) / n
            if share >= 0.8 or (share >= 0.5 and len(set(around) & set(telling)) >= 0.6 * len(telling)):
                return True
        return False

    assert {r["doc_id"] for r in clean} == {d for d, ws in texts.items() if not any(holds(ws, x) for x in items)}

    tokens = {}
    for r in packed:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert tokens == {d: len(model.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in left.items()}
