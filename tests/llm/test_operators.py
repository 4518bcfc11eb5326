"""Each operator against a brute-force version, and on awkward input."""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import math
import os
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernflow.llm import ann, common, components, contamination, langid, licenses, linededup, packing, quality, simhash, tokencount, trie, warc
from quernflow.llm.queries import ORACLES, QUERIES
from tests.compare import assert_same, connect
from tests.llm.frames import awkward, docs

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), connect(sf).sql(ORACLES[name]).df())


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


class TestLicenses:
    def test_increasing(self):
        assert licenses.increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=14))
    def test_alignment_is_a_common_subsequence(self, a, b):
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= len(licenses.common_subsequence(a, b))

    def test_unchanged_text_aligns_fully(self):
        words = licenses.words_of(licenses.TEMPLATES["MIT"])
        assert licenses.patience(words, words) == [(i, i) for i in range(len(words))]

    def brute(self, words, template, least):
        """Whether any stretch of the words covers the template densely, by full tables."""
        n = len(template)
        for lo in range(len(words)):
            for hi in range(lo + 1, min(len(words), lo + int(n / least) + 1) + 1):
                m = len(licenses.common_subsequence(words[lo:hi], template))
                if m >= least * n and m >= least * (hi - lo):
                    return True
        return False

    @pytest.mark.parametrize("seed", range(8))
    def test_short_notices_against_brute_force(self, seed):
        draw = random.Random(seed)
        names = ("MIT-notice", "Apache-2.0-notice", "all-rights-reserved")
        scanner = licenses.Scanner({n: licenses.TEMPLATES[n] for n in names})
        for _ in range(12):
            words = [draw.choice(["the", "license", "all", "under", "mit", "x", "y"]) for _ in range(12)]
            name = draw.choice(names)
            notice = licenses.words_of(licenses.TEMPLATES[name])
            whole = draw.random() < 0.5 or len(notice) < 5
            at = draw.randrange(len(words))
            words[at:at] = notice if whole else notice[:2] + notice[3:]
            found = {h[0] for h in scanner.scan(words)}
            # patience may miss what a full table finds, if template words repeat beside an edited notice
            assert found or not whole
            assert all(self.brute(words, licenses.words_of(licenses.TEMPLATES[x]), 0.8) for x in found)

    @pytest.mark.parametrize("seed", range(4))
    def test_gates_against_a_search_around_every_word(self, seed):
        """The gate words choose the windows; windows around all words of a template find the same notices."""
        draw = random.Random(seed)
        names = ("MIT-notice", "Apache-2.0", "ISC", "GPL-3.0", "BSL-1.0", "SPDX-MIT")
        texts = {n: licenses.TEMPLATES[n] for n in names}
        gated, every = licenses.Scanner(texts), licenses.Scanner(texts)
        every.templates = [dataclasses.replace(t, gates={w: tuple(i for i, x in enumerate(t.words) if x == w) for w in set(t.words)}) for t in every.templates]
        every.gates = frozenset(w for t in every.templates for w in t.words)
        for _ in range(6):
            words = [draw.choice(["the", "license", "of", "under", "software", "x", "y", "z"]) for _ in range(60)]
            for name in draw.sample(names, 2):
                notice = [w if draw.random() > 0.06 else "edited" for w in licenses.words_of(texts[name])]
                at = draw.randrange(len(words))
                words[at:at] = notice
            a, b = gated.scan(words), every.scan(words)
            assert {h[0] for h in a} == {h[0] for h in b}
            assert all(any(x[0] == y[0] and abs(x[1] - y[1]) < 8 and abs(x[3] - y[3]) <= 2 for y in b) for x in a)

    def test_tags_and_long_licences(self, spark):
        rows = [(1, "# SPDX-License-Identifier: Apache-2.0\ncode"), (2, licenses.TEMPLATES["BSD-3-Clause"]), (3, licenses.TEMPLATES["BSD-2-Clause"]), (4, licenses.TEMPLATES["LGPL-2.1"]), (5, licenses.TEMPLATES["GPL-2.0"]), (6, "spdx identifier")]
        got = [(r["doc_id"], r["license"]) for r in licenses.scan_documents(docs(spark, rows)).orderBy("doc_id").collect()]
        assert got == [(1, "SPDX-Apache-2.0"), (2, "BSD-3-Clause"), (3, "BSD-2-Clause"), (4, "LGPL-2.1"), (5, "GPL-2.0")]

    def test_edited_copies_in_a_long_text(self, spark):
        body = licenses.TEMPLATES["MIT"].replace("free of charge", "at no cost").replace("distribute, sublicense", "give away")
        noise = " ".join(f"w{i}" for i in range(3000))
        rows = [(1, f"{noise}\n{body}\n{noise}\n{licenses.TEMPLATES['GPL-3.0']}"), (2, noise), (3, "All rights reserved. x x x x ALL RIGHTS RESERVED"), (4, "all the rights that are reserved")]
        got = licenses.scan_documents(docs(spark, rows)).orderBy("doc_id", "start_word").collect()
        assert [(r["doc_id"], r["license"]) for r in got] == [(1, "MIT"), (1, "GPL-3.0"), (3, "all-rights-reserved"), (3, "all-rights-reserved")]
        assert got[0]["start_word"] == 3000 and 0.9 < got[0]["coverage"] < 1 and got[1]["coverage"] == 1

    def test_awkward(self, spark):
        assert licenses.scan_documents(awkward(spark)).count() == 0 and licenses.scan_documents(awkward(spark).limit(0)).count() == 0


class TestPacking:
    ODD = ["", "a\x01b <|endoftext|>x \x01 é\x01, it's don't. ½. ²,x \x1c a\x85b x ﬁ. " + "ab" * 100 + " " + "É" * 60 + ".", "\x01", "\t\n ", "Á ≠ ́x Straße İ ΣΣ"]

    def test_ids_are_the_tokenizers(self, spark, sf):
        texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()] + self.ODD
        reference = tokenizers.Tokenizer.from_file(WORD_BPE)
        for text, got in zip(texts, packing.ChunkEncoder(WORD_BPE).encode(texts), strict=True):
            ids = reference.encode(text, add_special_tokens=False).ids
            assert got == struct.pack(f"<{len(ids)}I", *ids)

    @settings(max_examples=100, deadline=None)
    @given(st.lists(st.integers(1, 16), max_size=40))
    def test_best_fit_against_brute_force(self, lengths):
        lengths = sorted(lengths, reverse=True)
        free: list[list[int]] = []  # remaining, window
        want = []
        for n in lengths:
            fits = [w for w in free if w[0] >= n]
            if fits:
                least = min(w[0] for w in fits)
                window = [w for w in fits if w[0] == least]
                want.append(least)
                window[0][0] -= n
            else:
                want.append(16)
                free.append([16 - n, len(free)])
        placed = packing.best_fit(lengths, 16)
        assert [16 - offset for _, offset in placed] == want
        used = Counter()
        for n, (w, offset) in zip(lengths, placed, strict=True):
            assert used[w] == offset
            used[w] += n
        assert all(v <= 16 for v in used.values())

    def test_pieces_round_trip(self, spark):
        rows = awkward(spark)
        got = packing.pack_documents(rows, WORD_BPE).toPandas()
        reference = tokenizers.Tokenizer.from_file(WORD_BPE)
        want = Counter()
        for r in rows.collect():
            ids = [*reference.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            for s in range(0, len(ids), 4096):
                part = ids[s : s + 4096]
                want[(-1 if r["doc_id"] is None else r["doc_id"], s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids))] += 1
        assert Counter(got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].fillna(-1).astype(int).itertuples(index=False, name=None)) == want
        for _, s in got.sort_values("offset").groupby("sequence_id"):
            assert list(s["offset"]) == list(s["length"].cumsum() - s["length"]) and s["length"].sum() <= 4096
        assert packing.pack_documents(rows.limit(0), WORD_BPE).count() == 0

    def test_repeated_rows_spread_over_the_groups(self, spark):
        same = docs(spark, [(None, "")] * 400 + [(1, "some words here")] * 400)
        got = packing.pack_documents(same, WORD_BPE, group_rows=100)
        assert got.count() == 800 and got.groupBy(F.shiftright("sequence_id", 40).alias("g")).count().agg(F.max("count")).first()[0] <= 120

    def test_little_padding(self, spark, sf):
        got = QUERIES["op2_packing"](spark, sf).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()["n"]
        assert got.sum() / (4096 * len(got)) > 0.95


def brute_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(p, seed=42) >> b & 1 for p in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(parts))


def brute_groups(codes, budget):
    parent = {k: k for k in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(codes)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (codes[a] ^ codes[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


class TestSimHash:
    def test_against_brute_force(self, spark, sf):
        rows = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
        codes = {k: brute_fingerprint(v, 3) for k, v in rows.items()}
        want = brute_groups(codes, 2)
        got = {r["doc_id"]: r for r in QUERIES["op3_simhash"](spark, sf).collect()}
        assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in codes.items()}
        assert {k: r["component_id"] for k, r in got.items()} == want

    def planted(self, spark, seed=1, centres=40, near=30):
        draw = random.Random(seed)
        codes = []
        for _ in range(centres):
            c = draw.getrandbits(64)
            codes.append(c)
            for _ in range(draw.randrange(near)):
                c ^= 1 << draw.randrange(64) | 1 << draw.randrange(64)  # chains drift away from the centre
                codes.append(c)
        codes = list(dict.fromkeys(codes))
        signed = [c - (1 << 64) if c >> 63 else c for c in codes]
        return dict(enumerate(codes)), spark.createDataFrame(list(enumerate(signed)), "rep long, w0 long").repartition(5)

    @pytest.mark.parametrize("group_rows", [1 << 20, 3])
    def test_chains_and_split_groups(self, spark, group_rows):
        codes, frame = self.planted(spark)
        frame = frame.unionByName(spark.createDataFrame([(1000 + i, 5 << 40 | i) for i in range(64)], "rep long, w0 long"))
        codes |= {1000 + i: 5 << 40 | i for i in range(64)}
        dealt, depth = simhash.bands(frame.withColumnRenamed("rep", "node"), 3)
        groups = components.connected_components(simhash.links(dealt, 1, depth, 2, None, 3 * len(codes), group_rows))
        got = {k: k for k in codes} | {r["node"]: r["component"] for r in groups.collect()}
        assert got == brute_groups(codes, 2)

    def test_trie_finds_every_close_pair(self):
        rng = np.random.default_rng(3)
        base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        codes = np.sort(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(1 << 60), base ^ np.uint64(6), base[:5], base[:5]]))[:, None]
        nodes = np.array([[0], [len(codes)], [0], [len(codes)]])
        got = {(int(i), int(j)) for a, b in trie.close_pairs(codes, nodes, 0, 2) for i, j in zip(a, b, strict=True)}
        want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i, 0] ^ codes[j, 0]).bit_count() <= 2}
        assert got == want

    def test_trie_over_many_words_prunes(self):
        rng = np.random.default_rng(4)
        base = rng.integers(0, 1 << 63, (3000, 2), dtype=np.uint64)
        noise = np.packbits(rng.random((3000, 128)) < 0.15, axis=1).view(">u8").astype(np.uint64)
        codes = np.concatenate([base, base ^ noise])
        codes = codes[np.lexsort((codes[:, 1], codes[:, 0]))]
        limits = simhash.prefix_limits(128)
        nodes = np.array([[0], [len(codes)], [0], [len(codes)]])
        got = {(int(i), int(j)) for a, b in trie.close_pairs(codes, nodes, 0, int(limits[-1]), limits) for i, j in zip(a, b, strict=True)}
        want = set()
        for i in range(len(codes)):
            near = np.bitwise_count(codes[i + 1 :] ^ codes[i]).sum(axis=1) <= limits[-1]
            want |= {(i, i + 1 + int(j)) for j in np.flatnonzero(near)}
        assert got <= want and len(got) > 0.97 * len(want) > 2900

    def test_trees_cover_the_threshold(self):
        rng, misses = np.random.default_rng(8), 0
        for width in (8, 14):
            layout = simhash.tree_layout(8, width)
            differ = rng.random((4000, 512)) < 0.1515  # a pair at similarity 0.8
            met = np.zeros(4000, bool)
            for picked, one, two in layout:
                check = differ[:, 64 * one : 64 * one + 64].sum(axis=1) + differ[:, 64 * two : 64 * two + 64].sum(axis=1)
                met |= ~differ[:, picked].any(axis=1) & (check <= simhash.prefix_limits(128)[-1])
            misses += (~met).sum()
        assert misses < 16

    def test_one_id_with_other_texts(self, spark):
        draw = random.Random(2)
        make = lambda: " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(4000)}" for _ in range(200))
        a, b, c = make(), make(), make()
        rows = docs(spark, [(1, a), (1, b), (2, b + " end"), (3, c), (3, c), (4, a)])
        got = sorted((r["doc_id"], r["text"]) for r in simhash.one_of_each(rows).collect())
        assert got == sorted([(1, a), (1, b), (3, c)])

    @pytest.mark.parametrize("group_rows", [1 << 14, 4])
    def test_copies_around_a_text_that_is_not_the_smallest(self, spark, group_rows):
        """Edits of one text, alike to it but not to each other, and the smallest id among the edits."""
        draw = random.Random(14)
        base = [f"b{draw.randrange(10**6)}" for _ in range(300)]
        rows = [(50, " ".join(base))]
        for k in range(12):
            words = list(base)
            words[25 * k : 25 * k + 25] = [f"e{draw.randrange(10**6)}" for _ in range(25)]  # 0.82 to the base, 0.67 to the others
            rows.append((k, " ".join(words)))
        rows += [(100 + k, " ".join(f"o{draw.randrange(10**6)}" for _ in range(100))) for k in range(5)]
        assert {r[0] for r in simhash.one_of_each(docs(spark, rows), group_rows=group_rows).select("doc_id").collect()} == {0, *range(100, 105)}

    def test_hub_of_a_component(self, spark):
        edges = spark.range(1, 5000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
        assert components.connected_components(edges).where("component = 0").count() == 5000

    def test_awkward(self, spark):
        got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(awkward(spark).select("doc_id", "text")).collect()}
        assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (None, None)} <= got and simhash.near_duplicates(awkward(spark).limit(0)).count() == 0
        kept = simhash.one_of_each(awkward(spark))
        assert sorted(r[0] or 0 for r in kept.select("doc_id").collect()) == [0, 1, 4, 5, 6, 7] and kept.columns == awkward(spark).columns

    def test_near_copies_go_and_others_stay(self, spark):
        draw = random.Random(5)
        make = lambda n: [f"{draw.choice('abcdefgh')}{draw.randrange(4000)}" for _ in range(n)]
        rows, gone, shared = [], set(), " ".join(make(60))
        for k in range(60):
            words = make(300)
            rows.append((10 * k, " ".join(words)))
            for c in range(1, 4):
                edited = list(words)
                for _ in range(3):
                    edited[draw.randrange(300)] = "edited"
                rows.append((10 * k + c, " ".join(edited)))
                gone.add(10 * k + c)
            rows.append((10 * k + 9, " ".join(make(80)) + " " + shared))  # a passage that all of these share
        left = {r[0] for r in simhash.one_of_each(docs(spark, rows)).select("doc_id").collect()}
        assert {r[0] for r in rows} - left == gone


    def test_similarity_is_checked(self, spark):
        draw = random.Random(11)
        make = lambda n: [f"{draw.choice('abcdefgh')}{draw.randrange(4000)}" for _ in range(n)]
        rows, gone = [], set()
        for k in range(0, 400, 2):  # of 300 words, the last 42 (0.755) or 32 (0.807) differ
            words, new = make(300), 42 if k < 200 else 32
            rows += [(k, " ".join(words)), (k + 1, " ".join(words[:-new] + make(new)))]
            gone |= {k + 1} if k >= 200 else set()
        phrase = " ".join("one two three four five".split() * 20)
        rows += [(1000 + k, " ".join(make(300)) + "\n" + phrase) for k in range(20)]  # a repeated phrase counts once
        got = {r[0] for r in simhash.one_of_each(docs(spark, rows)).select("doc_id").collect()}
        assert {r[0] for r in rows} - got == gone

    def test_a_large_group_in_chunks(self, spark):
        words = [f"w{i}" for i in range(200)]
        rows = [(k, " ".join(words[: 200 - k])) for k in range(60)]  # a chain: neighbours are alike, the ends are not
        left = {r[0] for r in simhash.one_of_each(docs(spark, rows), group_rows=16).select("doc_id").collect()}
        assert left == {0}


class TestWarc:
    def pages(self, spark):
        same, short = "<html>" + "x" * 200, "tiny"
        rows = [(1, "http://a", same), (2, "http://b\r\nX: y", same), (3, None, short), (4, "http://é", short), (5, "u", None), (6, "u", "é" * 49 + "x"), (7, "u", "é" * 50), (8, "u", "é" * 50), (None, "u", same), (1, "http://a", same), (9, "long", "y\r\n\r\n" * 300_000)]
        return spark.createDataFrame(rows, "page_id long, url string, html string")

    def test_round_trip_and_revisits(self, spark, tmp_path):
        target = f"file://{tmp_path}/w"
        pages = self.pages(spark)
        index = warc.write_archive(pages, target)
        got = warc.read_records(index, target).collect()
        refers = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
        assert refers == Counter({(1, "response", None): 2, (2, "revisit", 1): 1, (3, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1, (7, "response", None): 1, (8, "revisit", 7): 1, (None, "response", None): 1, (9, "response", None): 1})
        html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
        for r in got:
            assert r["payload_digest"] == hashlib.sha256(html[r["page_id"]].encode()).hexdigest() and r["payload_bytes"] == len(html[r["page_id"]].encode())
            assert r["record_type"] == "revisit" or r["html"] == html[r["page_id"]]

    def test_payloads_are_not_shuffled_by_digest(self, spark):
        rows = [(k, "u", "x" * 500 if k % 3 == 0 else f"{k} " * 60) for k in range(600)]
        marked = warc.mark_revisits(spark.createDataFrame(rows, "page_id long, url string, html string"), 100)
        assert "Exchange hashpartitioning" not in marked._jdf.queryExecution().executedPlan().toString()
        assert {r["refers_to"] for r in marked.where("page_id % 3 = 0 AND page_id > 0").collect()} == {0}

    def test_selected_records_only(self, spark, tmp_path):
        target = f"file://{tmp_path}/w"
        index = warc.write_archive(self.pages(spark), target).where("page_id IN (2, 9)")
        for gap, most in ((0, 1), (1 << 16, 1 << 23)):
            assert sorted(r[0] for r in warc.read_records(index, target, gap=gap, most=most).select("page_id").collect()) == [2, 9]

    def test_records_are_whole_gzip_members(self, spark, tmp_path):
        import gzip

        warc.write_archive(self.pages(spark).coalesce(1), f"file://{tmp_path}/w")
        data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").iterdir())
        assert data.count(b"WARC/1.1\r\n") == 11 and b"\r\nX: y" not in data

    def test_a_changed_payload_is_noticed(self, spark, tmp_path):
        target = f"file://{tmp_path}/w"
        index = warc.write_archive(self.pages(spark).where("page_id = 3"), target)
        path = next(p for p in (tmp_path / "w").iterdir())
        import gzip

        path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"tiny", b"Tiny")))
        index = index.withColumn("length", F.lit(path.stat().st_size).cast("long"))
        with pytest.raises(Exception, match="digest"):
            warc.read_records(index, target).collect()

    def test_empty(self, spark, tmp_path):
        index = warc.write_archive(self.pages(spark).limit(0), f"file://{tmp_path}/w")
        assert index.count() == 0 and warc.read_records(index, f"file://{tmp_path}/w").count() == 0


def brute_lines(rows, least=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None:
                first[key(x)] = min(first.get(key(x), d), d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < least or first[key(x)] == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


class TestLineDedup:
    LINES = ["a shared line of text", " A SHARED line of text\t", "short", "", "Ärger Ärger Ärger", "ärger ärger ärger", "another line here", "x" * 9, "x" * 10, " ten letters"]

    @pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (3, 3)])
    def test_against_brute_force(self, spark, batches, fanout):
        draw = random.Random(batches)
        rows = [(i, "\n".join(draw.choice(self.LINES) for _ in range(draw.randrange(8)))) for i in range(60)] + [(None, "a shared line of text"), (70, None)]
        got = linededup.deduplicate(docs(spark, rows).repartition(4), batches=batches, fanout=fanout)
        assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == brute_lines(rows)

    def test_repeated_ids(self, spark):
        rows = [(1, "a shared line of text\nb"), (1, "a shared line of text"), (2, "x\na shared line of text")]
        got = linededup.deduplicate(docs(spark, rows))
        assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, "a shared line of text"), (1, "a shared line of text\nb"), (2, "x")]

    def test_awkward(self, spark):
        got = linededup.deduplicate(awkward(spark))
        assert got.count() == 9 and "clash" not in {str(r["n_lines"]) for r in got.collect()}
        assert linededup.deduplicate(awkward(spark).limit(0)).count() == 0

    def test_other_columns_pass_through(self, spark):
        got = linededup.deduplicate(awkward(spark), counts=False)
        assert {(r["n_lines"], r["_drop"]) for r in got.collect()} == {("clash", "clash")} and set(got.columns) == set(awkward(spark).columns)

    def test_a_long_repeated_document(self, spark):
        text = "\n".join(f"line number {k} of a long document" for k in range(100_000))
        began = time.monotonic()
        got = {r["doc_id"]: r for r in linededup.deduplicate(docs(spark, [(1, text), (2, text + "\nand one more"), (3, text)])).collect()}
        assert got[1]["text"] == text and got[2]["text"] == "and one more" and got[3]["text"] == "" and got[3]["n_dropped"] == 100_000
        assert time.monotonic() - began < 60

    def test_batches_follow_the_size_and_nothing_is_left_over(self, spark):
        rows = [(k, f"a line of document {k // 2}\nthe same line in all of them") for k in range(40)]
        got = linededup.deduplicate(docs(spark, rows), batches=1, batch_rows=5)
        assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == brute_lines(rows)
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quern_run_")]
        assert spark.conf.get(linededup.ORDERED) == "false"

    def test_a_failure_leaves_no_tables(self, spark, monkeypatch):
        monkeypatch.setattr(linededup, "hot_join", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            linededup.deduplicate(docs(spark, [(k, f"a line of document {k // 2}") for k in range(40)]))
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quern_run_")]

    def test_runs_are_read_in_their_order(self, spark):
        with linededup.ordered_scans(spark):
            runs = linededup.LineRuns(spark, 2)
            runs.add(spark.range(1000).select(F.xxhash64("id").alias("_h1"), F.xxhash64("id", "id").alias("_h2"), F.col("id").alias("_first")))
            plan = runs.runs()[0].hint("merge").join(runs.runs()[0].hint("merge").withColumnRenamed("_first", "x"), linededup.HASH)
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert "Sort [" not in text and "Exchange" not in text
            runs.close()

    def test_runs_are_compacted(self, spark):
        runs = linededup.LineRuns(spark, 2, fanout=2)
        make = lambda k: spark.createDataFrame([(k, k, k)], "_h1 long, _h2 long, _first long")
        for k in range(1, 6):
            runs.add(make(k))
        assert [len(level) for level in runs.levels] == [1, 0, 1]
        seen = runs.seen(spark.createDataFrame([(3, 3), (9, 9)], "_h1 long, _h2 long"))
        assert {r["_h1"]: r["_known"] for r in seen.collect()} == {3: 3, 9: None}
        runs.close()


class TestTokenCounts:
    VOCAB = ["a", "b", "c", "ab", "abc", "bcd", "cab", "abca", "▁", "▁a", "▁ab"]

    @staticmethod
    def greedy(word, vocabulary):
        word, n, i = "▁" + word, 0, 0
        while i < len(word):
            for j in range(len(word), i, -1):
                if word[i:j] in vocabulary:
                    n, i = n + 1, j
                    break
            else:
                n, i = n + len(word[i].encode()), i + 1
        return n

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet="abcdé中", max_size=12))
    def test_against_greedy(self, word):
        assert tokencount.LongestMatch(self.VOCAB).count(word) == self.greedy(word, set(self.VOCAB))

    def test_query(self, spark, sf):
        vocabulary = set(tokencount.vocabulary(PIECES))
        got = {r["doc_id"]: r for r in QUERIES["op6_token_counts"](spark, sf).collect()}
        pieces = functools.cache(lambda w: self.greedy(w, vocabulary))
        rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
        assert len(rows) == len(got)
        for r in rows:
            words = (r["text"] or "").split()
            assert got[r["doc_id"]]["n_words"] == len(words) and got[r["doc_id"]]["n_tokens"] == sum(map(pieces, words))

    def test_awkward(self, spark):
        got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokencount.token_counts(awkward(spark), PIECES).collect()}
        assert got[1] == (0, 0) and got[2] == (0, 0) and got[4][0] == 60_000 and None in got


class TestLanguage:
    def test_only_long_texts(self, spark):
        draw = random.Random(3)
        words = {"aa": "kala maja sana tavu".split(), "bb": "stone river winter cloud".split()}
        make = lambda y, n: " ".join(draw.choice(words[y]) + draw.choice("xyz") for _ in range(n))
        rows = [(k, make(y, 9000), y) for k, y in enumerate(["aa", "bb"] * 10)]
        field = langid.train(docs(spark, rows))
        got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs(spark, rows), field).collect()}
        assert got == {k: y for k, _, y in rows}
        assert langid.recognised(docs(spark, rows), field, 0.4).count() == 20

    def test_an_excerpt_reaches_both_ends(self):
        text = " ".join(f"{'abcdefghij'[k // 1000]}{'qrstuvwxyz'[k % 10]}word" for k in range(10_000))
        got = langid.words_of(langid.excerpt(text, 5000))
        assert got[0] == "aqword" and got[-1] == "jzword" and {w[0] for w in got} == set("abcdefghij") and 2000 < 7 * len(got) <= 5000
        assert langid.excerpt(text, 10**6) == text and 15_000 < len(langid.excerpt("x" * 100_000, 20_000)) <= 20_000

    def test_forward_backward_against_enumeration(self):
        import itertools

        rng = np.random.default_rng(0)
        emit, step, start = rng.random((4, 1, 3)) + 0.1, rng.standard_normal((3, 3)), rng.standard_normal(3)
        want, total = np.zeros((4, 3)), 0.0
        for path in itertools.product(range(3), repeat=4):
            p = np.exp(start[path[0]] + sum(step[a, b] for a, b in itertools.pairwise(path))) * np.prod([emit[t, 0, y] for t, y in enumerate(path)])
            total += p
            for t, y in enumerate(path):
                want[t, y] += p
        got, moves = langid.posteriors(emit.copy(), np.ones(4, int), step, start)
        assert np.allclose(got[:, 0], want / total) and np.isclose(moves.sum(), 3)

    def test_padding_does_not_matter(self):
        rng = np.random.default_rng(1)
        a, b, step, start = rng.random((5, 2)) + 0.1, rng.random((3, 2)) + 0.1, rng.standard_normal((2, 2)), rng.standard_normal(2)
        both = np.ones((5, 2, 2))
        both[:, 0], both[:3, 1] = a, b
        got, _ = langid.posteriors(both, np.array([2, 2, 2, 1, 1]), step, start)
        alone, _ = langid.posteriors(b[:, None].copy(), np.ones(3, int), step, start)
        assert np.allclose(got[:3, 1], alone[:, 0])

    def test_held_out_accuracy(self, spark, sf):
        truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang").collect()}
        got = QUERIES["op7_langid"](spark, sf.replace("0.001", "0.01")).collect()
        out = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
        assert len(out) > 150 and np.mean(out) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)

    def test_words_are_letters(self):
        assert langid.words_of("Ab½c ² Ⅷ x1y _z é") == ["ab", "c", "x", "y", "z", "é"] and langid.words_of(None) == []

    def test_every_letter_of_unspaced_text_counts(self):
        english, french = "the house and of with that from is".split(), "maison avec dans les une pour est que".split()
        field = langid.fit([langid.words_of("".join(english) * 30), langid.words_of("".join(french) * 30)], ["en", "fr"])
        ends = "".join(english)[:20] * 3
        text = lambda words: ends + "".join(words) * 40 + ends
        shares = langid.Labeller(field).shares([text(english), text(french)])
        assert shares[0, 0] > 0.95 and 0.85 < shares[1, 1] < 0.91  # 120 of 1320 letters are English
        assert "".join(langid.words_of(text(french))) == text(french)

    def test_long_texts_in_parts(self, monkeypatch):
        english, french = "the house and of with that from is".split(), "maison avec dans les une pour est que".split()
        field = langid.fit([english * 20, french * 20], ["en", "fr"])
        text = " ".join(english * 50 + french * 150)
        whole = langid.Labeller(field).shares([text, None, "la maison"])
        monkeypatch.setattr(langid, "SLICE", 64)
        monkeypatch.setattr(langid, "CHUNK", 100)
        assert [w for part in langid.parts_of(text) for w in part] == text.split()
        parts = langid.Labeller(field).shares([text, None, "la maison"])
        assert np.allclose(parts, whole, atol=0.01) and np.allclose(whole[0], [0.25, 0.75], atol=0.02)
        assert [w for part in langid.parts_of("x" * 1000) for w in part] == langid.words_of("x" * 1000)

    def test_languages_are_bounded(self, spark):
        rows = docs(spark, [(k, f"wort{'abc'[k % 3]} satz{'xyz'[k % 3]}", ["aa", "bb", "cc"][min(k % 4, 2)]) for k in range(60)])
        assert langid.train(rows, most_langs=2).langs == ["aa", "cc"] or langid.train(rows, most_langs=2).langs == ["bb", "cc"]

    def test_query_against_brute_force(self, spark, sf):
        """Feature by feature and word by word, in logarithms."""
        table = spark.read.parquet(f"{sf}/documents.parquet")
        field = langid.train(table.select("doc_id", "text", "lang"))
        hash_of = lambda chars: sum(ord(c) * 1_000_003**k for k, c in enumerate(reversed(chars))) % 2**64

        def score(word):
            marked, found = f"^{word}$", [(1, sum(ord(c) * 1_000_003**k for k, c in enumerate(f"^{word}$")) % 2**64)]
            for k in (1, 2, 3):
                found += [(10 + k, hash_of(marked[i : i + k])) for i in range(len(marked) - k + 1)]
            found += [(20 + k, hash_of(word[:k])) for k in (1, 2, 3) if len(word) >= k]
            found += [(30 + k, hash_of(word[-k:])) for k in (1, 2, 3, 4) if len(word) >= k]
            found += [(2, field.lexicon[word])] if word in field.lexicon else []
            return sum(field.weight[langid._bucket(kind, np.array([v], np.uint64))[0]] for kind, v in found)

        known = {}

        def shares(words):
            emit = np.array([known[w] if w in known else known.setdefault(w, score(w)) for w in words])
            add = lambda x, axis: np.log(np.exp(x - x.max()).sum(axis=axis)) + x.max()
            ahead, back = [field.start + emit[0]], [np.zeros(len(field.langs))]
            for e in emit[1:]:
                ahead.append(add(ahead[-1][:, None] + field.step, 0) + e)
            for e in emit[:0:-1]:
                back.append(add(field.step + (e + back[-1])[None, :], 1))
            both = np.array(ahead) + np.array(back[::-1])
            both = np.exp(both - both.max(axis=1, keepdims=True))
            return (both / both.sum(axis=1, keepdims=True)).mean(axis=0)

        texts = {r["doc_id"]: r["text"] for r in table.select("doc_id", "text").collect()}
        got = QUERIES["op7_langid"](spark, sf).collect()
        assert len(got) == len(texts)
        for row in got:
            words = re.findall(r"[^\W\d_]{1,32}", (texts[row["doc_id"]] or "").lower())
            if len(words) > 3000:
                continue
            want = shares(words) if words else np.zeros(len(field.langs))
            assert row["score"] == pytest.approx(want.max(), abs=1e-6)
            assert row["lang_pred"] == (field.langs[want.argmax()] if words else "und")

    def test_code_switched_text(self):
        english, french = "the house and of with that from is".split(), "maison avec dans les une pour est que".split()
        field = langid.fit([english * 20, french * 20], ["en", "fr"])
        shares = langid.Labeller(field).shares([" ".join(english * 3 + french * 6), " ".join(english), None, "123"])
        assert field.langs == ["en", "fr"] and 0.25 < shares[0, 0] < 0.45 and shares[1, 0] > 0.9 and not shares[2:].any()

    def test_awkward(self, spark):
        rows = awkward(spark)
        got = {r["doc_id"]: r for r in langid.predict(rows, langid.train(rows)).collect()}
        assert got[1]["lang_pred"] == got[6]["lang_pred"] == "und" and got[1]["score"] == 0
        none = langid.predict(rows, langid.train(rows.withColumn("lang", F.lit(None).cast("string")))).select("lang_pred").distinct().collect()
        assert [r[0] for r in none] == ["und"] and langid.predict(rows.limit(0), None).count() == 0


class TestNeighbours:
    def brute(self, rows, every=50, k=5):
        ids = [i for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
        x = {i: np.array(v, float) for i, v in rows if i in set(ids)}
        out = []
        for q in ids:
            if q % every == 0:
                near = sorted((-float(np.dot(x[q], x[c]) / np.linalg.norm(x[q]) / np.linalg.norm(x[c])), c) for c in ids if c != q)[:k]
                out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(near)]
        return sorted(out)

    def test_against_brute_force_with_awkward_rows(self, spark):
        rng = np.random.default_rng(2)
        rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(0, 400, 2)] + [(401, [0.0] * 8), (403, [float("nan")] * 8), (405, None), (407, [1.0, None] + [0.0] * 6), (409, [1.0]), (None, [1.0] * 8), (411, [float("inf")] + [0.0] * 7)]
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), epsilon=4.0).collect())
        want = self.brute(rows)
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)

    def test_copies_go_to_the_smallest_ids(self, spark):
        rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)]
        got = [(r["rank"], r["vec_id"]) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)).where("query_id = 0").collect()]
        assert sorted(got) == [(n, n) for n in range(1, 6)]

    def test_repeated_rows_count_once(self, spark):
        rng = np.random.default_rng(8)
        rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
        frame = spark.createDataFrame(rows * 3, "vec_id long, embedding array<double>").repartition(5)
        once = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=7, epsilon=4.0)
        assert sorted(map(tuple, ann.nearest(frame, every=7, epsilon=4.0).collect())) == sorted(map(tuple, once.collect()))

    def test_many_copies_of_the_nearest_row(self, spark):
        rng = np.random.default_rng(12)
        rows = [(0, rng.standard_normal(128))]
        rows += [(i, rows[0][1] + (0.05 if i == 1 else 0.3 + 0.15 * i) * rng.standard_normal(128)) for i in range(1, 7)]
        rows += [(i, rng.standard_normal(128)) for i in range(7, 60)]
        rows = [(i, v.tolist()) for i, v in rows]
        frame = spark.createDataFrame(rows + [rows[1]] * 9, "vec_id long, embedding array<double>").coalesce(1)
        got = [r["vec_id"] for r in ann.nearest(frame, every=1000).orderBy("rank").collect()]
        x = np.array([v for _, v in rows])
        score = x @ x[0] / np.linalg.norm(x, axis=1)
        assert got == np.argsort(-score)[1:6].tolist()

    def test_recall(self, spark, sf):
        rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
        x = np.array([v for _, v in rows], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids = np.array([i for i, _ in rows])
        got = {}
        for r in QUERIES["op8_ann"](spark, sf).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = []
        for q in np.flatnonzero(ids % 50 == 0):
            s = x @ x[q]
            s[q] = -2
            hits.append(len(got[ids[q]] & set(ids[np.argsort(-s)[:5]].tolist())) / 5)
        assert np.mean(hits) >= 0.9

    def test_blocks_and_empty(self, spark):
        rng = np.random.default_rng(2)
        frame = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(120)], "vec_id long, embedding array<double>")
        key = lambda df: sorted(tuple(r) for r in df.collect())
        assert key(ann.nearest(frame, every=3, query_rows=7, chunk=16)) == key(ann.nearest(frame, every=3))
        assert ann.nearest(frame.limit(0)).count() == 0 and ann.nearest(frame.where("vec_id = 1")).count() == 0


class TestQuality:
    def test_pool_adjacent(self):
        got = quality.pool_adjacent(np.array([1.0, 3.0, 2.0, 4.0]), np.array([1.0, 1.0, 3.0, 1.0]))
        assert np.allclose(got, [1, 2.25, 2.25, 4])

    def test_partition_sums_match_the_whole(self, spark):
        rng = np.random.default_rng(0)
        x = rng.standard_normal((300, quality.STATS))
        y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
        frame = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "stats array<double>, label double")
        one, many = quality.fit(frame.coalesce(1)), quality.fit(frame.repartition(7))
        assert np.allclose(one.weight, many.weight) and np.mean((one.score(x) >= 0.5) == y) > 0.9

    def test_held_out(self, spark, sf):
        folder = sf.replace("0.001", "0.01")
        truth = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()}
        got = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in QUERIES["op9_quality"](spark, folder).collect() if r["held_out"] and r["doc_id"] in truth]
        good, bad = [s for s, y, _ in got if y], [s for s, y, _ in got if not y]
        assert np.mean([[a > b or (a == b) / 2 for b in bad] for a in good]) > 0.9 and np.mean([y == p for _, y, p in got]) > 0.85

    def test_awkward(self, spark):
        labels = spark.createDataFrame([(1, None), (2, 1), (None, 1), (5, 0), (4, 7)], "doc_id long, quality int")
        got = quality.score_documents(awkward(spark), labels).collect()
        assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
        assert {r["score"] for r in quality.score_documents(awkward(spark), labels.limit(0)).collect()} == {0.5}
        assert quality.score_documents(awkward(spark).limit(0), labels).count() == 0


    def test_fit_against_brute_force(self, spark):
        """Normal equations, calibration and scores by plain least squares over all rows at once."""
        rng = np.random.default_rng(9)
        x = rng.standard_normal((400, quality.STATS)) * 3 + 1
        y = (x[:, 0] + 0.7 * x[:, 1] > 2).astype(float)
        frame = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "stats array<double>, label double").repartition(5)
        model = quality.fit(frame, features=64)
        z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -6, 6)
        lifted = np.hstack([np.ones((400, 1)), z / math.sqrt(quality.STATS), np.cos(z @ model.turn + model.shift) * math.sqrt(2 / 64)])
        assert np.allclose(model.lift(x), lifted)
        want, *_ = np.linalg.lstsq(np.vstack([lifted, math.sqrt(1e-4 * 400) * np.eye(lifted.shape[1])]), np.append(y, np.zeros(lifted.shape[1])), rcond=None)
        assert np.allclose(model.weight, want, atol=1e-8)
        raw, order = lifted @ want, np.argsort(lifted @ want)
        assert (np.diff(model.score(x)[order]) >= -1e-12).all() and np.mean((model.score(x) > 0.5) == y) > 0.9
        means = [y[(raw >= lo) & (raw < lo + 0.25)].mean() for lo in np.arange(0, 1, 0.25)]
        got = [model.score(x)[(raw >= lo) & (raw < lo + 0.25)].mean() for lo in np.arange(0, 1, 0.25)]
        assert np.allclose(got, means, atol=0.12)

    def test_query_against_brute_force(self, spark, sf):
        texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
        labels = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
        learned = [(quality.statistics(texts[d]), float(y)) for d, y in labels if y is not None and d in texts and zlib.crc32(str(d).encode()) % 5]
        model = quality.fit(spark.createDataFrame(learned, "stats array<double>, label double").coalesce(1))
        want = model.score(np.array([quality.statistics(t) for t in texts.values()]))
        got = {r["doc_id"]: r for r in QUERIES["op9_quality"](spark, sf).collect()}
        assert [got[d]["score"] for d in texts] == pytest.approx(want.tolist(), abs=1e-6)
        assert all(r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())


class TestContamination:
    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.sampled_from("abcde"), max_size=10), st.lists(st.sampled_from("abcde"), max_size=14))
    def test_subsequence_length(self, a, b):
        assert contamination.common_length(contamination.mask(a), len(a), b) == len(licenses.common_subsequence(a, b))

    def corpus(self, seed=4):
        draw = random.Random(seed)
        common = [f"c{i}" for i in range(40)]
        make = lambda n: [draw.choice(common) if draw.random() < 0.5 else f"r{draw.randrange(10**6)}" for _ in range(n)]
        items = {i: make(draw.randrange(18, 60)) for i in range(30)}
        rows, want = [], set()
        for d in range(200):
            words = make(draw.randrange(50, 900))
            if d % 4 == 0:
                item = d % 30
                leak = list(items[item])
                if d % 8 == 0:  # a paraphrase: some words replaced, two swapped
                    for k in draw.sample(range(len(leak)), len(leak) // 8):
                        leak[k] = "changed"
                at = draw.randrange(len(words))
                words[at:at] = leak
                want.add((d, item))
            rows.append((d, " ".join(words).replace(" r1", ". R1")))
        return rows, {i: " ".join(w).capitalize() + "?" for i, w in items.items()}, want

    @pytest.mark.parametrize("block", [4096, 8])
    def test_exact_and_paraphrased_items(self, spark, block):
        rows, items, want = self.corpus()
        bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in contamination.find_leaks(docs(spark, rows).repartition(3), bench, block=block).collect()}
        assert got == want

    def test_thousands_of_items(self, spark):
        draw = random.Random(6)
        make = lambda n: [f"w{int(20_000 * draw.random() ** 3)}" for _ in range(n)]
        items = [make(draw.randrange(15, 60)) for _ in range(2000)]
        rows = [(i, " ".join(make(200) + x + make(200))) for i, x in enumerate(items)]
        bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in contamination.find_leaks(docs(spark, rows), bench).collect()}
        assert {(i, i) for i in range(2000)} <= got and len(got) <= 2010

    def test_items_of_any_length(self, spark):
        draw = random.Random(9)
        make = lambda n: [f"w{int(20_000 * draw.random() ** 3)}" for _ in range(n)]
        items = [make(n) for n in (2, 3, 4, 5, 6, 8, 12, 17, 33, 100, 600, 1000) for _ in range(8)]
        rows = [(i, " ".join(make(200 + i % 16) + x + make(200))) for i, x in enumerate(items)]
        bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in contamination.find_leaks(docs(spark, rows), bench).collect()}
        assert {(i, i) for i in range(len(items))} <= got

    def test_candidates_against_brute_force(self):
        """Every passage whose full cosine reaches the threshold is a candidate, whatever the rank."""
        draw = random.Random(21)
        make = lambda n: [int(3000 * draw.random() ** 3) + 1 for _ in range(n)]
        items = [(i, make(draw.randrange(15, 32))) for i in range(500)]
        texts = [np.array(make(draw.randrange(40, 400)), np.uint16) for _ in range(60)]
        texts += [np.concatenate([texts[i][:50], np.array(items[i][1], np.uint16), texts[i][50:]]) for i in range(60)]
        weight = np.log(3002 / (1 + np.arange(3002))) + 1
        weight[0] = 0
        total = np.zeros((3002, 32))
        omega = np.random.default_rng(1).standard_normal((3002, 32))
        contamination.add_sketch(total, contamination.blocks_of(texts)[0], weight, (weight[:, None] * omega).astype(np.float32))
        basis = np.linalg.qr(total * weight[:, None])[0]
        index = contamination.Index(weight, basis, items, 0.3, 0.9, 0.8, 0.5, 0.6, 0.4)
        got = {(d, s, i) for d, s, i, _ in index.candidates(texts)}
        vectors = np.zeros((500, 3002))
        for i, words in items:
            np.add.at(vectors[i], words, weight[words])
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        want = set()
        for d, text in enumerate(texts):
            padded = np.concatenate([text.astype(int), np.zeros(32, int)])
            for s in range(0, len(text), 16):
                passage = padded[s : s + 32]
                inside = np.zeros(3002)
                np.add.at(inside, passage, weight[passage])
                near = vectors @ inside / math.sqrt((weight[passage] ** 2).sum())
                want |= {(d, s, int(i)) for i in np.flatnonzero(near >= 0.3001)}
        assert len(want) > 200 and want <= got

    def test_latent_basis_spans_the_leading_directions(self, spark):
        rng = np.random.default_rng(5)
        topics = [rng.choice(np.arange(1, 201), 20, replace=False) for _ in range(6)]
        texts = [np.concatenate([rng.choice(topics[rng.integers(6)], 32) for _ in range(4)]).astype(np.uint16) for _ in range(300)]
        frame = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "w binary").repartition(3)
        weight = np.ones(201)
        weight[0] = 0
        basis = contamination.latent_basis(frame, [], weight, 24)
        ids, _ = contamination.blocks_of(texts)
        full = np.zeros((len(ids), 201))
        np.add.at(full, (np.repeat(np.arange(len(ids)), 16), ids.ravel()), weight[ids.ravel()])
        full = full[:-1] + full[1:]
        norm = contamination.passage_norms((weight**2)[ids].sum(axis=1))
        full = full[norm > 0] / norm[norm > 0, None]
        _, _, right = np.linalg.svd(full, full_matrices=False)
        assert np.linalg.norm(right[:6] @ basis, axis=1).min() > 0.97 and np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-8)

    def test_passages_alike_in_the_latent_space_are_candidates(self):
        """A paraphrase in other words of the same topic shares no word with the item."""
        rng = np.random.default_rng(7)
        topics = [np.arange(1 + 40 * t, 41 + 40 * t) for t in range(5)]
        texts = [rng.choice(topics[k % 5], 64).astype(np.uint16) for k in range(400)]
        weight = np.ones(202)
        weight[0] = 0
        total, omega = np.zeros((202, 8)), rng.standard_normal((202, 8))
        omega[0] = 0
        contamination.add_sketch(total, contamination.blocks_of(texts)[0], weight, omega.astype(np.float32))
        index = contamination.Index(weight, np.linalg.qr(total)[0], [(0, list(range(1, 17)))], 0.3, 0.8, 0.8, 0.5, 0.6, 0.4)
        got = {d for d, _, _, _ in index.candidates([np.arange(17, 41, dtype=np.uint16), np.arange(50, 80, dtype=np.uint16)])}
        assert got == {0}

    def test_one_word_items(self, spark):
        bench = spark.createDataFrame([(1, "zebra")], "item_id long, text string")
        rows = [(1, "a " * 300 + "zebra " + "b " * 300), (2, "no such word")]
        assert [r["doc_id"] for r in contamination.find_leaks(docs(spark, rows), bench).collect()] == [1]

    def test_words_of_a_short_item_far_apart(self, spark):
        rows = [(1, "alpha " + "x " * 12 + "beta"), (2, "x x alpha beta x"), (3, "y " * 30)]
        bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
        assert [r["doc_id"] for r in contamination.find_leaks(docs(spark, rows), bench).collect()] == [2]

    def test_exact_passages_of_the_tables(self, spark, sf):
        folder = sf.replace("0.001", "0.01")
        texts = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        items = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
        want = {(d, i) for i, x in items for d, t in texts if x in t}
        got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op10_decontamination"](spark, folder).collect()}
        assert want <= got and len(got) <= len(want) + 3

    def test_awkward(self, spark):
        bench = spark.createDataFrame([(1, None), (2, "!!"), (None, "word word"), (3, "Twice the same row here")], "item_id long, text string")
        got = [(r["doc_id"], r["item_id"]) for r in contamination.find_leaks(awkward(spark), bench).collect()]
        assert got == [(5, 3)]
        assert contamination.find_leaks(awkward(spark), bench.limit(0)).count() == 0 and contamination.find_leaks(awkward(spark).limit(0), bench).count() == 0


class TestHotJoin:
    @pytest.mark.parametrize("how", ["inner", "left"])
    def test_heavy_and_light_keys_together(self, spark, monkeypatch, how):
        monkeypatch.setattr(common, "HOT", 4)
        rows = spark.range(300).select(F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 20).alias("k"), F.col("id").alias("x"))
        counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 7").select("k", "n", (F.col("k") * 10).alias("v"), F.lit(None).cast("string").alias("w"))
        got = common.hot_join(rows, counts, ["k"], "n", 300, how)
        want = rows.join(counts.drop("n"), ["k"], how)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, got.select("k", "x", "v", "w").collect())) == sorted(map(str, want.select("k", "x", "v", "w").collect()))
        assert got.count() == (300 if how == "left" else rows.where("k <> 7").count())


class TestComponents:
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
    def test_against_union_find(self, spark, edges):
        parent = list(range(31))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        touched = {x for a, b in edges if a != b for x in (a, b)}
        got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in touched}

    def test_a_long_path(self, spark):
        edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        assert components.connected_components(edges).where("component <> 0").count() == 0


class TestWorkers:
    def test_a_task_leaves_no_freed_memory_with_its_worker(self, spark):
        def memory():
            with open("/proc/self/smaps_rollup") as f:
                return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon:")) / 1024

        def report(pids, mb):
            return pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), pa.array(mb, pa.float64())], ["pid", "mb"])

        def large(batches):
            for _ in batches:
                before, taken = memory(), []
                os._pins = []  # 24 MB that stay, strewn among 150 MB that do not
                for _ in range(1500):
                    taken.append(np.ones(12_800))
                    os._pins.append(np.ones(2_000))
                yield report([os.getpid()], [before])

        def small(batches):
            for _ in batches:
                yield report([os.getpid()], [memory()])

        rows = spark.range(8).repartition(8)
        first = sorted(common.in_arrow(rows, large, "pid long, mb double").collect(), key=lambda r: -r["mb"])
        before = {r["pid"]: r["mb"] for r in first}  # as each worker began
        after = {r["pid"]: r["mb"] for r in common.in_arrow(rows, small, "pid long, mb double").collect()}
        both = before.keys() & after.keys()
        assert both and all(after[p] - before[p] < 75 for p in both)
