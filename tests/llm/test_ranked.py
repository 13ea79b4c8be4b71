"""Ranked search against brute force: ties, odd rows, small segments and blocks."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ranked
from tessera.llm.common import durable

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    bags = [Counter(words(t)) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in set(items):
        hits = []
        for (doc, _), bag, size in zip(docs, bags, sizes, strict=True):
            if not size:
                continue
            m = 100 - 75 + 75 * size * n // total
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m)) for t, c in Counter(words(text)).items() if t in bag)
            if score > 0:
                hits.append((-score, doc is None, doc))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(hits, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, parts=3, k=10):
    rows = durable(ranked.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)), "segments")
    return sorted((tuple(r) for r in ranked.search(rows, spark.createDataFrame(items, "item_id long, text string"), k).collect()), key=repr)


@pytest.fixture
def corpus():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "éa", "ñ", "汉字", "The", "THE"]
    odds = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, r.choice([" ", "-", "\n", "\x00"]).join(r.choices(vocabulary, odds, k=r.choice([0, 1, 5, 40, 200])))) for i in range(400)]
    docs += [(1000 + i, "same words in every copy w3 w59") for i in range(60)]  # ties
    docs += [(None, None), (None, "w7 w8"), (5, "w7 w8"), (5, "w7 w8"), (2000, "w1 " * 9000), (2001, "")]
    items = [(i, " ".join(r.choices(vocabulary, k=8))) for i in range(25)]
    items += [(100, "copy same w59"), (101, ""), (102, None), (103, "absent"), (104, "w7"), (104, "w7"), (104, "w8 w8 w9"), (None, "w2"), (105, "the The THE")]
    return docs, items


def test_equals_brute_force(spark, corpus):
    assert run(spark, *corpus) == brute(*corpus)


def test_small_segments_leaves_and_blocks(spark, corpus, monkeypatch):
    """The limits change no row: short segments, deep trees, few cells, blocks of a few queries."""
    expected = brute(*corpus)
    for name, value in {"BLOCK": 3, "BLOCK_TERMS": 20, "CELLS": 50}.items():
        monkeypatch.setattr(ranked, name, value)
    assert run(spark, *corpus) == expected
    docs, items = corpus
    searcher = None
    for leaf, fan, size in ((1, 2, 7), (3, 2, 64), (4, 3, 1000)):
        monkeypatch.setattr(ranked, "LEAF", leaf)
        monkeypatch.setattr(ranked, "FAN", fan)
        bags = [ranked.terms(t) for _, t in docs]
        n, total = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
        df = Counter(t for b in bags for t in b)
        asked = {i: [(t.decode(), c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t, c in ranked.terms(text).items() if t in df] for i, (_, text) in enumerate(items)}
        searcher = ranked.Searcher(asked, 10, n, total)
        for at in range(0, len(docs), size):
            part = bags[at : at + size]
            postings = {}
            for j, b in enumerate(part):
                for t, c in b.items():
                    postings.setdefault(t.decode(), ([], []))[0].append(j)
                    postings[t.decode()][1].append(c)
            searcher.segment([d for d, _ in docs[at : at + size]], [sum(b.values()) for b in part], {t: (np.array(a), np.array(c, np.int64)) for t, (a, c) in postings.items()})
        got = sorted(((items[q][0], i + 1, None if null else d, -s) for q, best in searcher.best.items() for i, (s, null, d) in enumerate(best)), key=repr)
        assert sorted(set(got), key=repr) == sorted(set(expected), key=repr)
    assert searcher.leaves < len(items) * len(docs) / 4  # some ranges were never opened


def test_segments_hold_every_document(spark):
    docs = spark.createDataFrame([(i, "hot " + "x" * (i % 3)) for i in range(95)], "doc_id long, text string").repartition(2)
    rows = ranked.index(docs)
    assert rows.where("term IS NULL").agg(F.sum(F.size("ids"))).first()[0] == 95
    assert rows.where("term = 'hot'").agg(F.sum("df")).first()[0] == 95


def test_odd_tables(spark):
    """Empty tables, clashing names, k above the number of hits."""
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [(1, None)], [(1, "a")]) == []
    docs = spark.createDataFrame([(1, "a b", 3, "s")], "Doc_ID long, text string, rank int, segment string")
    rows = durable(ranked.index(docs), "segments")
    got = ranked.search(rows, spark.createDataFrame([(9, "b", 1)], "item_id long, text string, query int"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and [(r.item_id, r.doc_id) for r in got.collect()] == [(9, 1)]
    assert ranked.terms("A-bÉ a" + "z" * 50) == {b"a": 1, "bÉ".encode(): 1, b"a" + b"z" * 50: 1}


def test_long_text_in_slices(monkeypatch):
    text = "alpha beta, Gamma " * 300
    whole = ranked.terms(text)
    monkeypatch.setattr(ranked, "_SLICE", 13)
    assert ranked.terms(text) == whole == {b"alpha": 300, b"beta": 300, b"gamma": 300}
