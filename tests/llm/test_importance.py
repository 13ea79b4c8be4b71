"""Importance resampling against brute force: whole texts, odd rows, pieces of long texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, run=2):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=25, least=20):
    bag = lambda text: Counter(zlib.crc32(f.encode()) % 10000 for f in features(text))
    mine, s, t = [bag(text) for _, text in docs], Counter(), Counter()
    for b in mine:
        s += b
    for text in target:
        t += bag(text)
    S, T = sum(s.values()), sum(t.values())
    out = []
    for (doc, text), b in zip(docs, mine, strict=True):
        n = sum(b.values())
        gain = sum(c * math.floor(1000 * math.log((t[k] + 1) * (S + 10000) / ((s[k] + 1) * (T + 10000)))) for k, c in b.items())
        weight = gain // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(features(text, 1))])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def run(spark, docs, target, **given):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(d, t, **given)
    return [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]


def test_equals_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["the", "The", "Éa", "éa", "x1", "ñandú", "1", "汉字", "of", "K"]
    docs = [(i, r.choice([" ", "\n", ", "]).join(r.choices(vocabulary, k=r.choice([0, 1, 19, 20, 60])))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "... --\x00"), (503, "one"), (504, "word " * 5000)]
    target = ["of the x1 of the", None, "", "汉字 éa"]
    assert sorted(run(spark, docs, target), key=repr) == sorted(brute(docs, target), key=repr)


def test_long_texts_in_pieces(spark, monkeypatch):
    """Cuts at any place count every run once, also with longer runs than two words."""
    r = random.Random(5)
    texts = [" ".join(r.choices(["a", "bb", "ccc", "é", "dddddddd"], k=400)), "x" * 300 + " y", ", ".join(["q"] * 90), " " * 500, "end "]
    for run_length in (1, 2, 3):
        whole = [importance._Counter(10000, run_length).count([t]) for t in texts]
        monkeypatch.setattr(importance, "PIECE", 37)
        monkeypatch.setattr(importance, "AT_ONCE", 100)
        for t, expected in zip(texts, whole, strict=True):
            got = importance._Counter(10000, run_length).count([t])
            assert [x.tolist() for x in got] == [x.tolist() for x in expected]
            bag = Counter(zlib.crc32(f.encode()) % 10000 for f in features(t, run_length))
            assert dict(zip(got[1].tolist(), got[2].tolist(), strict=True)) == bag
        monkeypatch.undo()


def test_odd_rows(spark):
    """Repeated rows, null ids, ties, clashing names, empty tables."""
    text = "alpha beta " * 15
    docs = [(1, text), (1, text), (None, text), (2, text), (3, text), (4, text), (5, None), (6, text)]
    got = run(spark, docs, ["alpha"])
    assert len(got) == 8
    assert sorted(r[4] for r in got if r[4]) == [1]
    same = spark.createDataFrame([(7, text, 1, 2)] * 8, "doc_id long, Text string, Rank int, buckets int")
    out = importance.resample(same, spark.createDataFrame([], "text string"))
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(r["rank"] or 0 for r in out.collect()) == [0] * 6 + [1, 2]
    assert run(spark, [], ["a"]) == []
    assert run(spark, [(1, "a")], []) == [r for r in brute([(1, "a")], [])]


@pytest.mark.parametrize("percent", [0, 50, 100])
def test_share_drawn(spark, percent):
    docs = [(i, " ".join(f"w{i * j % 11}" for j in range(25))) for i in range(40)]
    assert sorted(run(spark, docs, ["w1 w2"], percent=percent), key=repr) == sorted(brute(docs, ["w1 w2"], percent), key=repr)
