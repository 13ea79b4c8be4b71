from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing, tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_uses_everything_once(lengths):
    counts = np.bincount(lengths, minlength=41)
    used = np.zeros(41, int)
    for pattern, times in packing.plan(counts, 40):
        assert sum(pattern) <= 40 and times > 0
        np.add.at(used, list(pattern), times)
    assert (used == counts).all()


def test_exact_complements_come_first():
    counts = np.zeros(101, int)
    counts[[100, 60, 40, 50, 30, 20, 25]] = [2, 3, 2, 1, 1, 1, 2]
    patterns = packing.plan(counts, 100)
    assert ((60, 40), 2) in patterns and any(p[0] == 50 and sum(p) == 100 for p, _ in patterns)


def one_by_one(lengths, capacity):
    """The sequences that exact complements, then best fit, make one piece after another."""
    left, out = Counter(lengths), []

    def take(*xs):
        if all(left[x] >= k for x, k in Counter(xs).items()):
            left.subtract(xs)
            return True
        return False

    def exact(gap):
        if gap == 0 or take(gap):
            return [gap] * (gap > 0)
        for a in range(gap - 1, 0, -1):
            if 2 * a >= gap and take(a, gap - a):
                return [a, gap - a]
        for a in range(gap - 2, 0, -1):
            for b in range(min(a, gap - a - 1), 0, -1):
                c = gap - a - b
                if c <= b and take(a, b, c):
                    return [a, b, c]
        return None

    for first in range(capacity, 0, -1):
        while take(first):
            rest = exact(capacity - first)
            if rest is None:
                left[first] += 1
                break
            out.append([first, *rest])
    for first in range(capacity, 0, -1):
        while take(first):
            seq = [first]
            while fits := [x for x in range(1, capacity - sum(seq) + 1) if left[x]]:
                take(fits[-1])
                seq.append(fits[-1])
            out.append(seq)
    return sorted(out)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_plan_equals_brute_force(lengths):
    counts = np.bincount(lengths, minlength=25)
    assert sorted(list(p) for p, times in packing.plan(counts, 24) for _ in range(times)) == one_by_one(lengths, 24)


def test_rows_equal_brute_force(spark):
    """op10: the pieces of a table are placed in just the sequences that the brute force makes."""
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 25, 300).tolist()
    df = spark.createDataFrame([(i, 0, n, "s") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, Offset string")
    by = {}
    for r in sorted(packing.pack(df, 24).collect(), key=lambda r: r.offset):
        seq = by.setdefault(r.sequence_id, [])
        assert r.offset == sum(seq)
        seq.append(r.length)
    assert sorted(by.values()) == one_by_one(lengths, 24)


def test_runs_beyond_the_salts(spark):
    """pipeline: pieces of a length are placed run by run, however many runs there are."""
    df = spark.createDataFrame([(i, i * 7919 % 1200, 5) for i in range(1200)], "doc_id long, run int, length long")
    rows = packing.pack(df, 10, order_by=("run", "doc_id"), run_of="run").collect()
    assert [r.run for r in sorted(rows, key=lambda r: (r.offset, r.sequence_id))] == list(range(1200))


def test_very_long_text_and_names(spark):
    df = spark.createDataFrame([(1, "a b " * 3_000_000, "T", 3), (1, "x", "U", 4)], "Doc_Id long, text string, TEXT string, Piece int")
    got = packing.pieces(df)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(r.length for r in got.collect())[:3] == [2, 3457, 4096] and got.count() == 2 + 6_000_001 // 4096


def test_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.lognormal(6, 1, 20_000).astype(int) + 1)
    counts = np.bincount(lengths, minlength=4097)
    assert sum(t for _, t in packing.plan(counts)) <= -(-lengths.sum() // 4096) + 2


def test_pack(spark, sf):
    rows = packing.op10_best_fit_packing(spark, sf).toPandas()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    exact = Tokenizer.from_file(tokens.default_path())
    assert set(rows.doc_id) == set(docs)
    for doc, g in rows.groupby("doc_id"):
        ids = [*exact.encode(docs[doc] or "", add_special_tokens=False).ids, 1]
        for r in g.sort_values("piece").itertuples():
            assert r.start == 4096 * r.piece and r.length == min(4096, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(g.length.cumsum() - g.length) and g.length.sum() <= 4096
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 4096) + 1


def test_odd_documents(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, "", 1), (None, "word " * 9000, 2), (2, "a", 3)], "doc_id long, text string, length long").select("doc_id", "text")
    got = packing.pack(packing.pieces(docs, with_ids=True)).collect()
    assert sorted(r.length for r in got) == [1, 1, 2, 809, 4096, 4096] and all(len(r.ids) == r.length for r in got)
    assert len({(r.sequence_id, r.offset) for r in got}) == 6
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


ODD = ["", " ", "\n\n", "a  b\tc d", "<|endoftext|> x<|startoftext|>y", "é ́x İ Σ ΑΣ ΑΣ.", "it's 's don't 'll", "日本 語 12 345", "\x1cab\x85c", "à\nǹb", "😀👍🏽 👍 🏽", "x" * 5000, "The, THE. a,b ,., Ärger!! ß|| ª ŉ, ǆ ﬁ"]


@pytest.mark.parametrize("text", ODD)
def test_chunks_give_the_tokenizers_ids(text):
    exact = Tokenizer.from_file(tokens.default_path())
    assert tokens.tokenizer(tokens.default_path()).encode(text) == np.array(exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text_gives_the_tokenizers_ids(text):
    exact = Tokenizer.from_file(tokens.default_path())
    assert tokens.tokenizer(tokens.default_path()).encode(text) == np.array(exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_merges_of_words_are_the_tokenizers(spark, sf):
    exact = Tokenizer.from_file(tokens.default_path())
    words = {w for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() for w in r.text.split()}
    encode = tokens.tokenizer(tokens.default_path()).encode
    assert [w for w in sorted(words) if encode(w) != np.array(exact.encode(w, add_special_tokens=False).ids, "<u4").tobytes()] == []


def test_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    t = tokens.ChunkTokenizer(tokens.default_path())
    words = [f"w{i}x" for i in range(40)]
    assert [t.encode(w) for w in words] == [t.encode(w) for w in words]
