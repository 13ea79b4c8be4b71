from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import token_counts, tokens

SCHEMA = "source string, lang string, tokenizer_version string, op string, n_tokens long, old_tokens long, text string"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_batches(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    r = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    assert totals(r) == {}
    load = frame([("s", "en", "1", "insert", 5, None, "t"), ("s", "en", "1", "insert", 7, None, "t"), (None, None, "1", "insert", None, None, None), ("s", "en", "1", "odd", 9, None, "")])
    assert r.commit("a", load) and not r.commit("a", load)
    assert totals(r) == {("s", "en", "1"): (2, 12), (None, None, "1"): (1, 0)}
    assert r.commit("b", frame([("s", "en", "1", "revise", 4, 5, "t"), ("s", "en", "1", "delete", 7, None, "t"), (None, None, "1", "delete", None, None, None), ("s", "en", "2", "insert", 3, None, "t")]))
    assert totals(r) == {("s", "en", "1"): (1, 4), ("s", "en", "2"): (1, 3)}
    r.compact()
    assert not r.commit("a", load) and not r.commit("b", load)
    assert totals(r) == {("s", "en", "1"): (1, 4), ("s", "en", "2"): (1, 3)}
    assert r.commit("c", frame([("s", "en", "1", "insert", 1, None, "t")]).limit(0)) and r.commit("d", frame([("s", "en", "1", "insert", 1, None, "t")]))
    r.compact()
    assert totals(r)[("s", "en", "1")] == (2, 5)
    again = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    assert all(again.committed(b) for b in "abcd") and not again.committed("e")
    r.compact()
    assert all(again.committed(b) for b in "abcd") and not r.commit("a", load) and totals(r)[("s", "en", "1")] == (2, 5)


def test_frames_outlive_a_compaction(spark, tmp_path):
    """op4: totals that were asked for before a compaction can be read after it."""
    r = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    one = spark.createDataFrame([("s", "en", "1", "insert", 5, None, "t")], SCHEMA)
    for b in ("a", "b"):
        r.commit(b, one)
        before = r.totals()
        r.compact()
        assert [x.n_tokens for x in before.collect()] == [x.n_tokens for x in r.totals().collect()]
    with pytest.raises(ValueError):
        r.commit("../x", one)
    with pytest.raises(ValueError):
        r.commit(None, one)


def test_a_died_compaction_counts_once(spark, tmp_path):
    r = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    r.commit("a", spark.createDataFrame([("s", "en", "1", "insert", 5, None, "t")], SCHEMA))
    (tmp_path / "r" / "pending" / "died" / "totals").mkdir(parents=True)
    r.compact()  # the delta is still there, and the base has it
    assert (tmp_path / "r" / "deltas" / "a").exists() and totals(r) == {("s", "en", "1"): (1, 5)}


def test_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([("s", "en", "1", "insert", 5, None, "x", "y")], "Source string, lang string, tokenizer_version string, op string, n_tokens long, old_tokens long, OP string, LANG string")
    assert [tuple(r) for r in token_counts.signed(df).collect()] == [("s", "en", "1", 1, 5)]
    more = spark.createDataFrame([(1, "a b", "T", 9)], "k int, text string, Text string, N_Tokens int")
    assert tokens.count_tokens(more).columns == ["k", "n_tokens"]


def test_very_long_text(spark):
    df = spark.createDataFrame([("a b " * 5_000_000,), ("x" * 1_000_000,)], "text string")
    assert sorted(r.n_tokens for r in tokens.count_tokens(df).collect())[-1] == 10_000_000


def test_query(spark, sf):
    exact = Tokenizer.from_file(tokens.default_path())
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        k = (r.source, r.lang, "word_bpe_49k")
        n, t = want.get(k, (0, 0))
        want[k] = (n + 1, t + len(exact.encode(r.text, add_special_tokens=False).ids) + 1)
    got = token_counts.op4_token_counts(spark, sf).collect()
    assert {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in got} == want


def test_counts_keep_columns(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 8), (3, "a b", 7)], "k int, text string, n_tokens int")
    assert [(r.k, r.n_tokens) for r in tokens.count_tokens(df).orderBy("k").collect()] == [(1, 0), (2, 0), (3, 2)]
    assert tokens.count_tokens(df.where(F.lit(False))).count() == 0
