from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tessera.llm import rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    seen = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {j for i in range(n - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def counted(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return rules.features(df)


def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "\x0b\x0ca\x0b b\r\n", "é x # | <>", "a b c d e\na b c d e\n\na b c d e", "x " * 12, "😀 😀", *("".join(rng.choice(["a ", "b ", "c\n", "d\t", "é "]) for _ in range(rng.randrange(120))) for _ in range(60)), "one two three four five six " * 3000]
    got = {r.doc_id: tuple(r[c] for c in rules.BASE) for r in counted(spark, texts).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_no_python(spark, sf):
    plan = rules.op2_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_em_finds_the_accuracies():
    rng = random.Random(7)
    rates = [(0.9, 0.02), (0.85, 0.05), (0.7, 0.1), (0.95, 0.03)]
    rows = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        rows[tuple((1 if (rng.random() < a) == good else -1) if rng.random() < 0.7 else 0 for a, _ in rates)] += 1
    m = rules.fit(list(rows.items()), 100)
    assert m.prior == pytest.approx(0.8, abs=0.05)
    assert [x == pytest.approx(a, abs=0.06) for x, (a, _) in zip(m.accuracy(), rates, strict=True)] == [True] * 4


def test_posterior_replaces_all_must_pass(spark, sf):
    got = rules.judge(rules.features(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(not r.kept for r in got if r.base_failed)
    assert any(r.kept and any(r[f"vote_{x.name}"] == -1 for x in rules.RULES) for r in got)
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.5


def test_nothing(spark):
    assert rules.judge(counted(spark, ["x"]).limit(0)).count() == 0
    r = rules.judge(counted(spark, [None])).first()
    assert r.base_failed and not r.kept and r.n_words == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "T", 9, "w", 3, 4)], "doc_id long, text string, Text string, N_Words int, _w string, vote_length int, Kept int")
    assert rules.features(df).first().n_words == 2 and rules.features(df).columns[:4] == ["doc_id", "_w", "vote_length", "Kept"]
    got = rules.judge(rules.features(df))
    assert got.columns.count("vote_length") == 1 and "Kept" not in got.columns and got.first()["_w"] == "w" and got.first().kept is False


def test_very_long_text(spark):
    """op2: 20 MB in one text, and repeated rows."""
    text = " ".join(f"w{i % 100_000}" for i in range(3_000_000))
    got = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string").unionByName(spark.sql("SELECT 2L AS doc_id, concat_ws(' ', transform(sequence(0, 2999999), i -> concat('w', i % 100000))) AS text"))
    rows = rules.features(got).collect()
    assert sorted(r.n_words for r in rows) == [3, 3, 3_000_000] and max(r.n_repeat_words for r in rows) == 3_000_000 and max(r.word_chars for r in rows) == len(text.replace(" ", ""))


def test_query_equals_oracle(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.execute(rules.ORACLE_OP2)
    names = [x[0] for x in want.description]
    got = rules.op2_quality_rules(spark, sf)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


