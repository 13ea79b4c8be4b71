from __future__ import annotations

import random
import re

from tessera.llm import line_dedup


def brute(docs, long_words=None):
    seen, gone = {}, {}
    for d, text in sorted(docs.items()):
        ls = [(i, s) for i, x in enumerate(text.split("\n")) if (s := x.strip(" \t\n\x0b\x0c\r"))]
        found = [(ls[k][0], [x[0] for x in ls[k : k + 3]], tuple(x[1] for x in ls[k : k + 3])) for k in range(len(ls) - 2)]
        found += [(i, [i], (s,)) for i, s in ls if long_words and len(re.split(r"[\x20\x09-\x0D]+", s)) > long_words]
        for at, covers, key in found:
            if seen.setdefault(key, (d, at)) != (d, at):
                gone.setdefault(d, set()).update(covers)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in docs.items()}


def run(spark, docs, **given):
    df = spark.createDataFrame([(d, t, "extra") for d, t in docs.items()], "doc_id long, text string, gone string")
    out = line_dedup.dedup_lines(df, **given)
    assert out.columns == ["doc_id", "text", "gone", "n_removed"]
    return {r.doc_id: r.text for r in out.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(11)
    lines = ["a", "b", "c", " a ", "", "d e f", "long " + "w " * 60, "é", "   "]
    docs = {i: "\n".join(rng.choice(lines[: rng.randrange(3, 10)]) for _ in range(rng.randrange(12))) for i in range(80)}
    assert run(spark, docs) == brute(docs)
    assert run(spark, docs, long_words=50) == brute(docs, 50) != brute(docs)


def test_cases(spark):
    p = "one\ntwo\nthree"
    docs = {1: f"{p}\nown", 2: f"x\n{p}\n{p}", 3: "a\na\na\na\na", 4: "one\ntwo", 5: "l " * 60, 6: "z\n" + "l " * 60 + "\ny", 7: "a\nb\na\nb\na\nb"}
    got = run(spark, docs)
    assert got[1] == docs[1] and got[2] == "x" and got[3] == "a" and got[4] == docs[4] and got[5] == docs[5] and got[6] == docs[6] and got[7] == "a\nb"


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (None, "a\nb\nc", 5), (2, "a\nb\nc", 5), (2, "a\nb\nc", 5), (3, "", 0)], "doc_id long, text string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text, r.n_chars, r.n_removed) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == [(0, "a\nb\nc", 5, 0), (1, None, 0, 0), (2, "", 0, 3), (2, "", 0, 3), (3, "", 0, 0)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "\n".join(f"line {i % 300_000} of a long text" for i in range(700_000))
    docs = {1: "line 5 of a long text\nline 6 of a long text\nline 7 of a long text", 2: text, 3: "x" * 20_000_000}
    assert run(spark, docs) == brute(docs)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "A", 1, 2, 9), (2, "a\nb\nc", "B", 3, 4, 9)], "doc_id long, text string, TEXT string, _gone int, N_Removed int, N_Chars int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_gone", "N_Chars", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, "a\nb\nc", 1, 9, 0), (2, "", 3, 0, 3)]


def test_query_equals_oracle(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in c.execute(f"SELECT doc_id, text, n_removed FROM ({line_dedup.ORACLE_OP3})").fetchall()}
    assert {r.doc_id: (r.text, r.n_removed) for r in line_dedup.op3_line_dedup(spark, sf).collect()} == want
