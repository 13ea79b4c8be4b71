from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import answers, governance, incremental, knowledge, lexical, links, logs, retrieve, supersession


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25_on_nothing_and_on_ties(spark):
    none = frame(spark, [], "id long, text string")
    q = frame(spark, [(0, "fox fox")], "query_id long, text string")
    assert lexical.search(none, q).count() == 0
    docs = frame(spark, [(2, "fox"), (1, "fox"), (3, None), (4, "")], "id long, text string")
    got = lexical.top_k(lexical.search(docs, q), 5).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2] and got[0].score == got[1].score > 0


def test_fusion_keeps_list_order_on_ties(spark):
    v = frame(spark, [(0, 5, 1), (0, 7, 2)], "query_id long, id long, rank int")
    b = frame(spark, [(0, 9, 1), (0, 7, 2)], "query_id long, id long, rank int")
    got = retrieve.fuse(v, b, None, 10).orderBy("rank").collect()
    assert [r.id for r in got] == [7, 5, 9]
    lit = frame(spark, [(0, 3, 2), (0, 9, 1)], "query_id long, id long, n long")
    assert [r.id for r in retrieve.fuse(v, b, lit, 3).orderBy("rank").collect()] == [3, 9, 7]


def test_filters_come_after_the_cut(spark):
    docs = frame(spark, [(i, f"d{i % 2}/n.md", "fox", "Rag,x" if i == 9 else "storage", 100.0 * i) for i in range(10)], "id long, source string, text string, tags string, mtime double")
    q = frame(spark, [(0, "fox")], "query_id long, text string")
    assert [r.id for r in retrieve.search(docs, q, 5, mode="lexical", tag="rag").collect()] == [9]
    assert retrieve.search(docs, q, 1, mode="lexical", tag="rag").count() == 0
    assert retrieve.search(docs, q, 1, mode="lexical", tag="rag", prefilter=True).count() == 1
    assert retrieve.search(docs, q, 5, since=900.0).count() == 1
    assert retrieve.search(docs, q, 0).count() == 0


def test_feedback(spark):
    hits = frame(spark, [(0, 1, 1, 0.2), (0, 2, 2, 0.0), (0, 3, 3, None)], "query_id long, id long, rank int, distance double")
    bad = frame(spark, [(2, "bad"), (3, "bad"), (3, "bad"), (1, "good")], "chunk_id long, verdict string")
    got = {r.id: r.distance for r in retrieve.apply_feedback(hits, bad).collect()}
    assert got == {1: 0.2, 2: pytest.approx(0.65), 3: pytest.approx(0.8)}
    assert [r.id for r in retrieve.apply_feedback(hits, bad, resort=True).orderBy("rank").collect()] == [1, 2, 3]


def test_dense_ties_and_zero_vectors(spark):
    c = frame(spark, [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, None)], "id long, vec array<double>")
    q = frame(spark, [(0, [1.0, 0.0])], "query_id long, vec array<double>")
    assert [r.id for r in retrieve.dense_top_k(c, q, 3).orderBy("rank").collect()] == [1, 3]


def test_supersession_with_a_cycle(spark):
    rows = [(1, "v1", "v1.md", "", "", "2024"), (2, "v2", "v2.md", "v1", "", ""), (3, "v3", "v3.md", "v2", "", ""), (4, "p", "p.md", "q", "q", ""), (5, "q", "q.md", "p", "p", ""), (6, "x", "x.md", "ghost", "", "")]
    t = supersession.collect(frame(spark, rows, "ord long, stem string, path string, supersedes string, superseded_by string, effective string"))
    got = {}
    for r in supersession.chains(t).orderBy("start", "pos").collect():
        got.setdefault(r.start, []).append(r.stem)
    assert got["v2"] == ["v1", "v2", "v3"] and got["ghost"] == ["ghost", "x"] and len(got["p"]) == 2
    text = supersession.describe(supersession.chains(t).where("start = 'v1'")).first().history
    assert text.splitlines()[1] == "  1. v1 (effective 2024)  → superseded by" and text.endswith("3. v3")


def test_link_resolution(spark):
    notes = frame(spark, [("a/x.md",), ("b/x.md",), ("b/y.md",)], "source string")
    out = frame(spark, [("a/x.md", "Y"), ("a/x.md", "x"), ("a/x.md", "b/x"), ("b/y.md", "y"), ("b/y.md", "a/x.md")], "source string, target string")
    got = {(r.source, r.target): r.note for r in links.resolved(out, notes).collect()}
    assert got == {("a/x.md", "Y"): "b/y.md", ("a/x.md", "x"): None, ("a/x.md", "b/x"): "b/x.md", ("b/y.md", "a/x.md"): "a/x.md"}
    assert {r.label for r in links.labels(notes).collect()} == {"a/x", "b/x", "y"}


@pytest.mark.parametrize("n", [19, 20, 21, 40, 199])
def test_p95(spark, n):
    xs = [float((i * 37) % 101) for i in range(n)]
    got = frame(spark, [(xs,)], "v array<double>").select(logs.p95_exclusive(F.col("v")).alias("p")).first().p
    assert got == (pytest.approx(statistics.quantiles(xs, n=20)[-1]) if n >= 20 else None)


def test_quality_of_nothing(spark):
    q = logs.quality_snapshot(frame(spark, [], "ord long, hits int, ms double"), frame(spark, [], "verdict string")).first()
    assert (q.queries, q.zero_hit_rate, q.avg_hits, q.p95_ms, q.bad_rate) == (0, 0.0, 0.0, None, 0.0)


def test_drift_order(spark):
    s = "zero_hit_rate double, bad_rate double, avg_hits double, feedback_total long"
    got = logs.drift(frame(spark, [(0.1, 0.5, 1.0, 20)], s), frame(spark, [(0.1, 0.1, 3.0, 20)], s)).collect()
    assert [r.kind for r in got] == ["feedback_degradation", "stale_truth", "fewer_hits"]


def test_corrections_cut_at_the_last_mark(spark):
    f = frame(spark, [("a::b::3", "bad"), ("a::b::4", "bad"), ("c", "bad"), ("d::1", "good")], "chunk_id string, verdict string")
    assert {r.source: r.corrections for r in logs.corrections(f).collect()} == {"a::b": 2, "c": 1}


def test_governance(spark):
    s = "file string, source string, stem string, title string, hash string, mtime double, superseded_by string, supersedes string"
    n = frame(spark, [("a.md", "a.md", "a", "t", "1", 0.0, "b", ""), ("b.md", "b.md", "b", "t", "2", 86400.0 * 200, "", "zz")], s)
    found = governance.scan(n, frame(spark, [("a.md", 0)], "source string, count int"), 86400.0 * 200)
    assert sorted((r.category, r.file) for r in found.collect()) == [("dangling", "b.md"), ("duplicate_truth", "a.md, b.md"), ("stale", "a.md"), ("superseded_live", "a.md")]


def test_vector_space(spark):
    s = "embed_model string, embed_dim int"
    none, known = frame(spark, [], s), frame(spark, [("m", 3)], s)
    check = incremental.check_vector_space
    assert check(none, "m", 3, 0) == "stamp" and check(known, "m", 3, 5) == "ok" and check(none, "m", 3, 5, real_dim=3) == "stamp"
    assert check(known, "n", 3, 5, rebuild=True) == "rebuild"
    with pytest.raises(ValueError, match="rebuild it"):
        check(known, "n", 4, 5)


def test_triples(spark):
    for reply, want in (('[["a","b","c"]]', [("a", "b", "c")]), ("none", []), ("[broken", []), ('x [["a", 1, "c"], ["d","e"," "]] y', [("a", "1", "c")])):
        got = frame(spark, [(reply,)], "r string").select(knowledge.triples_of(F.col("r")).alias("t")).first().t
        assert [tuple(t) for t in got] == want


def test_plain(spark):
    t = "# Head\n**bold** `code`\n- item"
    assert frame(spark, [(t,)], "t string").select(answers.plain(F.col("t")).alias("p")).first().p == "bold code\nitem"


def test_few_and_many_queries_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(i % 9))) for i in range(60)] + [(99, None)], "id long, text string")
    asked = spark.createDataFrame([(0, "w1 w2 w3"), (1, "w5 w5 w16"), (2, "")], "query_id long, text string")
    few = sorted(map(tuple, retrieve.hashed_top_k(docs, asked, 7).select("query_id", "id", "distance", "rank").collect()))
    monkeypatch.setattr(retrieve, "FEW_QUERIES", 0)
    assert sorted(map(tuple, retrieve.hashed_top_k(docs, asked, 7).collect())) == few and len(few) == 14


def test_vectors_of_two_lengths(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [0.5, 0.5])], "id long, vec array<double>")
    asked = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 0.0, 3.0]), (2, None)], "query_id long, vec array<double>")
    got = {(r.query_id, r.id): r["rank"] for r in retrieve.dense_top_k(corpus, asked, 5).collect()}
    assert got == {(0, 1): 1, (0, 6): 2, (1, 2): 1}


def test_ranks_of_a_hot_key(spark):
    """Quantiles from parts of a key: as from the whole list, with ties, nulls and one key that has most rows."""
    import random
    import statistics

    from tessera.operators import logs

    r = random.Random(8)
    rows = [("hot", r.choice([0.0, 1.5, r.random() * 100])) for _ in range(3000)] + [("few", float(i)) for i in range(19)] + [("even", 7.0)] * 40 + [("some", float(i * i % 37)) for i in range(25)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {x.k: x.p95 for x in logs.p95_by(df, "k", "v").collect()}
        ranks = spark.createDataFrame([("hot", n) for n in (1, 2, 1500, 2999, 3000)], "k string, rank long")
        found = {x["rank"]: x.v for x in logs.values_at(df, "k", "v", ranks).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by = {k: [v for key, v in rows if key == k and v is not None] for k in got}
    want = {k: statistics.quantiles(vs, n=20)[-1] if len(vs) >= 20 else None for k, vs in by.items()}
    assert {k: v and round(v, 9) for k, v in got.items()} == {k: v and round(v, 9) for k, v in want.items()}
    assert found == {n: sorted(by["hot"])[n - 1] for n in (1, 2, 1500, 2999, 3000)}


def test_short_passages_without_a_nested_loop(spark, monkeypatch):
    from tessera.operators import evaluation

    monkeypatch.setattr(evaluation, "BLOCK", 2)
    docs = spark.createDataFrame([("a", "one two three"), ("b", "two three four"), ("c", None)], "source string, text string")
    asked = spark.createDataFrame([(1, "two"), (2, "one two"), (3, "four"), (4, ""), (5, "two"), (6, "none"), (7, None)], "query_id long, text string")
    got = evaluation.holding(docs, asked)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b"), (2, "a"), (3, "b"), (5, "a"), (5, "b")]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_walk_ends_when_no_jump_is_left(spark, monkeypatch):
    made, durable = [], supersession.durable
    monkeypatch.setattr(supersession, "durable", lambda df, what: made.append(what) or durable(df, what))
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "stem string, next string")
    lines = supersession._walk(steps, spark.createDataFrame([("a",)], "stem string"))
    assert sorted(map(tuple, lines.select("pos", "stem").collect())) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert made.count("lines") == 3  # no round that only finds that nothing came
