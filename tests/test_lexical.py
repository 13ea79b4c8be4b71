"""Early termination of BM25 and the trigram search for identifiers."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessera.operators import lexical, retrieve
from tessera.operators.blockmax import BlockIndex


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_block_maxima_give_the_best(spark, tmp_path):
    """1,000 queries over 3,000 documents: the rows of a full scoring, from a part of the postings."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    odds = [1 / (i + 1) for i in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, odds, k=r.choice([3, 30, 120])))) for i in range(3000)] + [(5000, ""), (5001, None)], "id long, text string")
    asked = spark.createDataFrame([(i, " ".join(r.choices(words, [o**0.4 for o in odds], k=3))) for i in range(1000)] + [(2000, ""), (2001, "nothing")], "query_id long, text string")
    index = BlockIndex.build(docs)
    index.save(str(tmp_path / "b"))
    index = BlockIndex.load(spark, str(tmp_path / "b"))
    plain = lambda df: sorted((x.query_id, x["rank"], x.id, x.score) for x in df.select("query_id", "rank", "id", "score").collect())
    whole = plain(lexical.top_k(lexical.search(docs, asked), 5))
    assert plain(index.search(asked, 5)) == whole and len(whole) > 4000
    share = index.share_read(asked, 5)
    print(f"share of postings scored: {share:.2f}")
    assert 0 < share < 0.7
    assert index.blocks.agg(F.max("n")).first()[0] < 400
    plan = plan_of(index.search(asked, 5))
    assert "CartesianProduct" not in plan and "Python" not in plan
    assert plain(index.search(asked.limit(0), 5)) == []
    assert plain(BlockIndex.build(docs.limit(0)).search(asked, 5)) == []


def test_identifiers_by_trigrams(spark, monkeypatch):
    """As by looking for each identifier in each text, whatever their number."""
    r = random.Random(4)
    parts = ["user", "id", "a1", "v2", "x", "kelvin", "K9", "2024", "01", "İ", "é", "ß"]
    name = lambda: r.choice(["-", "_", ".", "/", ":", "::", ""]).join(r.choices(parts, k=r.choice([1, 2, 3])))
    texts = [" ".join(name() for _ in range(r.choice([0, 1, 60]))) for _ in range(150)] + [None, "", "x" * 5000 + "-a1", "no identifier", "USER-ID.", "--a1--"]
    asked = [" ".join(name() for _ in range(5)) for _ in range(60)] + [None, "", "plain words", "user-id user-id a1b2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    from tessera.functions import text as T

    terms = {x.query_id: set(x.ts or []) for x in queries.select("query_id", T.identifier_terms(F.col("text")).alias("ts")).collect()}
    low = {x.id: x.low for x in docs.select("id", F.lower("text").alias("low")).collect()}
    brute = sorted((q, d, n) for q, ts in terms.items() for d, text in low.items() if (n := sum(t in (text or "") for t in ts)))
    assert len(brute) > 100
    for limit in (1000, 0):
        monkeypatch.setattr(retrieve, "LITERAL_TERMS", limit)
        found = retrieve.literal_hits(docs, queries)
        assert sorted(tuple(x) for x in found.select("query_id", "id", "n").collect()) == brute
        plan = plan_of(found)
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan
        assert retrieve.literal_hits(docs, queries.where("query_id = 62")).count() == 0


def test_many_queries_are_scored_in_batches(spark, sf, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.operators import nearest, retrieve

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "id long, text string"))
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").unionByName(spark.createDataFrame([(10**6, "nosuchword"), (10**6 + 1, "")], "query_id long, text string"))
    theirs = sorted(map(tuple, lexical.top_k(lexical.search(docs, asked), 7).select("query_id", "id", "score", "rank").collect()))
    for cells, often in ((1 << 20, 16), (64, 1), (1 << 20, 0)):
        monkeypatch.setattr(nearest.Best, "cells", cells)
        monkeypatch.setattr(lexical, "OFTEN", often)
        found = retrieve.lexical_top_k(docs, asked, 7)
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()  # no row for each query and document
        assert sorted(map(tuple, found.collect())) == theirs


def test_best_keeps_k_with_ties_by_id():
    import numpy as np

    from tessera.operators.nearest import Best

    rng = np.random.default_rng(3)
    values, ids = rng.integers(0, 6, (5, 90)).astype(float), rng.permutation(90)
    values[rng.random(values.shape) < 0.3], values[4] = np.inf, np.inf
    found = Best(5, 4)
    for i in range(0, 90, 7):
        found.add(values[:, i : i + 7], ids[i : i + 7])
        assert len(found.q) <= 5 * 4
    brute = [(q, v, i) for q in range(5) for v, i in sorted(zip(values[q], ids.tolist()))[:4] if np.isfinite(v)]
    assert list(zip(*(x.tolist() for x in found.rows()))) == brute


def test_a_search_reads_each_text_once_a_channel(spark, sf, monkeypatch):
    """No channel is made twice, and statistics, frequencies and scores share a pass; with the rows of the other ways."""
    made, durable = [], lexical.durable
    monkeypatch.setattr(lexical, "durable", lambda df, what: made.append(what) or durable(df, what))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "source", F.col("lang").alias("tags"), F.lit(0.0).alias("mtime"))
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, "s", "fr", 0.0), (10**6 + 1, "", "s", "fr", 0.0)], docs.schema))
    asked = spark.createDataFrame([(0, "the thand the example.com"), (1, ""), (2, None), (3, "is nosuchword")], "query_id long, text string")
    for given in ({"exact": "The th"}, {"path_contains": "SRC1"}, {"tag": "FR"}):
        found = retrieve.search(docs, asked, 5, **given)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [doc_id") == 3  # token hashes, literal hits, payload
    assert made == ["held"] * 3
    plain = lambda: sorted(map(tuple, lexical.search(docs, asked).select("query_id", "id", F.round("score", 9)).collect()))
    held = plain()
    assert made.pop() == "held" and len(held) > 100
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan_of(lexical.search(docs, asked)).count("SortMergeJoin") == 1  # terms with their frequencies; postings stay where they are
        assert made.pop() == "held" and plain() == held and made.pop() == "held"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(lexical, "TERMS", 0)
    assert plain() == held and made.pop() == "postings"


def test_block_maxima_shuffle_no_scores(spark):
    """Scores are added up where the postings of a range are: none is shuffled but those of the few seeds."""
    docs = spark.createDataFrame([(f"d{i}", "a b c a" if i % 3 else "b d") for i in range(300)], "id string, text string").repartition(3)
    asked = spark.createDataFrame([(1, "a d"), (2, "b")], "query_id long, text string")
    index = BlockIndex.build(docs)
    assert index.blocks.groupBy("range").agg(F.countDistinct("term").alias("n"), F.count("*").alias("m")).where("n <> m").count() == 0
    assert index.blocks.select(F.explode("postings.id").alias("id"), "term").groupBy("id", "term").count().where("count > 1").count() == 0
    plan = plan_of(index.search(asked, 4))
    assert not re.search(r"hashpartitioning\((?:query_id#\w+, id#|term#\w+, range#)", plan)
    assert len(re.findall(r"hashpartitioning\(range#\w+, query_id#\w+, id#", plan)) <= 1
    whole = lexical.top_k(lexical.search(docs, asked), 4).select("query_id", "id", "score", "rank")
    assert sorted(map(tuple, index.search(asked, 4).collect())) == sorted(map(tuple, whole.collect()))
