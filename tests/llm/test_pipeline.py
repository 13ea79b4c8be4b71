from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import registry
from tessera.llm.common import durable, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names = docs.columns
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, sf))
        assert docs.columns == names
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] == sizes[1] and sizes[4] == sizes[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pieces_of_one_length_keep_the_mixed_order(spark, sf):
    docs = durable(corpus_pipeline.mixture(spark, table(spark, sf, "documents"), sf))
    at = {r.doc_id: (r.f, r.i) for r in docs.selectExpr("doc_id", "_metadata.file_name AS f", "_metadata.row_index AS i").collect()}
    rows = [r for r in corpus_pipeline.packed(spark, docs, sf).collect() if r.length == 4096]
    order = [at[r.doc_id] for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert order == sorted(order)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len([q for q in registry.QUERIES if q.startswith("op")]) == 13
    import __spark_entry__

    assert set(__spark_entry__.queries()) > {*registry.QUERIES, "pipeline"}


def test_nothing_in(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    long = "a line that is not like others, number %d.\n"
    rows = [(1, "Good text.\nOf lines.\nAnd more.", "en", "s", 30), (1, "Good text.\nOf lines.\nAnd more.", "en", "s", 30), (None, "no id at all, but a text", None, None, None)]
    rows += [(2, None, "en", "s", 0), (3, "", None, "s", 0), (4, " \n ", "en", None, 3), (5, "".join(long % i for i in range(450_000)), "en", "t", None), (6, "word " * 400_000, "de", "t", 2_000_000)]
    rows += [(7, "Good text.\nOf lines.\nAnd more.", "en", "u", 30), (7, "another text of the same number", "en", "s", 30)]
    return spark.createDataFrame(rows, "Doc_ID long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, sf, stage):
    docs = durable(odd(spark)).selectExpr("Doc_ID", "text", "lang", "source", "n_chars", "'x' AS TEXT")
    if stage == "quality classifier":  # these teach
        docs = docs.union(table(spark, sf, "documents").where("doc_id > 7").selectExpr("doc_id AS Doc_ID", "text", "lang", "source", "n_chars", "'x' AS TEXT"))
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, sf)
    if stage == "best-fit packing":
        assert sum(r.length for r in got.collect()) > 3_000_000 and got.select("doc_id").distinct().count() == 8
        return
    assert got.columns == corpus_pipeline.COLUMNS
    rows = durable(got).select("doc_id", F.length("text").alias("n")).collect()
    ids = sorted(r.doc_id or 0 for r in rows)
    if stage in ("line dedup", "mixing sources to target weights"):
        assert ids == [0, 1, 1, 2, 3, 4, 5, 6, 7, 7]
    if stage == "line dedup":
        assert {r.doc_id: r.n for r in rows}[2] is None and sorted(r.n for r in rows if r.doc_id == 7) == [0, 31]
    if stage == "simhash near-dedup":
        assert ids == [0, 1, 1, 2, 5, 6, 7, 7] or ids == [0, 1, 1, 2, 5, 6]
    if stage == "quality classifier":
        assert not {2, 3, 4} & set(ids)


def test_similar_documents_go_whatever_their_fingerprints(spark, sf):
    """pipeline: no pair of five-word similarity >= 0.8 is left, and none below is joined by it."""
    from tessera.llm import shingles, simhash

    docs = table(spark, sf, "documents").select(corpus_pipeline.COLUMNS)
    base = " ".join(f"w{i * 7919 % 1000}" for i in range(60))
    near = [base, base.replace("w0 ", "other ", 1), base + " and more words at the end", base + " " + " ".join(f"v{i}" for i in range(60)), "two words", "two  WORDS", "", ""]
    more = spark.createDataFrame([(10**6 + i, t, "en", "s", len(t)) for i, t in enumerate(near)], docs.schema)
    docs = durable(docs.unionByName(more))
    before = {r.id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    sets = {r.doc_id: set(shingles.shingles(r.text, 5).tolist()) for r in docs.collect()}
    ids, parent = sorted(sets), dict(before)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    joined = 0
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * len(sets[a] | sets[b]) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
                joined += 1
    assert joined and kept == {x for x in ids if root(x) == x}
