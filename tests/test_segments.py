"""Tables in segments and lexical deltas: what is rewritten, what is read, and that results are those of a rebuild."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical, postings
from tessera.operators.postings import MOST, DeltaIndex
from tessera.sources.segments import SegmentTable

SCHEMA = "source string, n int, v string"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("source", "n", "v").collect())


def data_files(root):
    return {p: p.stat().st_mtime_ns for p in root.rglob("part-*.parquet")}


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    t = SegmentTable(spark, str(tmp_path / "t"), buckets=8, most=3)
    assert t.read() is None and t.current() is None and t.of_sources(spark.createDataFrame([("a",)], "source string")) is None
    model = {f"s{i}": [(i, "first")] * (i % 3 + 1) for i in range(60)}
    frame = lambda m: spark.createDataFrame([(s, n, v) for s, rs in m.items() for n, v in rs], SCHEMA)
    t.replace(frame(model))
    bucket = {r.source: r.b for r in spark.createDataFrame([(s,) for s in model], "source string").select("source", t._bucket(8).alias("b")).collect()}
    r = random.Random(1)
    for turn in range(8):
        before = data_files(tmp_path)
        changed = {s: [(turn, f"v{turn}")] for s in r.sample(sorted(model), 2)}
        gone = r.sample(sorted(set(model) - set(changed)), 1)
        version = t.current()
        old = rows_of(t.read())
        t.upsert(frame(changed), spark.createDataFrame([(s,) for s in gone], "source string"))
        model = {s: rs for s, rs in model.items() if s not in gone} | changed
        assert rows_of(t.read()) == sorted((s, n, v) for s, rs in model.items() for n, v in rs)
        assert rows_of(t.read(version)) == old  # readers keep their version
        touched = {bucket[s] for s in (*changed, *gone)}
        fresh = set(data_files(tmp_path)) - set(before)
        assert fresh and {int(p.parent.name.rpartition("=")[2]) for p in fresh} <= touched
        assert all(data_files(tmp_path)[p] == at for p, at in before.items())  # and old files stay as they are
    some = spark.createDataFrame([("s1",), ("s2",), ("nothing",)], "source string")
    assert rows_of(t.of_sources(some)) == sorted((s, n, v) for s, rs in model.items() if s in ("s1", "s2") for n, v in rs)
    m = t.manifest()
    assert max(sum(b in x["buckets"] for x in m.tombstones) for b in range(8)) <= 3  # bounded by compaction
    kept = data_files(tmp_path)
    assert len(t.vacuum()) == 2 and rows_of(t.read()) == sorted((s, n, v) for s, rs in model.items() for n, v in rs)
    assert len(data_files(tmp_path)) < len(kept)


def test_odd_commits(spark, tmp_path):
    t = SegmentTable(spark, str(tmp_path / "t"), buckets=4)
    none = spark.createDataFrame([], SCHEMA)
    t.upsert(none)
    assert rows_of(t.read()) == []
    t.upsert(spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), (None, 2, "y")], SCHEMA))
    assert t.read().count() == 3
    t.delete(spark.createDataFrame([(None,), ("b",)], "source string"))
    assert rows_of(t.read()) == [("a", 1, "x")] * 2
    t.upsert(none, spark.createDataFrame([("a",)], "source string"))
    assert t.read().count() == 0 and t.delete(spark.createDataFrame([], "source string")) is not None
    other = SegmentTable(spark, t.path)
    before = t.current()
    other.upsert(spark.createDataFrame([("c", 1, "z")], SCHEMA))
    t.current = lambda: before  # a writer that began earlier
    m = t.manifest()
    t.current = other.current
    with pytest.raises(RuntimeError, match="another writer"):
        t._publish(m, before)


WORDS = [f"w{i}" for i in range(300)] + ["user_id", "a-b"]


def texts(r, ids):
    return [(i, " ".join(r.choices(WORDS, k=r.choice([0, 5, 40, 80])))) for i in ids]


def test_deltas_score_as_a_rebuild(spark, tmp_path, monkeypatch):
    r = random.Random(7)
    frame = lambda m: spark.createDataFrame(sorted(m.items()), "id long, text string")
    docs = dict(texts(r, range(300)))
    queries = spark.createDataFrame([(0, "w1 w2 w2 user_id"), (1, "w299 nothing"), (2, "")], "query_id long, text string")
    many = spark.createDataFrame([(i, f"w{i % 300} w{i * 7 % 300}") for i in range(2000)], "query_id long, text string")
    d = DeltaIndex(spark, str(tmp_path / "d"))
    with pytest.raises(LookupError):
        d.apply(frame(docs), frame(docs), "x")
    d.build(frame(docs), "v0")
    for turn in range(MOST + 2):
        removed = {i: docs.pop(i) for i in r.sample(sorted(docs), 20)}
        back = list(removed)[:10]  # ids that come again with other texts
        added = dict(texts(r, [*back, *range(1000 + turn * 10, 1010 + turn * 10)]))
        docs |= added
        d.apply(frame(removed), frame(added), f"v{turn + 1}")
        if turn in (0, 1, 2, MOST - 1, MOST + 1):
            whole = lexical.LexicalIndex.build(frame(docs))
            plain = lambda df: sorted((x.query_id, x.id, round(x.score, 9)) for x in df.collect())
            assert plain(d.scores(queries)) == plain(whole.scores(queries))
            assert sorted(map(tuple, d.frequencies().collect())) == sorted(map(tuple, whole.frequencies.collect()))
            assert d.stats().first() == whole.stats.first()
    for few, asked in ((1000, 10_000), (5, 10_000), (5, 10)):  # terms as a filter, broadcast, joined
        monkeypatch.setattr(postings, "FEW_TERMS", few)
        monkeypatch.setattr(postings, "ASKED", asked)
        assert plain(d.scores(many)) == plain(whole.scores(many))
    assert sorted(map(tuple, d.postings().select("term", "id", "tf", "dl").collect())) == sorted(map(tuple, whole.postings.collect()))
    assert d.of() == f"v{MOST + 2}" and len(d.manifest().segments) <= MOST
    d.vacuum()
    assert plain(d.scores(queries)) == plain(whole.scores(queries))
    assert DeltaIndex(spark, d.path, "identifier").of() is None  # of another tokenizer
    d.apply(frame(docs), spark.createDataFrame([], "id long, text string"), "empty")
    assert d.scores(queries).count() == 0 and d.stats().first().n == 0


def test_tombstones_meet_the_hits_only(spark, tmp_path):
    d = DeltaIndex(spark, str(tmp_path / "d"))
    docs = spark.createDataFrame([(i, f"w{i % 9} w{i}") for i in range(200)], "id long, text string")
    d.build(docs, "a")
    d.apply(docs.where("id < 5"), docs.limit(0), "b")
    plan = d.scores(spark.createDataFrame([(0, "w3")], "query_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [w3])" in plan or "EqualTo(term,w3)" in plan
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_a_small_batch_is_cheap(spark, tmp_path, sf):
    """One per cent of the documents: what is read and written is in proportion, and so is the time."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    d = DeltaIndex(spark, str(tmp_path / "d"))
    one = docs.where("id % 100 = 1")
    d.build(docs.where("id < 200"), "warm")
    d.apply(docs.where("id < 10"), docs.where("id < 10"), "warm")
    began = time.time()
    d.build(docs, "a")
    build, began = time.time() - began, time.time()
    d.apply(one, one, "b")
    batch = time.time() - began
    sizes = [s["postings"] for s in d.manifest().segments]
    assert sizes[1] < 0.03 * sizes[0] and batch < build / 3
    print(f"build {build:.1f} s, batch {batch:.1f} s")
