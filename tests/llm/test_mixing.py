from __future__ import annotations

from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import mixing


def test_whole_weights():
    assert mixing.whole({"a": 0.6666666, "b": 0.3333334}) == {"a": 3333333, "b": 1666667}
    assert mixing.whole({"a": 0.99995, "b": 0.00005}) == {"a": 19999, "b": 1} and mixing.whole({"a": 6.0}) == {"a": 1}
    assert mixing.target_weights({"a": 10**9, "b": 1, "c": 0}) == {"a": 16384, "b": 1}
    with pytest.raises(ValueError):
        mixing.whole({"a": 0.0})


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 90), st.integers(1, 5)), min_size=1))
def test_frames_of_a_run_are_alike(given_):
    """op6: skipping over frames that are alike changes nothing: windows are those of the whole schedule."""
    blocks = {s: n for s, (n, _) in given_.items() if n}
    w = mixing.whole({s: given_[s][1] for s in blocks}) if blocks else {}

    def used(s, j):
        return sum(min(Fraction(n), Fraction(j * w[x], w[s])) for x, n in blocks.items())

    got = list(mixing.plan(blocks, w))
    for s, j, release, deadline in got:
        assert release == used(s, j) // 1 and deadline == -(-used(s, j + 1) // 1)
    assert Counter(s for s, *_ in got) == Counter(blocks)
    assert sum((r.v_to - r.v_from) * r.size for r in mixing.runs(blocks, w)) == len(got)
    assert len(mixing.runs(blocks, w)) <= 2 * len(blocks)


def test_rows_follow_the_plan(spark, monkeypatch):
    """op6: hundreds of frames, looked up in few ranges, equal the schedule made slot by slot."""
    monkeypatch.setattr(mixing, "_RANGES", 4)
    docs = spark.range(1500).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 6 THEN 'a' WHEN id % 10 < 9 THEN 'b' ELSE 'c' END AS source")
    w = {"a": 1, "b": 1, "c": 2}
    got = {(r.mix_source, r.block, r.release, r.deadline, r.slot) for r in mixing.mix(docs, w, block=2).collect()}
    want = {(s, j, release, deadline, k) for k, (s, j, release, deadline) in enumerate(mixing.plan({"a": 450, "b": 225, "c": 75}, w))}
    assert got == want
    assert sorted(r.position for r in mixing.mix(docs, w, block=7).collect()) == list(range(1500))


def test_query_equals_oracle(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet' UNION ALL SELECT 1000000 + i, 'x', 'en', CASE WHEN i % 2 = 0 THEN 'few' END, 1 FROM range(21) t(i)")
    more = spark.range(21).selectExpr("1000000 + id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'few' END AS source")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").unionByName(more)
    got = mixing.mix(docs).select("doc_id", "source", "block", "release", "deadline", "slot", "position").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, c.execute(mixing.ORACLE_OP6).fetchall()))


def test_native(spark, sf):
    plan = mixing.op6_mixing_sources(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "ExistingRDD"))


def test_query(spark, sf):
    rows = sorted(mixing.op6_mixing_sources(spark, sf).collect(), key=lambda r: r.position)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert [r.position for r in rows] == list(range(n)) and len({r.doc_id for r in rows}) == n
    assert all(r.release <= r.slot < r.deadline for r in rows)
    assert [r.slot for r in rows] == sorted(r.slot for r in rows)


def test_given_weights(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' ELSE NULL END AS source", "'x' AS slot2")
    rows = sorted(mixing.mix(docs, {"a": 6.0, "b": 3.0, "": 1.0}, block=1).collect(), key=lambda r: r.position)
    for t in (10, 100, 1000):
        got = Counter(r.mix_source for r in rows[:t])
        assert got["a"] == pytest.approx(0.6 * t, abs=1) and got["b"] == pytest.approx(0.3 * t, abs=1) and got[""] == pytest.approx(0.1 * t, abs=1)
    assert len(rows) == 3000


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None), (None, "", "t"), (1, "s", None), (1, "s", None)], "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    assert sorted(r.position for r in got) == [0, 1, 2, 3]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_order_of_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = str(tmp_path / "mixed")
    mixing.in_order(docs).write.parquet(out)
    back = spark.read.parquet(out).selectExpr("doc_id", "_metadata.file_name AS f", "_metadata.row_index AS i").collect()
    want = [r.doc_id for r in sorted(mixing.mix(docs).collect(), key=lambda r: r.position)]
    assert [r.doc_id for r in sorted(back, key=lambda r: (r.f, r.i))] == want and spark.read.parquet(out).columns == docs.columns


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "s", 9, 8, 7), (2, "t", 7, 6, 5)], "doc_id long, source string, Slot int, row int, ROW int")
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "source", "row", *mixing.OWN] and sorted(r.position for r in got.collect()) == [0, 1]
    assert mixing.in_order(docs).columns == ["doc_id", "source", "Slot", "row"] and sorted(r.Slot for r in mixing.in_order(docs).collect()) == [7, 9]


def fluid(blocks, weights, t):
    """Blocks of each source that the ideal schedule has done after t slots."""
    weights = mixing.whole({s: weights[s] for s, n in blocks.items() if n}) if any(blocks.values()) else {}
    done, left = {s: Fraction(0) for s in blocks}, {s for s, n in blocks.items() if n}
    while t and left:
        total = sum(Fraction(weights[s]) for s in left)
        step = min(t, *((blocks[s] - done[s]) * total / Fraction(weights[s]) for s in left)) if left else t
        for s in left:
            done[s] += step * Fraction(weights[s]) / total
        t -= step
        left = {s for s in left if done[s] < blocks[s]}
    return done


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 40), st.floats(0.001, 50)), min_size=1))
def test_less_than_a_block_off_the_target_weights(given_):
    blocks, weights = {s: n for s, (n, _) in given_.items()}, {s: w for s, (_, w) in given_.items()}
    got, where = Counter(), {}
    for slot, (s, j, release, deadline) in enumerate(mixing.plan(blocks, weights)):
        assert j == got[s] and release <= slot < deadline
        got[s] += 1
        where = fluid(blocks, weights, slot + 1)
        assert all(abs(got[x] - where[x]) < 1 for x in blocks)
    assert +got == +Counter(blocks)


def test_default_weights_hold_over_a_long_run(spark):
    """op6: a third of the rows in one source and 19 equal others; one with a tiny share."""
    rows = 8 * 3000
    docs = spark.range(rows).selectExpr("id AS doc_id", f"CASE WHEN id < 8 THEN 'tiny' WHEN id % 3 = 0 THEN 'big' ELSE concat('s', id % 19) END AS source")
    got = mixing.mix(docs).collect()
    w = mixing.target_weights(Counter(r.source for r in got))
    total = sum(w.values())
    assert w["tiny"] < w["big"] / 100
    by = {s: sorted(r.slot for r in got if r.source == s)[::8] for s in w}
    out = min(max(x) for s, x in by.items() if s != "tiny")
    for s in set(w) - {"tiny"}:
        share = w[s] / (total - w["tiny"])
        for t in range(1, out, 7):
            assert abs(sum(x < t for x in by[s]) - share * t) < 2  # tiny has one slot
    assert len(got) == rows and sorted(r.position for r in got) == list(range(rows))


def test_every_source_has_a_share(spark):
    """op6: 400 sources, more than once had windows of their own."""
    docs = spark.range(8 * 2 * 400).selectExpr("id AS doc_id", "concat('s', id % 400) AS source")
    got = mixing.mix(docs).collect()
    by = {}
    for r in got:
        assert r.mix_source == r.source and r.release <= r.slot < r.deadline
        by.setdefault(r.source, set()).add((r.block, r.slot))
    assert len(by) == 400 and all({b: s // 400 for b, s in x} == {0: 0, 1: 1} for x in by.values())
    assert sorted(r.position for r in got) == list(range(len(got)))
