from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_common import union_find
from tessera.llm import embedding_dedup
from tessera.llm.hnsw import Graph, range_search


def vectors(seed=1, n=600, groups=12, size=15, d=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for g in range(groups):
        c = rng.normal(size=d)
        x[g * size : (g + 1) * size] = c + rng.normal(size=(size, d)) * 0.03 * np.linalg.norm(c)
    return x.astype(np.float32)


def test_recall():
    x = vectors()
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    got = range_search(Graph(u), u, 0.98, own=True, beam=16)
    s = u @ u.T
    np.fill_diagonal(s, 0)
    want = set(zip(*np.nonzero(s >= 0.98), strict=True))
    found = set(zip(got.row, got.col, strict=True))
    assert not got.saturated.any() and found <= want and len(found) >= 0.99 * len(want)
    assert got.pairs[0] > 0 and got.pairs[1] >= 0.99 * got.pairs[0] and got.near[1] >= 0.9 * got.near[0]


def test_the_audit_sees_missing_links(monkeypatch):
    """A graph that has lost half of its links is searched again with wider beams, and last not at all."""
    x = vectors(n=900, groups=20)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = Graph(u)
    sound = range_search(g, u, 0.98, own=True, beam=8).beam
    g.layers[0][:, 3:] = -1
    got = range_search(g, u, 0.98, own=True, beam=8)
    assert got.beam > sound and (got.saturated.all() or got.pairs[1] >= 0.99 * got.pairs[0])


def test_large_groups_are_left_to_the_product():
    u = np.tile(np.eye(8, dtype=np.float32)[0], (300, 1)) + np.random.default_rng(1).normal(size=(300, 8)).astype(np.float32) * 1e-3
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = range_search(Graph(u), u, 0.98, own=True, beam=4)
    assert got.saturated.all() and not len(got.row)


def test_groups_of_a_block():
    rng = np.random.default_rng(4)
    for _ in range(50):
        hit = rng.random((rng.integers(1, 9), rng.integers(1, 12))) < 0.2
        cols, rows = embedding_dedup._grouped(hit)
        want = union_find([(i, i) for i in range(len(hit))] + [(i, 100 + j) for i, j in zip(*np.nonzero(hit), strict=True)])
        assert rows.tolist() == [want[i] for i in range(len(hit))] and all(cols[j] == want[100 + j] for j in np.flatnonzero(hit.any(0)))


def brute(rows):
    ok = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if v is not None and lab is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    pairs = []
    for a, (i, x, p) in enumerate(ok):
        for j, y, q in ok[a + 1 :]:
            if p == q and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                pairs.append((i, j))
    n = {i: 0 for i, _, _ in rows}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    comp = union_find([(i, i) for i in n] + pairs)
    return {i: (n[i], comp[i]) for i in n}


def check(spark, rows, **given):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(df, **given).collect()
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


def test_equals_brute_force(spark):
    x = vectors(n=300)
    rows = [(i * 7 % 1009, v.tolist(), int(i % 3 == 0)) for i, v in enumerate(x)]
    rows += [(2000 + i, x[i % 5].tolist(), 0) for i in range(40)]
    check(spark, rows, shard=64)


def test_large_near_copy_group(spark, monkeypatch):
    """op5: one group of near copies over several shards is linear in rows, and exact."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    c = rng.normal(size=16)
    x = [c + rng.normal(size=16) * 0.08 for _ in range(700)] + list(rng.normal(size=(200, 16)))
    rows = [(i, np.float32(v).tolist(), 1) for i, v in enumerate(x)]
    check(spark, rows, shard=150)
    df = spark.createDataFrame(rows, "vec_id long, v array<float>, label int")
    found = embedding_dedup.links(embedding_dedup.durable(embedding_dedup.classes(df)), shard=150)
    shards = -(-900 // 150)
    assert found.where("kind < 2").count() <= 2 * 900 * (shards + 1)
    audit = {r.kind: (r.wanted, r.got) for r in embedding_dedup.recall(found).collect()}
    assert set(audit) == {2, 3}


def test_extreme_lengths_and_names(spark):
    big, small = [3e38, 1e38], [3e-40, 1e-40]
    df = spark.createDataFrame([(1, big, 1, 0), (2, small, 1, 0), (3, [-3.0, 1.0], 1, 0)], "vec_id long, embedding array<float>, label int, V int")
    df = df.withColumn("LABEL_", F.lit(2)).toDF("vec_id", "embedding", "label", "V", "Label")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_odd_vectors(spark):
    inf = float("inf")
    check(spark, [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [inf, 1.0], 1), (8, [float("nan"), 1.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.0], 2), (12, [1.0, 0.0], 1)])
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_query(spark, sf):
    got = embedding_dedup.op5_embedding_near_dedup(spark, sf)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == brute(rows)


def test_labels_in_their_own_type(spark):
    """Strings are labels like numbers; ones that only look alike are different."""
    v, w = [1.0, 0.0, 0.5], [1.0, 0.001, 0.5]
    rows = [(1, v, "a"), (2, w, "a"), (3, v, "A"), (4, v, "1"), (5, w, "01"), (6, v, None), (7, w, "1")]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (0, 5), 6: (0, 6), 7: (1, 4)}
