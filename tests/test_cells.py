"""Exact nearest neighbours by cells: the rows of comparing everything, from fewer comparisons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import cells, retrieve


def frame(spark, rows, name="id"):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"{name} long, vec array<double>")


def plain(df):
    return sorted((r.query_id, r["rank"], r.id, r.distance) for r in df.select("query_id", "rank", "id", "distance").collect())


def test_equal_to_comparing_everything(spark, monkeypatch):
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 16))
    data = [(i, centres[i % 30] + 0.15 * r.normal(size=16)) for i in range(3000)]
    data += [(5000 + i, data[7][1]) for i in range(20)] + [(6000, np.zeros(16)), (6001, None), (6002, [1.0] * 15 + [None]), (6003, [1.0, 2.0]), (6004, [float("inf")] * 16), (7, data[7][1])]
    corpus = frame(spark, data)
    asked = [(i, centres[i % 30] + 0.2 * r.normal(size=16)) for i in range(90)] + [(200, data[7][1]), (201, np.zeros(16)), (202, None), (203, [1.0, 2.0]), (204, -centres[0])]
    queries = frame(spark, asked, "query_id")
    index = cells.CellIndex.build(corpus)
    want = [x for x in plain(retrieve.dense_top_k(corpus, queries, 5)) if x[0] != 203]  # another length is not in the index
    assert plain(index.search(queries, 5)) == want and len(want) > 400
    share = index.share_compared(queries, 5)
    print(f"share of pairs compared: {share:.3f}")
    assert share < 0.35
    monkeypatch.setattr(cells, "BLOCK", 7)
    assert plain(index.search(queries, 5)) == want
    assert plain(cells.CellIndex.build(corpus, cells=1).search(queries, 3)) == [x for x in want if x[1] <= 3]


def test_few_and_none(spark):
    none = frame(spark, [])
    some = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    asked = frame(spark, [(9, [1.0, 0.1])], "query_id")
    assert [x[:3] for x in plain(cells.CellIndex.build(some).search(asked, 5))] == [(9, 1, 1), (9, 2, 2)]
    assert plain(cells.CellIndex.build(none).search(asked, 5)) == []
    assert plain(cells.CellIndex.build(some).search(asked.where(F.lit(False)), 5)) == []
