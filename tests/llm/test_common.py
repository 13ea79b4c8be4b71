from __future__ import annotations

import random

from tessera.llm.common import components, durable, release


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == union_find([p for p in pairs if p[0] is not None and p[0] != p[1]])
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_durable(spark):
    df = durable(spark.range(3))
    assert df.count() == 3
    release(df)
