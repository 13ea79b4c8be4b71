from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from tests.llm.test_common import union_find
from tessera.llm import simhash


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    rng = random.Random(2)
    texts = [None, "", " \t\n", "One", "a b", "A b C", "É\xa0è x y", *(" ".join(rng.choice(["a", "B", "cc", "dé"]) for _ in range(rng.randrange(200))) for _ in range(30)), "w " * 70_000]
    for t in texts[:-1]:
        assert simhash.fingerprint(t) == brute(t)
    assert simhash.fingerprint(texts[-1]) == brute(texts[-1])


def test_fingerprint_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    fps = {0, 2**64 - 1}
    for _ in range(60):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                g ^= 1 << b
            fps.add(g)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    want = {(min(signed(a), signed(b)), max(signed(a), signed(b))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    got = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_groups_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fp = {r.doc_id: brute(r.text) for r in rows}
    ids = sorted(fp)
    want = union_find([(a, a) for a in ids] + [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    got = simhash.op7_simhash_near_dedup(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in ids}


def test_odd_rows(spark):
    rows = [(5, "a b c d", "x"), (3, "a b c d", "y"), (9, None, None), (8, "", "z"), (None, "q r s t u", "n"), (7, "other words are here", "w"), (7, "other words are here", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {5: 3, 3: 3, 9: 8, 8: 8, None: None, 7: 7}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 7, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_rows_of_documents_are_never_broadcast(spark):
    from tessera.llm import common

    fps = spark.range(50).select(F.xxhash64("id").alias("fp"))
    edges = spark.range(1, 50).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    for made in (simhash.links(fps), simhash._stars(fps), common._large_star(edges), common._small_star(edges)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bands_are_never_broadcast(spark):
    from tessera.llm import shingles

    placed = spark.range(50).selectExpr("id % 5 AS h", "id", "1 AS n", "id AS component", "array(id) AS bits")
    plan = shingles._star(placed, 0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
