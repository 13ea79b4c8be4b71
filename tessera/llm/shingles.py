"""Documents whose sets of word shingles are similar, by bands of minimum hashes.

BANDS times ROWS minimum hashes sketch a set; two sets of Jaccard similarity s agree in all
of a band with the chance s ** ROWS, so a pair at 0.8 is missed by all bands with the
chance (1 - 0.8 ** 4) ** 18 = 0.00008, and one above it with less.

A pair that meets in a band is judged by one bit of each of BITS more minimum hashes.  Of
these a pair at 0.8 differs in a tenth: in more than MOST, or in SURE or fewer, with a chance
of less than 0.0003 each.  So beyond MOST a pair is not similar, up to SURE it is, and between
them the whole sets are compared.

Pairs that are in one component already need no test.  Equal sets are one; then, turn by
turn, each document is held against the first of its band, in another order each turn,
where the band still has different components.  So a large group of near copies costs a
few pairs a document and turn.  When few pairs of different components are left, or a turn
joins little, all that are left are judged, in the join itself.  Joins of rows, whose number grows with
the documents, are merge joins by hint, so that none is broadcast through the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, durable, release
from tessera.llm.simhash import words

#: Minimum hashes in a band and bands; shingles hashed at a time; groups of ids by which
#: documents are sifted before their texts are shuffled (this bounds what is broadcast).
ROWS, BANDS, AT_ONCE, SIFT = 4, 18, 512, 1 << 18
#: Pairs for each row of a band that are few, and the share of pairs that a turn must settle
#: for another to follow; bits of a sketch, and how many of a pair's may differ, and do no harm.
SPARSE, LITTLE, BITS, MOST, SURE = 2, 0.1, 2048, 252, 153
_RNG = np.random.default_rng(20)
_TIMES, _PLUS = (_RNG.integers(0, 1 << 32, ROWS * BANDS + BITS, dtype=np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The different hashes of a text's shingles, sorted; a shorter text is one shingle, one without words has none."""
    got = words(text)
    if not got:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, got), np.uint64, len(got))
    n = max(1, len(got) - width + 1)
    out = np.full(n, min(width, len(got)), np.uint64)
    for k in range(min(width, len(got))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique((out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))


def _least(s: np.ndarray, of: slice) -> np.ndarray:
    """Minimum hashes of a set that is not empty."""
    times, plus = _TIMES[of], _PLUS[of]
    low = (s.view(np.uint64) >> np.uint64(17)).astype(np.uint32)
    out = np.full(len(times), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(s), AT_ONCE):
        out = np.minimum(out, (low[k : k + AT_ONCE, None] * times + plus).min(0))
    return out.astype(np.uint64)


def bands(s: np.ndarray) -> np.ndarray:
    """A key for each band of a set that is not empty."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in _least(s, slice(0, ROWS * BANDS)).reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def bits(s: np.ndarray) -> np.ndarray:
    """BITS bits, as longs, of a set that is not empty: two sets agree in one with the chance (1 + similarity) / 2."""
    mixed = _least(s, slice(ROWS * BANDS, None)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.packbits((mixed >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def _mapped(docs: DataFrame, make, schema: str, names: list[str]) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([b.column(0), *make(b.column(1))], ["id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t")).where("id IS NOT NULL").mapInArrow(run, f"id long, {schema}")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, name: of the set, bands) of documents with words."""

    def make(texts: pa.Array) -> list[pa.Array]:
        sets = [shingles(t.as_py(), width) for t in texts]
        return [pa.array([len(s) for s in sets], pa.int32()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _lists([bands(s) if len(s) else s for s in sets])]

    return _mapped(docs, make, "n int, name binary, bands array<long>", ["n", "name", "bands"]).where("n > 0")


def _made(docs: DataFrame, ids: DataFrame, width: int, schema: str, *makes) -> DataFrame:  # noqa: ANN002
    """(id, what makes give of the shingles) of the documents whose doc_id is in ids, written.

    Texts are shuffled of these documents only: first a broadcast of the SIFT groups (by
    hash) that their ids fall into leaves out most others, then the ids do.
    """
    ids = durable(ids, "ids")
    group = F.pmod(F.xxhash64("doc_id"), F.lit(SIFT)).cast("int").alias("_group")
    sifted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_group", group).join(F.broadcast(ids.select(group).distinct()), "_group", "left_semi")
    texts = sifted.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi")

    def make(t: pa.Array) -> list[pa.Array]:
        sets = [shingles(x.as_py(), width) for x in t]
        return [_lists([f(s) if len(s) else s for s in sets]) for f in makes]

    names = [x.split()[0] for x in schema.split(", ")]
    return durable(_mapped(texts, make, schema, names).dropDuplicates(["id"]), "made")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of ids whose sets are similar."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = _made(docs, ids, width, "s array<long>", lambda s: s)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= least * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (id, component) after its components are joined by links (a, b) of ids."""
    ca, cb = comp.select(F.col("id").alias("a"), F.col("component").alias("src")), comp.select(F.col("id").alias("b"), F.col("component").alias("dst"))
    found = components(links.join(ca.hint("merge"), "a").join(cb.hint("merge"), "b").select("src", "dst"))
    found = found.select(F.col("node").alias("component"), F.col("component").alias("_c"))
    return durable(comp.join(found.hint("merge"), "component", "left").select("id", F.coalesce("_c", "component").alias("component")), "components")


def _star(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs of placed rows (h, id, n, component, bits) with different components: of each document
    in a band and the first one, in an order that each turn has of its own."""
    order = F.struct(F.xxhash64("id", F.lit(turn)).alias("x"), "id", "n", "component", "bits")
    first = placed.groupBy("h").agg(F.min(order).alias("f"))
    first = first.select("h", F.col("f.id").alias("a"), F.col("f.n").alias("na"), F.col("f.component").alias("ca"), F.col("f.bits").alias("sa"))
    return placed.join(first.hint("merge"), "h").where("component <> ca").select("a", "na", "sa", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("sb"))


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of placed (h, component, ...) of bands whose rows are not of one component, written."""
    lo_hi = placed.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h")
    return durable(placed.join(lo_hi.hint("merge"), "h"), "mixed")


def similar(docs: DataFrame, comp: DataFrame, width: int, least: float) -> DataFrame:
    """comp (id, component: the smallest id), its components joined where documents have
    sets of `width`-word shingles of a Jaccard similarity of `least` or more.

    The bounds of the sketches are those for 0.8; for another least, all but the sure are
    compared.  Documents without words have no set.  Rows that share an id are taken together.
    """
    met = durable(_sketched(docs, width), "sketches")
    reps = met.groupBy("name").agg(F.min("id").alias("rep"))
    named = met.join(reps.hint("merge"), "name")
    comp = _joined(comp, named.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    alone = named.where("id = rep").dropDuplicates(["id", "name"]).join(comp.distinct().hint("merge"), "id").select("id", "n", "component", F.explode("bands").alias("h"))
    mixed = _mixed(alone)
    sketches = _made(docs, mixed.select(F.col("id").alias("doc_id")).distinct(), width, "bits array<long>, bands array<long>", bits, bands)
    release(met)
    mixed = durable(mixed.join(sketches.hint("merge"), "id"), "mixed")
    like = f"least(na, nb) >= {least}D * greatest(na, nb) - 1e-9D"
    differ = "(" + " + ".join(f"bit_count(sa[{k}] ^ sb[{k}])" for k in range(BITS // 64)) + ")"
    sure, most = (SURE, MOST) if least == 0.8 else (-1, BITS)
    before = None
    for turn in itertools.count():
        by = mixed.groupBy("h", "component").agg(F.count("*").alias("n")).groupBy("h").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("twice"), F.sum("n").alias("n"))
        pairs, rows = by.agg(F.sum(F.col("twice") / 2), F.sum("n")).first()
        if not pairs or pairs <= SPARSE * rows or (before is not None and pairs > (1 - LITTLE) * before):
            break
        before = pairs
        comp = _joined(comp, _star(mixed, turn).where(f"{like} AND {differ} <= {sure}").select("a", "b").distinct())
        after = _mixed(mixed.drop("component").join(comp.distinct().hint("merge"), "id"))
        release(mixed)
        mixed = after
    side = lambda x: [F.col("id").alias(x), F.col("n").alias("n" + x), F.col("component").alias("c" + x), F.col("bits").alias("s" + x), F.col("bands").alias("h" + x)]
    # a pair comes of the first band that it shares
    met = mixed.select("h", *side("a")).join(mixed.select("h", *side("b")).hint("merge"), "h").where(f"ca < cb AND {like} AND {differ} <= {most} AND array_intersect(ha, hb)[0] = h")
    left = durable(met.select("a", "b", F.expr(f"{differ} <= {sure}").alias("sure")).distinct(), "left")
    doubt = _verified(left.where("NOT sure").select("a", "b"), docs, width, least)
    return _joined(comp, left.where("sure").select("a", "b").unionByName(doubt))
