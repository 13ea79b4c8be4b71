"""Near-duplicate embeddings: small-world graphs by shard, verified cosines, components."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import components, durable, scratch, table, tidy
from tessera.llm.hnsw import Graph, range_search

#: Least cosine of a link, vectors in a shard, queries multiplied at a time, and how far
#: below the least cosine the single-precision search still looks.
COSINE, SHARD, BLOCK, SLACK = 0.98, 8192, 512, 2e-4


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    flat = t.column(name).combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return v.reshape(t.num_rows, -1)


def _unit(v: np.ndarray) -> np.ndarray:
    # the largest component comes to 1 first, so that no length overflows or vanishes
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _build(t: pa.Table) -> pa.Table:
    t = t.sort_by("rep")
    v = _unit(_matrix(t, "v"))
    g = Graph(v)
    blob = pickle.dumps((t.column("rep").to_numpy(), t.column("m").to_numpy(), v, g.layers, g.entry), protocol=5)
    return pa.table({**{k: t.column(k)[:1] for k in ("label", "dim", "shard", "shards")}, "graph": pa.array([blob], pa.binary())})


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of 0 .. n - 1 reaches over edges a - b."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def _grouped(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, rows): each column with a hit, and the first row of its component of the two-sided graph."""
    rows = np.arange(len(hit), dtype=np.int32)
    while True:
        cols = np.where(hit, rows[:, None], len(hit)).min(0)
        new = np.minimum(rows, np.where(hit, cols[None, :], len(hit)).min(1))
        if (new == rows).all():
            return cols, rows
        rows = new


def _compared(least: float):
    """A function from one or two graphs of a label to what links the vectors in them: of kind
    0 (a: class, b: how many vectors of other classes it is linked with here), 1 (a: class, b:
    the smallest class of its component here), 2 and 3 (a: pairs, or neighbours, that the audit
    wanted, b: that it got)."""

    def run(t: pa.Table) -> pa.Table:
        sides = [pickle.loads(x.as_py()) for x in t.sort_by("shard").column("graph")]
        first, last = sides[0], sides[-1]
        own = len(sides) == 1
        ids = first[0] if own else np.concatenate([first[0], last[0]])
        times = first[1] if own else np.concatenate([first[1], last[1]])
        n, step = len(ids), 0 if own else len(first[0])
        count, edges, keys, audits = np.zeros(n, np.int64), [], [], []
        exact = np.zeros(n, bool)
        searched = []
        for (_, _, v, layers, entry), (_, _, q, *_), at, to in ([(first, first, 0, 0)] if own else [(last, first, 0, step), (first, last, step, 0)]):
            found = range_search(Graph(v, layers, entry), q.astype(np.float32), least - SLACK, own)
            exact[at : at + len(q)] = found.saturated
            ok = np.einsum("nd,nd->n", q[found.row], v[found.col]) >= least
            searched.append((q, v, at, to, found.saturated))
            keys += [(found.row[ok] + at) * n + found.col[ok] + to, (found.col[ok] + to) * n + found.row[ok] + at]
            audits.append((found.pairs, found.near))
        for q, v, at, to, saturated in searched:
            rows = np.flatnonzero(saturated)
            for k in range(0, len(rows), BLOCK):
                r = rows[k : k + BLOCK]
                hit = q[r] @ v.T >= least
                if own:
                    hit[np.arange(len(r)), r] = False
                count[r + at] += hit @ times[to : to + len(v)]
                cols, group = _grouped(hit)
                some = np.flatnonzero(hit.any(0))
                edges += [(some + to, r[cols[some]] + at), (r + at, r[group] + at)]
                x, y = np.nonzero(hit[:, ~exact[to : to + len(v)]])
                keys.append((np.flatnonzero(~exact[to : to + len(v)])[y] + to) * n + r[x] + at)
        a, b = np.divmod(np.unique(np.concatenate(keys)), n)
        np.add.at(count, a[~exact[a]], times[b[~exact[a]]])
        edges.append((a, b))
        root = _roots(n, *(np.concatenate(x) for x in zip(*edges, strict=True)))
        smallest = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(smallest, root, ids)
        smallest = smallest[root]
        linked, joined = np.flatnonzero(count), np.flatnonzero(smallest != ids)
        parts = [(0, ids[linked], count[linked]), (1, ids[joined], smallest[joined])]
        parts += [(kind, [want], [got]) for pairs, near in audits for kind, (want, got) in ((2, pairs), (3, near))]
        return pa.table({"kind": pa.array(np.concatenate([np.full(len(x), kind) for kind, x, _ in parts]), pa.int32()), **{c: pa.array(np.concatenate([np.asarray(p[k], np.int64) for p in parts])) for k, c in ((1, "a"), (2, "b"))}})

    return run


def classes(vectors: DataFrame) -> DataFrame:
    """(label, dim, v, rep, m) of the vectors (vec_id, v, label) that can link: equal ones
    with one label are one class, of m vectors, named by the smallest vec_id."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return vectors.where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & some).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).withColumn("dim", F.size("v"))


def links(reps: DataFrame, least: float = COSINE, shard: int = SHARD) -> DataFrame:
    """(kind, a, b), see _compared(), of classes reps (of classes(), written), never a row for a pair.

    A label is cut into as many shards as its size asks for, so one that has a third of
    all vectors is many tasks, each of bounded memory.  Every class is a query to each
    shard of its label: a task holds the graphs of two shards, and searches each with the
    vectors of the other.
    """
    n = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    sized = reps.join(n, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(3)), "shards").cast("int"))
    made = StructType([reps.schema["label"], *StructType.fromDDL("dim int, shard int, shards int, graph binary").fields])
    graphs = durable(sized.select("label", "dim", "shard", "shards", "rep", "m", "v").groupBy("label", "dim", "shard").applyInArrow(_build, made), "graphs")
    met = graphs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    keys = ["label", "dim", "low", "high"]
    met = met.select("label", "dim", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"), "shard", "graph")
    return met.groupBy(*keys).applyInArrow(_compared(least), "kind int, a long, b long")


def recall(found: DataFrame) -> DataFrame:
    """(kind, wanted, got) of the audits in links(): 2 are pairs, 3 nearest neighbours."""
    return found.where("kind >= 2").groupBy("kind").agg(F.sum("a").alias("wanted"), F.sum("b").alias("got"))


def near_duplicates(embeddings: DataFrame, least: float = COSINE, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of embeddings (vec_id, embedding, label).

    Labels are of any type.  Links join vectors with equal labels and a cosine of at least `least` (double
    precision).  Null or zero vectors, ones with null, infinite or NaN components, a
    null label, and vectors of different lengths link with nothing.  Copies are
    compared once, as a class.  Repeated rows are vectors like any other.  Other columns
    are not looked at; of two that differ from a needed one in case only, the first counts.
    No rows give no rows.
    """
    embeddings = tidy(embeddings, ("vec_id", "embedding", "label"))
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), "label")
    with scratch() as keep:
        reps = keep(durable(classes(vectors), "classes"))
        found = durable(links(reps, least, shard), "links")
        other = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("k"))
        joined = components(found.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
        linked = keep(durable(other.join(joined.withColumnRenamed("node", "rep"), "rep", "full"), "linked"))
    known = reps.join(linked, "rep", "left").select("label", "v", (F.coalesce("k", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = vectors.join(known, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98 AND NOT isnan(list_cosine_similarity(a.e, b.e))),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = c.vec_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
