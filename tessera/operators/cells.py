"""Exact nearest neighbours by cosine, without looking into cells that can't hold one.

Unit vectors fall into cells around the nearest of at most CELLS centres, vectors of a
bounded sample.  A cell's radius is the distance of its farthest vector, so by the
triangle inequality none of its vectors is nearer to a query than the query's distance from
the centre less the radius.  A search scores each query's SEEDS nearest cells first; the
k-th distance found there is one that the true k-th can't exceed, and only cells whose
bound is within it are scored.  So the rows are those of comparing everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.scratch import durable

#: Centres at most, cells of a query that are scored first, queries that one search broadcasts at most.
CELLS, SEEDS, BLOCK = 1024, 4, 4096
#: Distances are rounded to nine digits before they are compared, and those of nearly equal vectors
#: lose half of their digits: bounds give way by this much.
SLACK = 1e-7


def _unit(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of those that have the length `dim`, a direction and finite components."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    if not len(rows):
        return rows, np.zeros((0, dim))
    x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.linalg.norm(x, axis=1)
    ok = (norm > 0) & np.isfinite(norm)
    return rows[ok], x[ok] / norm[ok, None]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors, never below the true ones by more than rounding."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


@dataclass
class CellIndex:
    """rows (cell, id, v: unit vector), written by cell; centres, and by cell its radius and size."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    @classmethod
    def build(cls, corpus: DataFrame, id_col: str = "id", vec_col: str = "vec", cells: int | None = None) -> CellIndex:
        """Vectors of the most frequent length; null and zero ones, and ones with null or infinite
        components, are left out.  Repeated rows stay."""
        spark = corpus.sparkSession
        given = corpus.where(F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull())).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        dims = given.where(F.size("vec") > 0).groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = dims.d if dims else 1
        wanted = max(1, min(CELLS, cells or int(np.sqrt(dims["count"] if dims else 1))))
        picked = given.where(F.size("vec") == dim).orderBy(F.xxhash64("id"), "id").limit(wanted).collect()  # CELLS at most
        _, centres = _unit(pa.array([r.vec for r in picked] or [[0.0] * dim], pa.list_(pa.float64())), dim)
        centres = centres if len(centres) else np.eye(1, dim)
        shared = spark.sparkContext.broadcast(centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, x = _unit(b.column(1), dim)
                dot = x @ shared.value.T
                cell = dot.argmax(1) if len(x) else np.zeros(0, np.int64)
                far = np.sqrt(np.maximum(2 - 2 * dot[np.arange(len(x)), cell], 0))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0).take(pa.array(rows)), pa.array(list(x), pa.list_(pa.float64())), pa.array(far)], ["cell", "id", "v", "far"])

        placed = given.mapInArrow(place, "cell int, id long, v array<double>, far double")
        rows = durable(placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell"), "cells")
        radius, size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in rows.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row for each centre
            radius[r.cell], size[r.cell] = r.far, r.n
        return cls(rows.select("cell", "id", "v"), centres, radius, size)

    def _scored(self, names: np.ndarray, q: np.ndarray, open_: np.ndarray, k: int) -> DataFrame:
        """(query_id, id, distance): each batch's k best of each query in the cells open to it (queries by cells)."""
        shared = self.rows.sparkSession.sparkContext.broadcast((names, q, open_))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, open_ = shared.value
            for b in batches:
                cell = b.column(0).to_numpy(zero_copy_only=False)
                ids = b.column(1).to_numpy(zero_copy_only=False)
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(cell), -1)
                for c in np.unique(cell):
                    rows, asked = np.flatnonzero(cell == c), np.flatnonzero(open_[:, c])
                    if not len(asked):
                        continue
                    d = np.round(1 - q[asked] @ x[rows].T, 9)
                    if d.shape[1] > k:  # ties with the k-th stay
                        r, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
                    else:
                        r, col = (i.ravel() for i in np.indices(d.shape))
                    yield pa.RecordBatch.from_arrays([pa.array(names[asked[r]]), pa.array(ids[rows[col]]), pa.array(d[r, col])], ["query_id", "id", "distance"])

        cells = np.flatnonzero(open_.any(0)).tolist()
        return self.rows.where(F.col("cell").isin(cells)).mapInArrow(run, "query_id long, id long, distance double")

    def _asked(self, queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query_id, unit vectors), up to BLOCK queries at a time."""
        dim, names, vecs = self.centres.shape[1], [], []
        for r in queries.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())).toLocalIterator():
            names.append(r.query_id)
            vecs.append(r.vec)
            if len(names) == BLOCK:
                yield self._units(names, vecs, dim)
                names, vecs = [], []
        if names:
            yield self._units(names, vecs, dim)

    @staticmethod
    def _units(names: list, vecs: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rows, q = _unit(pa.array(vecs, pa.list_(pa.float64())), dim)
        return np.array(names, np.int64)[rows], q

    def opened(self, names: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """Queries by cells: which cells may hold one of a query's k nearest."""
        near = _apart(q, self.centres)
        bound = np.where(self.size > 0, np.maximum(near - self.radius, 0), np.inf)
        first = np.zeros_like(bound, bool)
        order = np.argsort(np.where(self.size > 0, near, np.inf), axis=1)[:, : min(SEEDS, len(self.size))]
        np.put_along_axis(first, order, True, axis=1)
        nth = F.row_number().over(W.partitionBy("query_id").orderBy("distance"))
        least = {r.query_id: r.distance for r in self._scored(names, q, first & (self.size > 0), k).withColumn("nth", nth).where(F.col("nth") == k).collect()}  # a row for each query of the block
        worst = np.array([least.get(n, np.inf) for n in names.tolist()])
        return (bound <= np.sqrt(2 * (np.maximum(worst, 0) + 1e-9))[:, None] + SLACK) & (self.size > 0)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, distance, rank) for queries (query_id, vec), as retrieve.dense_top_k() has it."""
        found = None
        for names, q in self._asked(queries):
            if len(names):
                part = self._scored(names, q, self.opened(names, q, k), k)
                found = part if found is None else found.unionByName(part)
        if found is None:
            found = self.rows.sparkSession.createDataFrame([], "query_id long, id long, distance double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def share_compared(self, queries: DataFrame, k: int) -> float:
        """The share of all pairs of a query and a vector that a search compares."""
        pairs = every = 0
        for names, q in self._asked(queries):
            pairs += int((self.opened(names, q, k) * self.size).sum())
            every += len(names) * int(self.size.sum())
        return pairs / every if every else 0.0
