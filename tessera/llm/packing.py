"""Packing token pieces into as few sequences as possible by exact-complement hashing.

All that decides a packing is how many pieces there are of each length, and there
are at most `capacity` lengths.  The driver plans on that histogram; the executors
then give each piece its place by its rank within its length.

Plan: for each length, longest first, an index of the available lengths answers
which single length, pair or triple sums exactly to the gap that it leaves; as many
sequences as the available counts allow are made of that combination at once.  What
no exact combination fills goes best-fit: the longest length that still fits, until
none does.  Each step uses up a length, so there are at most `capacity` patterns
in each phase, whatever the number of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import durable, table, tidy, wider
from tessera.llm.tokens import default_path, tokenizer

CAPACITY, END = 4096, 1


def _pair(left: np.ndarray, total: int) -> tuple[int, int] | None:
    """The available pair a >= b with a + b = total and the largest a."""
    if total < 2:
        return None
    b = np.arange(1, total // 2 + 1)
    ok = (left[b] > 0) & (left[total - b] > 0)
    if total % 2 == 0:
        ok[-1] = left[total // 2] > 1
    at = int(ok.argmax())
    return (total - int(b[at]), int(b[at])) if ok[at] else None


def _exact(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """A single length, a pair or a triple that fills the gap; left is what is available."""
    if left[gap]:
        return (gap,)
    if found := _pair(left, gap):
        return found
    for a in np.flatnonzero(left[: max(gap - 1, 0)])[::-1]:
        if 3 * a < gap:  # a would not be the largest of three
            return None
        left[a] -= 1
        found = _pair(left, gap - int(a))
        left[a] += 1
        if found:
            return (int(a), *found)
    return None


def _take(left: np.ndarray, lengths: tuple[int, ...]) -> int:
    """Use up as many times this combination as there is; how many times that is."""
    uniq, each = np.unique(lengths, return_counts=True)
    times = int((left[uniq] // each).min())
    left[uniq] -= times * each
    return times


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence in order, number of such sequences) that use up counts[length]."""
    left = np.asarray(counts, np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    for first in range(capacity - 1, 0, -1):
        while left[first]:
            left[first] -= 1
            rest = _exact(left, capacity - first)
            left[first] += 1
            if rest is None:
                break
            out.append(((first, *rest), _take(left, (first, *rest))))
    for first in range(capacity - 1, 0, -1):
        while left[first]:
            lengths, gap = [first], capacity - first
            left[first] -= 1
            have = np.flatnonzero(left[: gap + 1])
            while gap and len(have := have[have <= gap]):
                fit = int(have[-1])
                n = min(gap // fit, int(left[fit]))
                left[fit] -= n
                lengths += [fit] * n
                gap -= n * fit
                have = have[:-1]
            np.add.at(left, lengths, 1)
            out.append((tuple(lengths), _take(left, tuple(lengths))))
    return out


def _places(patterns: list[tuple[tuple[int, ...], int]], counts: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of pieces, by their number over all lengths: where a run starts, in which
    sequence and at which offset, and after how many pieces the next copy begins."""
    used, first = np.concatenate([[0], np.cumsum(counts)[:-1]]), 0
    rows = []
    for lengths, times in patterns:
        at, k = 0, 0
        while k < len(lengths):
            n = next((j for j in range(k, len(lengths)) if lengths[j] != lengths[k]), len(lengths)) - k
            rows.append((used[lengths[k]], first, at, times))
            used[lengths[k]] += n * times
            at += n * lengths[k]
            k += n
        first += times
    starts, seqs, offsets, times = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return {"start": starts, "seq": seqs, "offset": offsets, "times": times}


def pack(pieces: DataFrame, capacity: int = CAPACITY, order_by: tuple[str, ...] = ("doc_id", "piece"), run_of: str | None = None) -> DataFrame:
    """pieces with sequence_id and offset (long).  Column length: 1 to capacity.

    pieces is read twice, so it should be a written table.  Pieces of a length are
    numbered in `order_by` order within salted groups, so a length that a third of
    all pieces have is sorted by many tasks; to the driver come only counts by
    length and salt.  Ties are numbered arbitrarily, and each piece gets one place.
    run_of names a column of whole numbers from 0 that cuts the pieces into ordered runs; the
    salts are then groups of neighbouring runs, and pieces of a length are placed run by run.
    No pieces give no rows.  Columns sequence_id, offset, _salt and
    _rank, whatever their case, give way.
    """
    spark = pieces.sparkSession
    pieces = tidy(pieces, ("length", *order_by, *([run_of] if run_of else [])), ("sequence_id", "offset", "_salt", "_rank"))
    salts = min(512, max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salt = F.pmod(F.xxhash64(*order_by), F.lit(salts))
    if run_of:
        runs = (pieces.agg(F.max(run_of)).first()[0] or 0) + 1
        salt = F.floor(F.coalesce(run_of, F.lit(0)) * F.lit(min(salts, runs)) / F.lit(runs))
    salted = pieces.withColumn("_salt", salt.cast("int"))
    got = salted.groupBy("length", "_salt").count().toPandas()
    by = np.zeros((capacity + 1, salts), np.int64)
    by[got["length"].to_numpy(np.int64), got["_salt"].to_numpy(np.int64)] = got["count"].to_numpy(np.int64)
    counts = by.sum(1)
    before = np.cumsum(by.ravel()).reshape(by.shape) - by  # pieces of shorter lengths and of lower salts
    known = spark.sparkContext.broadcast((before, _places(plan(counts, capacity), counts)))
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, place = known.value
        for b in batches:
            col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
            length = col("length").astype(np.int64)
            n = before[length, col("_salt")] + col("_rank") - 1
            k = np.searchsorted(place["start"], n, "right") - 1
            copy, nth = np.divmod(n - place["start"][k], place["times"][k])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(place["seq"][k] + nth), pa.array(place["offset"][k] + copy * length)], [*names, "sequence_id", "offset"])

    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy(*order_by)).cast("long"))
    return ranked.mapInArrow(run, wider(pieces.schema, "sequence_id long, offset long"))


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids, then `end`, cut after every `capacity` ids.

    doc_id, the columns in keep, piece, start, length, ids_crc32 and, if asked for,
    the ids.  A null or empty text is the one id `end`.  A very long text is encoded whole and
    gives many pieces.  Repeated rows and null ids have pieces of their own; no rows give no
    rows.  Columns not named are left out, so none of docs' clashes with what is made.
    """
    path = path or default_path()
    docs = tidy(docs, ("doc_id", "text", *keep))
    last = np.array([end], "<u4").tobytes()
    kept = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for b in batches:
            of: list[int] = []
            cols: list[list] = [[], [], [], [], []]
            for k, t in enumerate(b.column(len(kept))):
                ids = encode(t.as_py() or "") + last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    of.append(k)
                    for c, v in zip(cols, (piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                        c.append(v)
            arrays = [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in cols[4]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of, pa.int64())) for c in b.columns[:-1]), *arrays], [*kept, *"piece start length ids_crc32 ids".split()[: len(arrays)]])

    given = docs.select(*kept, "text")
    return given.mapInArrow(run, wider(given.drop("text").schema, "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents' pieces."""
    return pack(durable(pieces(table(spark, sf_dir, "documents")), "pieces"))
