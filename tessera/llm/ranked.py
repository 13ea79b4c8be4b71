"""Ranked lexical search with a hierarchical max tree over document ranges.

The index is a table of segments.  A segment is a range of at most SEGMENT documents of one
partition; its rows are the postings of one term each (document numbers within the
segment, occurrences), and one row with the documents' ids and lengths.  So no row grows
with the corpus, and a frequent term's postings lie in as many rows as there are segments.

A search sends the postings of the queries' terms to their segments.  There each term
gets a tree: its leaves hold the term's largest impact in LEAF documents, each level above
the largest of FAN nodes.  The weighted sum of the terms' maxima bounds every score in
a node's range, so a query descends best-first: it opens the node with the highest bound
until no bound reaches its k-th score.  Nodes whose bound equals that score are opened too,
for a tie may have a smaller id.  A task carries its best k from segment to segment, and
gives at most k rows for each query; Spark merges them.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import durable, table, tidy

#: Documents and postings of a segment at most (one document may have more postings).
SEGMENT, POSTINGS = 4096, 1_000_000
#: Documents of a leaf, children of a node.
LEAF, FAN = 32, 8
#: Queries, and rows of terms by query, that are broadcast at most (one query may have more terms).
BLOCK, BLOCK_TERMS = 4096, 400_000
#: Cells of a segment's matrix of terms by documents at most.
CELLS = 8_000_000
#: Fixed value: hits of a query.
TOP = 10
_ROWS = "segment long, term string, df int, docs array<int>, tfs array<int>, ids array<long>, lengths array<long>"
# A-Z to a-z; what is neither an ASCII letter or digit nor part of another character to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Characters that are split into words at a time.
_SLICE = 4_000_000


def terms(text: str | None) -> Counter:
    """How often a text has each term, as UTF-8 bytes."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    out: Counter = Counter()
    start = 0
    while start < len(data):
        end = data.find(b" ", start + _SLICE)
        end = len(data) if end < 0 else end
        out.update(data[start:end].split())
        start = end
    return out


class _Segment:
    """Documents as they come, until there are enough of them."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.postings: dict[bytes, tuple[list[int], list[int]]] = {}
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        at, found = len(self.ids), terms(text)
        self.ids.append(doc_id)
        self.lengths.append(sum(found.values()))
        for t, n in found.items():
            known = self.postings.get(t)
            if known is None:
                self.postings[t] = ([at], [n])
            else:
                known[0].append(at)
                known[1].append(n)
        self.size += len(found)

    def rows(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[None], [None], [None], [None], [self.ids], [self.lengths]]
        held = 0
        for t in sorted(self.postings):
            docs, tfs = self.postings[t]
            for c, v in zip(cols, (t.decode("utf-8", "surrogatepass"), len(docs), docs, tfs, None, None), strict=True):
                c.append(v)
            held += len(docs)
            if held > 200_000:
                yield self._batch(number, cols, schema)
                cols, held = [[], [], [], [], [], []], 0
        if cols[0]:
            yield self._batch(number, cols, schema)

    @staticmethod
    def _batch(number: int, cols: list[list], schema: pa.Schema) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip([[number] * len(cols[0]), *cols], schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def index(docs: DataFrame) -> DataFrame:
    """The rows of all segments of docs (doc_id, text); to be written before they are searched.

    Row of documents: term null, ids and lengths (0 for a text without a term, also a null
    one).  Row of a term: df, docs (numbers within the segment, ascending), tfs.  Repeated rows
    and rows with a null doc_id are documents of their own.  Other columns are left out.
    """
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    schema = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("docs", ints), ("tfs", ints), ("ids", longs), ("lengths", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 32, _Segment()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                now.add(doc_id, text.as_py())
                if len(now.ids) >= SEGMENT or now.size >= POSTINGS:
                    yield from now.rows(number, schema)
                    number, now = number + 1, _Segment()
        if now.ids:
            yield from now.rows(number, schema)

    return tidy(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROWS)


def _tree(leaf_level: np.ndarray) -> list[np.ndarray]:
    """The levels of all terms' trees from the root to the leaves; leaf_level is terms by leaves."""
    levels = [leaf_level]
    while levels[0].shape[1] > 1:
        starts = np.arange(0, levels[0].shape[1], FAN)
        levels.insert(0, np.maximum.reduceat(levels[0], starts, axis=1))
    return levels


class Searcher:
    """The best k of each query over the segments that it is shown."""

    def __init__(self, queries: dict[int, list[tuple[str, int]]], k: int, n: int, total: int) -> None:
        """queries: (term, weight times its number in the query); n, total: documents with a term, their terms."""
        self.queries, self.k, self.n, self.total = queries, k, n, total
        self.best: dict[int, list[tuple[int, bool, int]]] = {q: [] for q in queries}  # (-score, null id, id), best first
        self.opened = self.leaves = 0

    def segment(self, ids: list[int | None], lengths: list[int], postings: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """One segment: postings of the queries' terms that it has."""
        different, place = np.unique(np.asarray(lengths, np.int64), return_inverse=True)
        m = np.array([25 + 75 * int(x) * self.n // self.total if self.total else 25 for x in different], np.int64)[place]
        null = np.array([i is None for i in ids])
        keys = np.array([0 if i is None else i for i in ids], np.int64)
        asked = {q: [(t, w) for t, w in ts if t in postings and w > 0] for q, ts in self.queries.items()}
        most = max(1, CELLS // len(ids))
        group: list[int] = []
        known: dict[str, int] = {}
        for q, ts in asked.items():
            if not ts:
                continue
            fresh = [t for t, _ in ts if t not in known]
            if group and len(known) + len(fresh) > most:
                self._search(group, asked, known, postings, m, null, keys)
                group, known, fresh = [], {}, [t for t, _ in ts]
            group.append(q)
            for t in fresh:
                known.setdefault(t, len(known))
        if group:
            self._search(group, asked, known, postings, m, null, keys)

    def _search(self, group: list[int], asked: dict, known: dict[str, int], postings: dict, m: np.ndarray, null: np.ndarray, keys: np.ndarray) -> None:
        size = -(-len(keys) // LEAF) * LEAF
        impact = np.zeros((len(known), size), np.int32)  # below 1,000,000: 10^9 tf div (1000 tf + ...)
        for t, row in known.items():
            docs, tf = postings[t]
            impact[row, docs] = (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])
        levels = _tree(impact.reshape(len(known), -1, LEAF).max(2))
        for q in group:
            rows = np.array([known[t] for t, _ in asked[q]])
            weights = np.array([w for _, w in asked[q]], np.int64)
            self._descend(q, rows, weights, levels, impact, null, keys)

    def _descend(self, q: int, rows: np.ndarray, weights: np.ndarray, levels: list[np.ndarray], impact: np.ndarray, null: np.ndarray, keys: np.ndarray) -> None:
        best, k, n = self.best[q], self.k, len(keys)
        bound = int(weights @ levels[0][rows, 0].astype(np.int64))
        heap = [(-bound, 0, 0)]  # (-bound, level, node)
        while heap:
            negative, level, node = heapq.heappop(heap)
            if negative == 0 or len(best) == k and negative > best[-1][0]:
                break  # no document here, or in what is left, reaches the k-th score
            self.opened += 1
            if level < len(levels) - 1:
                part = levels[level + 1][rows, node * FAN : (node + 1) * FAN].astype(np.int64)
                for j, b in enumerate((weights @ part).tolist()):
                    if b > 0 and (len(best) < k or -b <= best[-1][0]):
                        heapq.heappush(heap, (-b, level + 1, node * FAN + j))
                continue
            self.leaves += 1
            start = node * LEAF
            scores = weights @ impact[rows, start : min(start + LEAF, n)].astype(np.int64)
            floor = -best[-1][0] if len(best) == k else 1
            hits = np.flatnonzero(scores >= floor)
            if len(hits):
                best.extend((-int(scores[h]), bool(null[start + h]), int(keys[start + h])) for h in hits)
                best.sort()
                del best[k:]


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, dict[str, tuple[np.ndarray, np.ndarray]]]]:
    """(ids, lengths, postings) of each segment, from its rows in order, the documents' row first."""
    at, ids, lengths, postings = None, [], [], {}
    for b in batches:
        segment, term = b.column("segment").to_pylist(), b.column("term").to_pylist()
        docs, tfs = b.column("docs"), b.column("tfs")
        for i, (s, t) in enumerate(zip(segment, term, strict=True)):
            if s != at:
                if at is not None:
                    yield ids, lengths, postings
                at, ids, lengths, postings = s, [], [], {}
            if t is None:
                ids, lengths = b.column("ids")[i].as_py(), b.column("lengths")[i].as_py()
            else:
                postings[t] = (docs[i].values.to_numpy(), tfs[i].values.to_numpy().astype(np.int64))
    if at is not None:
        yield ids, lengths, postings


def _blocks(asked: DataFrame) -> Iterator[list[tuple[int, str, int]]]:
    """(query, term, number) of the queries, bounded by BLOCK and BLOCK_TERMS at a time; they
    pass the driver one partition after the other."""
    out: list[tuple[int, str, int]] = []
    queries = 0
    for r in asked.orderBy("query").toLocalIterator():
        if out and r.query != out[-1][0]:
            queries += 1
            if queries >= BLOCK or len(out) >= BLOCK_TERMS:
                yield out
                out, queries = [], 0
        out.append((r.query, r.term, r.n))
    if out:
        yield out


def _asked(queries: DataFrame) -> DataFrame:
    """(query, item_id, term, n) of different (item_id, text), written."""
    numbered = tidy(queries, ("item_id", "text")).select("item_id", "text").distinct().withColumn("query", F.monotonically_increasing_id())
    given = durable(numbered, "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(q, t.decode("utf-8", "surrogatepass"), n) for q, text in zip(b.column("query").to_pylist(), b.column("text"), strict=True) for t, n in terms(text.as_py()).items()]
            q, t, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(t, pa.string()), pa.array(n, pa.int64())], ["query", "term", "n"])

    split = durable(given.select("query", "text").mapInArrow(run, "query long, term string, n long"), "terms")
    return split.join(given.select("query", "item_id"), "query")


def search(rows: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of a written index for each query (item_id, text).

    Equal scores go by doc_id, null ids last; documents with a score of 0 are no hits.  A query
    without terms has none.  Different texts under one item_id are queries of their own, each
    with ranks from 1; repeated rows are one query.  Queries come in blocks, each of which is
    broadcast and held against all segments.
    """
    spark = rows.sparkSession
    asked = durable(_asked(queries), "asked")
    has = F.filter("lengths", lambda x: x > 0)
    known = rows.where("term IS NULL").agg(F.sum(F.size(has)).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total")).first()
    n, total, found = known.n or 0, known.total or 0, None
    for block in _blocks(asked.select("query", "term", "n")):
        wanted = spark.createDataFrame([(t,) for t in {t for _, t, _ in block}], "term string")
        mine = rows.where("term IS NOT NULL").join(F.broadcast(wanted), "term")  # BLOCK_TERMS rows, or one query's
        df = {r.term: r.df for r in mine.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weighed: dict[int, list[tuple[str, int]]] = {}
        for q, t, times in block:
            weighed.setdefault(q, []).append((t, times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) if t in df else 0))
        shared = spark.sparkContext.broadcast(weighed)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            s = Searcher(shared.value, k, n, total)
            for ids, lengths, postings in _open(batches):
                s.segment(ids, lengths, postings)
            hits = [(q, None if null else i, -score) for q, best in s.best.items() for score, null, i in best]
            q, i, score = zip(*hits, strict=True) if hits else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(score, pa.int64())], ["query", "doc_id", "score"])

        to = rows.where("term IS NULL").select(*rows.columns).unionByName(mine.select(*rows.columns))
        dealt = to.repartition("segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first())
        part = dealt.select("segment", "term", "docs", "tfs", "ids", "lengths").mapInArrow(run, "query long, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    names = asked.select("query", "item_id").distinct()
    if found is None:
        return names.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(names, "query").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 10 best of all documents for each benchmark item."""
    rows = durable(index(table(spark, sf_dir, "documents")), "segments")
    return search(rows, table(spark, sf_dir, "benchmark"))


_TERMS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"
ORACLE_OP13 = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents),
asked AS MATERIALIZED (SELECT q, item_id, term, count(*) AS qtf FROM (SELECT q, item_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS q, * FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL),
stats AS (SELECT count(*)::BIGINT AS N, coalesce(sum(len(w)), 0)::BIGINT AS L FROM docs WHERE len(w) > 0),
post AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM post GROUP BY term), stats),
m AS (SELECT row, doc_id, 25 + (75 * len(w) * N) // L AS m FROM docs, stats WHERE len(w) > 0),
scored AS (SELECT q, item_id, row, doc_id, sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN weights USING (term) JOIN post USING (term) JOIN m USING (row) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, place::INT AS rank, doc_id, score FROM placed WHERE place <= 10"""
