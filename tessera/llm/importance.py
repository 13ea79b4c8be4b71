"""Importance resampling: the documents that look most like a target, by hashed n-grams.

DuckDB does the counting in each partition: SQL unnests a text's words, a window puts
the words that follow beside each, and a registered CRC function hashes the runs into
buckets.  What it counts goes to Parquet in the folder that driver and executors
share: the buckets of every document, and one row of totals for each partition.  Spark
merges the totals, makes a gain of each bucket, and scores the written documents
without reading a text again.

The draw is without replacement: each score is the document's mean gain plus noise of
Gumbel's distribution from a hash of its id, and the highest are drawn.  Scores are
whole numbers in a bounded range, so ranks come from a histogram of scores (at most
SCORES rows on the driver) and from ranks among equal scores; no task sorts all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import durable, scratch_path, table, tidy, wider

#: Buckets, words of the longest run, per cent drawn, words of a document that may be drawn, seed.
BUCKETS, RUN, PERCENT, LEAST, SEED = 10_000, 2, 25, 20, 7
#: Characters of a piece that a long text is cut into, and of the pieces of one SQL statement.
PIECE, AT_ONCE = 500_000, 1_000_000
#: Bytes of a row group, which the writer holds in memory.
ROW_GROUP = 16 * 1024 * 1024
#: Different scores: gains and noise in thousandths of natural logarithms of 64-bit counts.
SCORES = 150_000
_TOTAL = pa.struct([("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GIVEN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _crc(features: pa.ChunkedArray) -> pa.Array:
    """zlib's CRC-32 of each string, cut from one copy of their bytes."""
    crc, out = zlib.crc32, []
    for part in features.chunks:
        _, at, data = part.cast(pa.binary()).buffers()
        ends = np.frombuffer(at, np.int32, len(part) + 1, part.offset * 4).tolist() if len(part) else [0]
        first, raw = ends[0], b"" if data is None else memoryview(data)[ends[0] : ends[-1]].tobytes()
        out += [crc(raw[i - first : j - first]) for i, j in pairwise(ends)]
    return pa.array(np.array(out, np.uint32))


def _statement(buckets: int, run: int) -> str:
    """(row, bucket, n, words) of a table `texts` (row, part, seen, text): how often a bucket is
    met by a run of 1 to `run` words, and how many of these are single words.  A piece's
    first `seen` words are the last ones of the piece before it."""
    after = "".join(f", lead(word, {k}) OVER inside AS w{k}" for k in range(1, run))
    runs = ["word" + "".join(f" || ' ' || w{j}" for j in range(1, k + 1)) for k in range(run)]  # null past the last word
    return f"""
    WITH parts AS (SELECT row, part, seen, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS words FROM texts),
    flat AS (SELECT row, part, seen, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM parts),
    follow AS (SELECT row, seen, pos, word{after} FROM flat WINDOW inside AS (PARTITION BY row, part ORDER BY pos)),
    features AS (SELECT row, seen, pos, unnest([{", ".join(runs)}]) AS feature, unnest(range({run})) AS more FROM follow)
    SELECT row, (crc(feature) % {buckets})::INT AS bucket, count(*) AS n, count(*) FILTER (more = 0) AS words
    FROM features WHERE feature IS NOT NULL AND pos + more > seen GROUP BY row, bucket"""


def _pieces(text: str, run: int) -> Iterator[tuple[int, str]]:
    """(seen, piece): a text, cut between words where it is long; each further piece begins
    with the last run - 1 words of the one before."""
    start = end = seen = 0
    while True:
        gap = _GAP.search(text, end + PIECE)
        end = gap.start() if gap else len(text)
        yield seen, text[start:end]
        if end == len(text):
            return
        last = [m.start() for m in _GIVEN_WORD.finditer(text, start, end)][1 - run :] if run > 1 else []
        start, seen = (last[0] if last else end), len(last)


def _runs(texts: list[str | None], run: int) -> Iterator[list[tuple[int, int, int, str]]]:
    """(row, at, seen, piece) of the texts, up to AT_ONCE characters at a time."""
    out, size = [], 0
    for row, text in enumerate(texts):
        for at, (seen, piece) in enumerate(_pieces(text or "", run)):
            if size and size + len(piece) > AT_ONCE:
                yield out
                out, size = [], 0
            out.append((row, at, seen, piece))
            size += len(piece)
    if out:
        yield out


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about AT_ONCE bytes, of one row at least."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
        yield start, end
        start = end


class _Counter:
    """Bucket counts of batches of texts, by a DuckDB of its own."""

    def __init__(self, buckets: int, run: int) -> None:
        import duckdb
        from duckdb.sqltypes import UINTEGER, VARCHAR

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.create_function("crc", _crc, [VARCHAR], UINTEGER, type="arrow")
        self.sql, self.run, self.buckets = _statement(buckets, run), run, buckets

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """row, bucket, n, words, by row and bucket."""
        found = []
        for part in _runs(texts, self.run):
            row, at, seen, text = zip(*part, strict=True)
            self.db.register("texts", pa.table({"row": pa.array(row, pa.int64()), "part": pa.array(at, pa.int64()), "seen": pa.array(seen, pa.int64()), "text": pa.array(text, pa.string())}))
            got = self.db.execute(self.sql).fetchnumpy()
            self.db.unregister("texts")
            found.append([np.asarray(got[c], np.int64) for c in ("row", "bucket", "n", "words")])
        row, bucket, n, words = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else ([],) * 4))
        key, at = np.unique(row * self.buckets + bucket, return_inverse=True)  # a text may be in two statements
        add = lambda x: np.bincount(at, x, len(key)).astype(np.int64) if len(key) else x
        return key // self.buckets, key % self.buckets, add(n), add(words)


def counted(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """The kept columns, n_words, n_features, buckets and counts (arrays of one length), total.

    A row whose total is null is a document.  Each partition ends with a row of its sums, in
    total (arrays of buckets and counts) alone, so they are read without the documents'
    arrays.  A null text has no words.
    """
    docs = tidy(docs, (*keep, "text")).select(*keep, "text")
    kept = docs.drop("text").schema
    schema = wider(kept, "n_words long, n_features long, buckets array<int>, counts array<int>, total struct<buckets:array<int>,counts:array<bigint>>")
    names = [f.name for f in schema.fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, sums, types = None, np.zeros(buckets, np.int64), None
        for b in batches:
            counter = counter or _Counter(buckets, run)
            types, texts = b.schema.types[:-1], b.column(b.num_columns - 1)
            for start, end in _slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
                size = end - start
                row, bucket, n, single = counter.count(texts.slice(start, size).to_pylist())
                by = lambda x: np.bincount(row, x, size).astype(np.int64) if len(row) else np.zeros(size, np.int64)  # noqa: B023, E731
                ends, n_words = pa.array(np.concatenate([[0], np.cumsum(by(None))]), pa.int32()), by(single)
                lists = [pa.ListArray.from_arrays(ends, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(n, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, size) for c in b.columns[:-1]), pa.array(n_words), pa.array(by(n)), *lists, pa.nulls(size, _TOTAL)], names)
                np.add.at(sums, bucket, n)
        if types is not None:
            at = np.flatnonzero(sums)
            row = [pa.nulls(1, t) for t in (*types, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            row.append(pa.array([{"buckets": at.tolist(), "counts": sums[at].tolist()}], _TOTAL))
            yield pa.RecordBatch.from_arrays(row, names)

    return docs.mapInArrow(count, schema)


def merged(rows: DataFrame) -> DataFrame:
    """(bucket, n) of the partitions' sums."""
    each = rows.where("total IS NOT NULL").select(F.explode(F.arrays_zip("total.buckets", "total.counts")).alias("x"))
    return each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of merged counts: thousandths of the logarithm of how much likelier the
    target has a bucket, each count raised by one; buckets that neither has are left out."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    each = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    sums = each.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    gain = F.floor(1000 * F.ln((d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))))
    return each.join(F.broadcast(sums)).select("bucket", gain.cast("long").alias("gain"))


def weighed(docs: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """counted() documents with weight, the floored mean gain of their features, in place of
    the arrays.  gain goes to the driver and to each task: one number for each bucket."""
    known = np.zeros(buckets, np.int64)
    for r in gain.collect():
        known[r.bucket] = r.gain
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = [c for c in docs.columns if c not in ("buckets", "counts", "total")]
    part = docs.select(*names, "buckets", "counts")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, n = b.column("buckets"), b.column("counts")
            ends = np.concatenate([[0], np.cumsum(bucket.value_lengths().to_numpy())])
            each = np.concatenate([[0], np.cumsum(shared.value[bucket.flatten().to_numpy()] * n.flatten().to_numpy().astype(np.int64))])
            features = b.column("n_features").to_numpy()
            weight = (each[ends[1:]] - each[ends[:-1]]) // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(weight.astype(np.int64))], [*names, "weight"])

    return part.mapInArrow(weigh, wider(part.drop("buckets", "counts").schema, "weight long"))


def noise(seed: int, id_col: str = "doc_id"):  # noqa: ANN201
    """Thousandths of a Gumbel variate from the id's hash; a null id is hashed as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """scored (a written table with doc_id, n_words and score) with rank among the drawn, else null."""
    spark = scored.sparkSession
    may = F.col("n_words") >= least
    seen = sorted(((r.score, r["count"]) for r in scored.where(may).groupBy("score").count().collect()), reverse=True)
    draw, before, rows = percent * sum(n for _, n in seen) // 100, 0, []
    for score, n in seen:
        if before >= draw:
            break
        rows.append((score, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(rows, "score long, _before long"))  # SCORES rows at most
    lowest = F.lit(rows[-1][0] if rows else None).cast("long")
    top = F.coalesce(may & (F.col("score") >= lowest), F.lit(False))
    place = F.col("_before") + F.row_number().over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    drawn = scored.where(top).join(starts, "score").withColumn("rank", F.when(place <= draw, place.cast("long")))
    return drawn.select(*scored.columns, "rank").unionByName(scored.where(~top).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of docs (doc_id, text); target has text.

    Whole texts count; a long one is cut between words and its pieces are put together.
    Null and empty texts have no features and weight 0.  Of equal scores the smaller doc_id is
    drawn first, null ids last; repeated rows are documents of their own, in any order.  No
    documents give no rows, and an empty target makes all buckets alike but for their counts.
    Other columns, and any whose names clash with made ones, are left out.
    """
    made, path = counted(docs, buckets=buckets, run=run), scratch_path(docs.sparkSession, "buckets")
    made.write.options(compression="zstd", **{"parquet.block.size": ROW_GROUP}).parquet(path)
    kept = docs.sparkSession.read.schema(made.schema).parquet(path)
    gain = gains(merged(kept), merged(counted(target, (), buckets, run)), buckets)
    weight = weighed(kept.where("total IS NULL"), gain, buckets)
    return ranked(durable(weight.withColumn("score", F.col("weight") + noise(seed)), "scored"), percent, least)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of all documents against all benchmark texts."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


# CRC-32 in SQL: the table of bytes by its rule, then a fold over the bytes of each different feature.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
ORACLE_OP11 = rf"""
WITH tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
words AS (SELECT 'd' AS side, rowid AS row, doc_id, {{words}} AS w FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
  UNION ALL SELECT 'b', rowid, NULL, {{words}} FROM (SELECT row_number() OVER () AS rowid, text FROM benchmark)),
feats AS (SELECT side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
known AS MATERIALIZED (SELECT f, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode(f))), 2), lambda i: ('0x' || substr(hex(encode(f)), i, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000)::BIGINT AS bucket FROM (SELECT DISTINCT f FROM feats), tab),
counts AS MATERIALIZED (SELECT side, row, bucket, count(*) AS n FROM feats JOIN known USING (f) GROUP BY ALL),
each AS (SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END)::DOUBLE AS t FROM counts GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS cs, coalesce(sum(t), 0) AS ct FROM each),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (cs + 10000) / ((s + 1) * (ct + 10000))))::BIGINT AS g FROM each, sums),
docs AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(x.n, 0)::BIGINT AS n_features, coalesce(floor(x.g::DOUBLE / x.n), 0)::BIGINT AS weight
  FROM (SELECT * FROM words WHERE side = 'd') w LEFT JOIN (SELECT row, sum(n) AS n, sum(n * g) AS g FROM counts JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row) x USING (row)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * eligible // 100 THEN place END AS rank FROM placed""".replace("{words}", rf"coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}'), [])")
