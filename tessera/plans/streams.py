"""Streaming forms, run to the end of what is there."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from tessera.plans.catalog import query, table
from tessera.scratch import scratch_path
from tessera.sources import notes_source
from tessera.sources.sinks import drop_path
from tessera.streaming import watch


def scratch(spark) -> str:
    return scratch_path(spark, "streams")


def log_stream(spark, d):
    """The events as a JSONL query log, followed as a stream."""
    path = scratch(spark)
    e = table(spark, d, "events")
    e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("query"), F.get_json_object("props", "$.k").cast("int").alias("hits"), F.col("value").alias("ms")).write.json(path)
    return watch.follow(spark, path)


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, sum((props::JSON ->> 'k')::INT)::BIGINT AS hits, count_if((props::JSON ->> 'k')::INT = 0)::BIGINT AS misses FROM events GROUP BY 1""")
def stream_query_log(spark, d):
    """Daily windows of event time; the result is one row for each day."""
    name = f"s{uuid.uuid4().hex}"
    q = watch.windowed(log_stream(spark, d), late="60 days").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "hits", "misses")


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type AS query, value AS ms FROM events ORDER BY ts DESC, value LIMIT 200")
def stream_last_200(spark, d):
    """A ring of the last 200 rows of a stream."""
    ring = scratch(spark)
    rows = log_stream(spark, d).withColumn("at", F.concat_ws("|", "ts", F.format_string("%012.3f", 1e6 - F.col("ms"))))
    watch.keep_last(rows, ring, 200, scratch(spark), order="at").awaitTermination()
    return watch.last_of(spark, ring, 200, order="at").select("ts", "query", "ms")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'changed' ELSE 'kept' END AS state FROM documents WHERE doc_id % 5 <> 0")
def stream_watch_batch(spark, d):
    """Two passes of the watch plan over a table of documents that changes between them."""
    from tessera.operators import incremental
    from tessera.sources.sinks import SnapshotTable

    index = SnapshotTable(spark, scratch(spark))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id")
    states = [docs.withColumn("hash", F.lit("1")), docs.where("doc_id % 5 <> 0").withColumn("hash", F.when(F.col("doc_id") % 4 == 0, "2").otherwise("1"))]

    def one_pass(now) -> None:
        old = index.read()
        seen = incremental.classify(now, old.select(F.col("source").alias("path"), "hash") if old is not None else now.limit(0))
        fresh = seen.where("status <> 'unchanged'").select(F.col("path").alias("source"), "doc_id", "hash", F.when(F.col("status") == "added", "kept").otherwise("changed").alias("state"))
        index.replace(fresh if old is None else incremental.upsert(incremental.prune(old, now), fresh))

    done = iter(states)

    def beat() -> None:
        if (now := next(done, None)) is not None:
            one_pass(now)
            passed.append(1)

    passed: list[int] = []
    q = watch.watch(spark, beat, watch.LEAST_INTERVAL, scratch(spark))
    deadline = time.time() + 600
    while q.isActive and len(passed) < len(states) and time.time() < deadline:
        time.sleep(0.2)
    q.stop()
    if len(passed) < len(states):
        raise TimeoutError(f"{len(passed)} of {len(states)} passes of the watch came to an end")
    return index.read().select("doc_id", "state")


def as_files(docs, path: str) -> None:
    """A folder for each source, with one file of its texts, a line each."""
    lines = docs.select("doc_id", "source", F.regexp_replace("text", "[\r\n]", " ").alias("line")).where("text IS NOT NULL AND source IS NOT NULL")
    lines.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "line").write.mode("append").partitionBy("source").text(path)


def source_of(path):
    return F.regexp_extract(path, "source=([^/]*)/", 1)


@query("""SELECT source, count(*) AS n_texts, sum(length(text))::BIGINT AS n_chars, md5(string_agg(regexp_replace(text, '[\r\n]', ' ', 'g') || chr(10), '' ORDER BY doc_id)) AS digest FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source""")
def notes_source_read(spark, d):
    """The documents as files, read by the data source of notes; the filter on suffixes reaches its listing."""
    root = scratch(spark)
    as_files(table(spark, d, "documents"), root)
    notes_source.register(spark)
    files = spark.read.format("notes").load(root).where("suffix = '.txt'")
    text = F.col("content").cast("string")
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return files.select(source_of(F.col("path")).alias("source"), n.alias("n_texts"), (F.length(text) - n).alias("n_chars"), F.md5("content").alias("digest"))


@query("""WITH s AS (SELECT DISTINCT source FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)
SELECT 0::BIGINT AS run, source, 'added' AS change FROM s UNION ALL SELECT 1, min(source), 'removed' FROM s UNION ALL SELECT 1, 'copy-' || max(source), 'added' FROM s""")
def stream_changes(spark, d):
    """The files of all sources as a feed of changes; between two runs of it one source goes and one comes."""
    root, state, checkpoint, out = (scratch(spark) for _ in range(4))
    docs = table(spark, d, "documents")
    as_files(docs, root)
    ends = docs.where("text IS NOT NULL").agg(F.min("source").alias("low"), F.max("source").alias("high")).first()

    def run(n: int) -> None:
        def put(batch, _: int) -> None:
            batch.where("path LIKE '%.txt'").select(F.lit(n).cast("long").alias("run"), source_of(F.col("path")).alias("source"), "change").write.mode("append").parquet(out)

        q = watch.changes(spark, root, state).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(once=True).start()
        if not q.awaitTermination(600):
            q.stop()
            raise TimeoutError("the feed of changes came to no end")

    run(0)
    if ends.low is not None:
        drop_path(spark, f"{root}/source={ends.low}")
        as_files(docs.where(F.col("source") == ends.high).withColumn("source", F.concat(F.lit("copy-"), "source")), root)
    run(1)
    return spark.read.schema("run long, source string, change string").parquet(out).distinct()
