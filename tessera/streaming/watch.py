"""Continuous indexing and log following on Structured Streaming."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.sources import notes_source
from tessera.sources.logs import SCHEMAS

# Seconds between passes.
INTERVAL, LEAST_INTERVAL = 30, 5


def watch(spark: SparkSession, one_pass: Callable[[], object], interval: float = INTERVAL, checkpoint: str | None = None) -> StreamingQuery:
    """Run an incremental pass at every trigger.

    A file stream never tells of deletions, so each beat of a rate source makes a full
    listing and a diff.  A pass that fails is logged and the next one tries again.
    """

    def beat(_: DataFrame, n: int) -> None:
        try:
            one_pass()
        except Exception:
            logging.getLogger(__name__).exception("pass %d failed", n)

    beats = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = beats.writeStream.foreachBatch(beat).trigger(processingTime=f"{max(interval, LEAST_INTERVAL)} seconds")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def follow(spark: SparkSession, path: str, kind: str = "queries") -> DataFrame:
    """A JSONL log folder as a stream of rows; lines that don't parse are dropped."""
    return spark.readStream.schema(SCHEMAS[kind]).option("mode", "DROPMALFORMED").json(path)


def windowed(rows: DataFrame, late: str = "10 minutes", every: str = "1 day") -> DataFrame:
    """Searches, hits and misses by window of event time; rows later than `late` are dropped."""
    timed = rows.withColumn("at", F.try_to_timestamp("ts", F.lit("yyyy-MM-dd HH:mm:ss"))).withWatermark("at", late)
    return timed.groupBy(F.window("at", every).alias("w")).agg(F.count("*").alias("n"), F.sum(F.coalesce("hits", F.lit(0))).alias("hits"), F.count_if(F.coalesce("hits", F.lit(0)) == 0).alias("misses"))


def changes(spark: SparkSession, path: str, state: str) -> DataFrame:
    """A folder's files as a stream of (path, change, mtime, length): added, changed or removed
    since the batch before, also across restarts; state: a folder for its listings."""
    notes_source.register(spark)
    return spark.readStream.format("notes").option("state", state).load(path)


class _Ring(StatefulProcessor):
    """The last n rows of a key, as state; each batch gives the ring of every key that it touches."""

    def __init__(self, schema: str, order: str, n: int) -> None:
        self.schema, self.order, self.n = schema, order, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        names = None
        found = list(self.kept.get())
        for part in rows:
            names = [c for c in part.columns if c != "_ring"]
            found += list(part[names].itertuples(index=False, name=None))
            found.sort(key=lambda r: r[names.index(self.order)], reverse=True)
            del found[self.n :]  # a batch of any size passes in parts
        self.kept.put(found)
        out = pd.DataFrame(found, columns=names)
        out.insert(0, "_ring", key[0])
        yield out

    def close(self) -> None:
        pass


def keep_last(rows: DataFrame, table: str, n: int, checkpoint: str, order: str = "ts", rings: int = 8) -> StreamingQuery:
    """Keep the last n rows of a stream (by a column that is never null) under a path, across restarts.

    Rows are dealt to rings by a hash, so no task has them all; each ring's last n are its
    state, which Spark versions by batch.  A batch that is tried again starts from the state
    before it, and replaces the rings it touches: nothing counts twice.
    """
    from tessera.sources.sinks import SnapshotTable

    spark, schema = rows.sparkSession, rows.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    dealt = rows.withColumn("_ring", F.pmod(F.xxhash64(*rows.columns), F.lit(rings)).cast("int"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    last = dealt.groupBy("_ring").transformWithStateInPandas(_Ring(ddl, order, n), f"_ring int, {ddl}", "Update", "None")

    def put(batch: DataFrame, _: int) -> None:
        kept = SnapshotTable(batch.sparkSession, table)
        old = kept.read()
        fresh = batch.persist()
        try:
            merged = fresh if old is None else old.join(fresh.select("_ring").distinct(), "_ring", "left_anti").unionByName(fresh)
            kept.replace(merged)
            kept.drop_old()
        finally:
            fresh.unpersist()

    return last.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_of(spark: SparkSession, table: str, n: int, order: str = "ts") -> DataFrame:
    """The last n rows that keep_last() has kept."""
    from tessera.sources.sinks import SnapshotTable

    return SnapshotTable(spark, table).read().drop("_ring").orderBy(F.desc(order)).limit(n)
