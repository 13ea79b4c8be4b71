"""Entity-relation graph: triples from model replies, entities, neighbourhoods, incremental builds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import chunking

# What of a file is read for triples, and sources named for an entity.
CHUNKS_READ, CHUNK_SIZE, TEXT_READ, SOURCES_SHOWN, HUBS = 2, 2000, 3000, 5, 10


def triples_of(reply: Column) -> Column:
    """array<struct<s,p,o>> of a model's reply: the outermost [...] in it, of which lists
    of three non-empty strings count."""
    inner = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    rows = F.from_json(inner, "array<array<string>>")
    good = F.filter(rows, lambda t: (F.size(t) == 3) & F.forall(t, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    return F.coalesce(F.transform(good, lambda t: F.struct(F.trim(t[0]).alias("s"), F.trim(t[1]).alias("p"), F.trim(t[2]).alias("o"))), F.expr("CAST(array() AS array<struct<s:string,p:string,o:string>>)"))


def parts(notes: DataFrame) -> DataFrame:
    """(source, chunk, text) of notes (source, content), cut for reading: longer pieces than search has, no overlap."""
    cut = chunking.chunks(notes.select("source", F.col("source").alias("path"), "content"), CHUNK_SIZE, 0)
    return cut.select("source", "chunk", "text")


def extract(chunks: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """(s, p, o, source) of the first chunks of each source; model maps a text to a reply."""
    first = chunks.where(F.col("chunk") < CHUNKS_READ)
    return first.select("source", F.explode(triples_of(model(F.substring("text", 1, TEXT_READ)))).alias("t")).select("t.s", "t.p", "t.o", "source")


def rebuild(edges: DataFrame, processed: DataFrame, files: DataFrame, fresh: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(edges, processed) after a pass over files (source, hash): vanished and changed
    files lose their edges, changed and new ones get those that fresh() finds."""
    changed = files.join(processed.withColumnRenamed("hash", "old"), "source", "left").where("old IS NULL OR old <> hash").drop("old")
    kept = edges.join(files, "source", "left_semi").join(changed, "source", "left_anti")
    return kept.unionByName(fresh(changed)), files.select("source", "hash")


def entities(edges: DataFrame) -> DataFrame:
    """(name, degree, sources): each edge counts for both its ends; five sources are named.

    Only the first sources of a name are gathered, so an entity of most edges costs no more.
    """
    by_source = edges.select(F.explode(F.array("s", "o")).alias("name"), "source").groupBy("name", "source").agg(F.count("*").alias("n"))
    degree = by_source.groupBy("name").agg(F.sum("n").alias("degree"))
    nth = F.row_number().over(W.partitionBy("name").orderBy("source"))
    named = by_source.select("name", "source").withColumn("nth", nth).where(F.col("nth") <= SOURCES_SHOWN).groupBy("name").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    return degree.join(named, "name").select("name", "degree", "sources")


def neighbours(edges: DataFrame, entity: str) -> DataFrame:
    """The edges that touch an entity (in any case), with direction out or in."""
    q = entity.strip().lower()
    out = edges.where(F.lower("s") == q).withColumn("direction", F.lit("out"))
    return out.unionByName(edges.where(F.lower("o") == q).withColumn("direction", F.lit("in")))


def hubs(found: DataFrame, n: int = HUBS) -> DataFrame:
    return found.orderBy(F.desc("degree"), "name").limit(n).select("name", "degree")
