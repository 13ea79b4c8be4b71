"""Incremental maintenance of an index: what changed, what can be reused, what goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(docs: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """docs (path, hash) with status added, updated or unchanged against indexed (path, hash)."""
    old = indexed.select("path", F.col("hash").alias("_old")).distinct()
    same = F.lit(False) if force else F.col("_old") == F.col("hash")
    return docs.join(old, "path", "left").withColumn("status", F.when(F.col("_old").isNull(), "added").when(same, "unchanged").otherwise("updated")).drop("_old")


def report(classified: DataFrame) -> DataFrame:
    return classified.groupBy("status").agg(F.count("*").alias("n"))


def vanished(index: DataFrame, docs: DataFrame) -> DataFrame:
    """Sources of the index that no longer are documents."""
    return index.select("source").distinct().join(docs.select(F.col("path").alias("source")), "source", "left_anti")


def prune(index: DataFrame, docs: DataFrame) -> DataFrame:
    return index.join(docs.select(F.col("path").alias("source")), "source", "left_semi")


def delete_source(index: DataFrame, source: str) -> DataFrame:
    return index.where(F.col("source") != source)


def reuse(new: DataFrame, old: DataFrame) -> DataFrame:
    """new chunks (source, chash, …) with the vector that an equal chunk of the same source had, else null."""
    known = old.where("vec IS NOT NULL").groupBy("source", "chash").agg(F.min_by("vec", "chunk").alias("vec"))
    return new.join(known, ["source", "chash"], "left")


def upsert(index: DataFrame, fresh: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The index with all rows of the fresh chunks' sources (or of `sources`, which may
    have come to nothing) replaced."""
    touched = (sources if sources is not None else fresh).select("source").distinct()
    return index.join(touched, "source", "left_anti").unionByName(fresh)


def check_vector_space(meta: DataFrame, model: str, dim: int, rows: int, real_dim: int | None = None, rebuild: bool = False) -> str:
    """stamp, ok or rebuild; raises if the index has another vector space.

    meta: one row (embed_model, embed_dim) or none; an unmarked index is judged by
    the vectors that it has.
    """
    known = meta.first()
    if rows == 0:
        return "stamp"
    fits = (known.embed_model == model and known.embed_dim == dim) if known else real_dim in (None, dim)
    if fits:
        return "ok" if known else "stamp"
    if rebuild:
        return "rebuild"
    raise ValueError(f"the index was made with {known.embed_model if known else 'an unknown model'} ({known.embed_dim if known else real_dim} dimensions), not {model} ({dim}): rebuild it")


def per_source(index: DataFrame) -> DataFrame:
    return index.groupBy("source").agg(F.count("*").alias("chunks"))


def summary(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("files"))


def matched(counts: DataFrame, prefixes: DataFrame, slash: bool = False) -> DataFrame:
    """(prefix, source, chunks) of sources that begin with a prefix (slash: are it or lie under it).

    Each folder of a path (without slash: each beginning as long as some prefix) is a key, so
    even many prefixes are an equi-join.
    """
    if slash:
        parts = F.split("source", "/")
        starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    else:
        lengths = sorted(r.n for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect())
        known = F.array(*map(F.lit, lengths)).cast("array<int>") if lengths else F.expr("CAST(array() AS array<int>)")
        starts = F.transform(F.filter(known, lambda n: n <= F.length("source")), lambda n: F.substring(F.col("source"), F.lit(1), n))
    return counts.select("source", "chunks", F.explode(starts).alias("prefix")).join(prefixes.select("prefix").distinct(), "prefix").select("prefix", "source", "chunks")


def under(counts: DataFrame, prefixes: DataFrame, slash: bool = True) -> DataFrame:
    """(prefix, chunks): chunks of sources that are a prefix or lie under it (slash=False: just begin with it)."""
    found = matched(counts, prefixes, slash).groupBy("prefix").agg(F.sum("chunks").alias("chunks"))
    return prefixes.join(found, "prefix", "left").select("prefix", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def export_rows(index: DataFrame, digits: int = 6) -> DataFrame:
    """(source, chunk, line): each row as JSON with its vector rounded."""
    vec = F.transform("vec", lambda x: F.round(x.cast("double"), digits))
    body = F.struct("id", "source", "chunk", "section", "text", "tags", "links", "mtime", "hash", "chash", vec.alias("vec"))
    return index.select("source", "chunk", F.to_json(body).alias("line"))
