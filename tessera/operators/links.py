"""The link graph of notes: outbound map, backlinks, resolution of targets, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def link_map(chunks: DataFrame) -> DataFrame:
    """(source, links) by the first chunk of each source; sources without links are left out."""
    first = chunks.groupBy("source").agg(F.min_by("links", "chunk").alias("links"))
    return first.where("links <> ''")


def exploded(mapped: DataFrame) -> DataFrame:
    """(source, target) of a link map."""
    out = mapped.select("source", F.explode(F.split("links", ",")).alias("target"))
    return out.select("source", T.strip(F.col("target")).alias("target")).where("target <> ''")


def note_stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), r"(?<=.)\.[^.]*$", ""))


def backlinks(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(note, source): which notes link to a note by its exact stem; a note's own links do not count."""
    named = notes.select(F.col("source").alias("note"), note_stem(F.col("source")).alias("stem"))
    hit = links.select("source", F.lower("target").alias("stem")).join(named, "stem")
    return hit.where(F.col("source") != F.col("note")).select("note", "source").distinct()


def backlink_counts(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(note, n): links from other notes whose target's last part is the note's stem."""
    named = notes.select(F.col("source").alias("note"), note_stem(F.col("source")).alias("stem"))
    last = F.regexp_replace(F.lower(F.substring_index("target", "/", -1)), r"\.md$", "")
    return links.select("source", last.alias("stem")).join(named, "stem").where(F.col("source") != F.col("note")).groupBy("note").agg(F.count("*").alias("n"))


def notes_matching(notes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Notes whose stem contains a name; if there is none, notes with such a link target."""
    by_stem = notes.where(F.contains(note_stem(F.col("source")), F.lit(name.lower()))).select("source")
    by_link = links.where(F.contains(F.lower("target"), F.lit(name.lower()))).select("source").distinct()
    return by_stem if not by_stem.isEmpty() else by_link


def resolved(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(source, target, note, ghost): a target is an exact path, or a path suffix that only
    one note has; otherwise it stays a ghost.  Links of a note to itself are left out.

    Every suffix of a path is a key, so the join is an equi-join.
    """
    parts = F.filter(F.split(F.regexp_replace(T.folded_path(F.col("source")), r"\.md$", ""), "/"), lambda x: x != "")
    keys = notes.select(F.col("source").alias("note"), parts.alias("p")).select("note", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))).alias("key"))
    unique = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("note").alias("by_suffix")).where("n = 1").select("key", "by_suffix")
    exact = notes.select(F.col("source").alias("target"), F.col("source").alias("by_path"))
    key = F.regexp_replace(F.regexp_replace(T.folded_path(F.col("target")), r"\.md$", ""), "^/+", "")
    both = links.join(exact, "target", "left").withColumn("key", key).join(unique, "key", "left")
    both = both.withColumn("note", F.coalesce("by_path", "by_suffix"))
    return both.where(F.col("note").isNull() | (F.col("note") != F.col("source"))).select("source", "target", "note", F.col("note").isNull().alias("ghost"))


def labels(notes: DataFrame) -> DataFrame:
    """(source, label): the base name, with the parent folder before it where the name is not unique."""
    parts = F.filter(F.split(F.regexp_replace(F.replace("source", F.lit("\\"), F.lit("/")), r"(?i)\.md$", ""), "/"), lambda x: x != "")
    named = notes.select("source", F.element_at(parts, -1).alias("base"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("parent"))
    many = named.groupBy("base").agg((F.count("*") > 1).alias("many"))
    both = named.join(many, "base")
    return both.select("source", F.when(F.col("many") & F.col("parent").isNotNull(), F.concat_ws("/", "parent", "base")).otherwise(F.col("base")).alias("label"))
