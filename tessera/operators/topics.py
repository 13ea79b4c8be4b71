"""Topics worth a page of their own, digests within a budget, and folder fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T

# Fixed values.
LEAST_CHUNKS, TOP, PER_FILE, TOTAL = 4, 8, 700, 14_000


def suggested(chunks: DataFrame, pages: DataFrame, least: int = LEAST_CHUNKS, top: int = TOP) -> DataFrame:
    """(term, chunks): terms of at least `least` chunks (text) without a page (slug); ties by term."""
    words = chunks.select(F.explode(F.array_distinct(T.every(F.lower("text"), T.TOPIC_TERM))).alias("term"))
    counts = words.where("NOT term RLIKE '^[0-9]+$'").groupBy("term").agg(F.count("*").alias("chunks")).where(F.col("chunks") >= least)
    return counts.join(pages.select(F.col("slug").alias("term")), "term", "left_anti").orderBy(F.desc("chunks"), "term").limit(top)


def digest(files: DataFrame, per_file: int = PER_FILE, total: int = TOTAL) -> DataFrame:
    """(owner, name, part): the newest files of each owner, each with a share of the budget."""
    part = F.concat(F.lit("### "), F.col("name"), F.lit("\n"), F.substring(T.strip(F.col("text")), 1, per_file), F.lit("\n\n"))
    by = W.partitionBy("owner").orderBy(F.desc("mtime"), "path")
    spent = F.sum(F.length("part")).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.length("part")
    cut = files.withColumn("part", part).withColumn("nth", F.row_number().over(by)).withColumn("spent", spent)
    return cut.where(F.col("spent") < total).select("owner", "nth", "name", F.expr(f"substring(part, 1, CAST({total} - spent AS INT))").alias("part"))


def fingerprints(files: DataFrame) -> DataFrame:
    """(owner, fingerprint) of files (owner, path, name, content): changes with any name or content, not with order."""
    line = F.struct("path", F.concat_ws(":", "name", F.sha1(F.col("content").cast("binary"))).alias("line"))
    g = files.groupBy("owner").agg(F.sort_array(F.collect_list(line)).alias("ls"))
    return g.select("owner", F.substring(F.sha1(F.array_join(F.transform("ls", lambda x: x.line), "\n").cast("binary")), 1, 16).alias("fingerprint"))


def freshness(now: DataFrame, stored: DataFrame) -> DataFrame:
    """(owner, status): fresh, stale or missing digests."""
    both = now.join(stored.select("owner", F.col("fingerprint").alias("_old")), "owner", "left")
    return both.select("owner", F.when(F.col("_old") == F.col("fingerprint"), "fresh").when(F.col("_old").isNotNull(), "stale").otherwise("missing").alias("status"))
