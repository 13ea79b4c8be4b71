"""Decision histories: which note supersedes which, whole chains, and what is current."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.scratch import durable

# Front-matter keys by direction.
FORWARD = ("supersedes", "superseded", "replaces")
BACKWARD = ("superseded_by", "superseded-by", "replaced_by")


def collect(notes: DataFrame) -> DataFrame:
    """stem, path, supersedes, superseded_by, effective of notes (ord, stem, path and the
    same three, empty if unset).

    Of notes with one stem the last path and the last non-empty pointers count, but the
    first non-empty date.  A pointer forward implies the one back; a target that is no
    note gets a row of its own.
    """
    some = notes.where("supersedes <> '' OR superseded_by <> '' OR effective <> ''")
    last = lambda c: F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("ord")))
    t = some.groupBy("stem").agg(
        F.max_by("path", "ord").alias("path"),
        F.coalesce(last("supersedes"), F.lit("")).alias("supersedes"),
        F.coalesce(last("superseded_by"), F.lit("")).alias("superseded_by"),
        F.coalesce(F.min_by(F.when(F.col("effective") != "", F.col("effective")), F.when(F.col("effective") != "", F.col("ord"))), F.lit("")).alias("effective"),
        F.min("ord").alias("ord"),
    )
    implied = t.where("supersedes <> ''").groupBy(F.col("supersedes").alias("stem")).agg(F.min_by("stem", "ord").alias("implied"))
    full = t.join(implied, "stem", "full_outer")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return full.select("stem", empty("path").alias("path"), empty("supersedes").alias("supersedes"), F.coalesce(F.nullif("superseded_by", F.lit("")), "implied", F.lit("")).alias("superseded_by"), empty("effective").alias("effective"))


def _walk(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, pos, stem): where each start gets along steps (stem, next), from itself at 0 until
    there is no next or a stem comes again.

    Steps are doubled: after the k-th round a jump is 2 ** k steps, and the lines are twice as
    long.  So a line of n needs log2(n) rounds, each of them a written table; without a jump left
    the lines are whole, and no further round looks whether they grow.
    """
    lines = starts.select(F.col("stem").alias("start"), "stem", F.lit(0).alias("pos")).distinct()
    jumps, size, known = steps, 1, None
    while True:
        seen = Observation()
        lines = durable(lines.observe(seen, F.count(F.lit(1)).alias("n")), "lines")
        if seen.get["n"] == known:
            return lines
        known = seen.get["n"]
        further = lines.join(jumps, "stem").select("start", F.col("next").alias("stem"), (F.col("pos") + size).alias("pos"))
        lines = lines.unionByName(further).groupBy("start", "stem").agg(F.min("pos").alias("pos"))
        left = Observation()
        twice = jumps.join(jumps.select(F.col("stem").alias("next"), F.col("next").alias("_n")), "next").select("stem", F.col("_n").alias("next"))
        jumps = durable(twice.observe(left, F.count(F.lit(1)).alias("n")), "jumps")
        if not left.get["n"]:
            return durable(lines, "lines")
        size *= 2


def chains(table: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(start, pos, stem, effective): the whole line of each start (default: every note),
    oldest first from 0.

    Back along supersedes to the first decision, then along superseded_by to the
    last; a cycle stops at the repeat.
    """
    t = durable(table.select("stem", "supersedes", "superseded_by", "effective"), "supersession")
    there = t.select(F.col("stem").alias("next"))
    steps = lambda c: durable(t.where(F.col(c) != "").select("stem", F.col(c).alias("next")).join(there, "next").select("stem", "next"), "steps")
    known = starts.select("stem").join(t, "stem", "left_semi") if starts is not None else t.select("stem")
    back = _walk(steps("supersedes"), known)
    roots = durable(back.groupBy("start").agg(F.max_by("stem", "pos").alias("root")), "roots")
    lines = _walk(steps("superseded_by"), roots.select(F.col("root").alias("stem"))).withColumnRenamed("start", "root")
    return roots.join(lines, "root").join(t.select("stem", "effective"), "stem").select("start", F.col("pos").cast("long").alias("pos"), "stem", "effective")


def current(chained: DataFrame) -> DataFrame:
    """(start, current, length): the last of each line."""
    return chained.groupBy("start").agg(F.max_by("stem", "pos").alias("current"), F.count("*").alias("length"))


def describe(chained: DataFrame) -> DataFrame:
    """(start, history): a line of text for each decision."""
    last = F.max("pos").over(W.partitionBy("start"))
    when = F.when(F.col("effective") != "", F.concat(F.lit(" (effective "), F.col("effective"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("  "), (F.col("pos") + 1).cast("string"), F.lit(". "), F.col("stem"), when, F.when(F.col("pos") < last, "  → superseded by").otherwise(""))
    rows = chained.withColumn("line", line).groupBy("start").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    return rows.select("start", F.concat(F.lit("decision history, oldest first:\n"), F.array_join(F.transform("ls", lambda x: x.line), "\n")).alias("history"))


def annotate(hits: DataFrame, table: DataFrame) -> DataFrame:
    """hits (source) with superseded_by and effective, null where the note is current."""
    from tessera.functions.text import stem

    old = table.where("superseded_by <> ''").select(F.col("stem").alias("_stem"), "superseded_by", F.nullif("effective", F.lit("")).alias("effective"))
    return hits.join(old, stem(F.col("source")) == F.col("_stem"), "left").drop("_stem")
