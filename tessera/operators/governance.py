"""Lifecycle findings over notes: replaced but live, dangling, two truths, stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T

# Fixed values.
STALE_DAYS, SHOWN = 180, 20


#: Characters of a note that hold its front matter here.
READ = 4000


def meta_of(text: Column) -> Column:
    """Flat front matter, keys in lower case, of the first READ characters; the last of a key
    counts, and lines that begin with # are comments."""
    head = F.substring(text, 1, READ)
    block = F.when(head.startswith("---"), F.regexp_extract(head, r"(?s)\A---(.*?)\n---", 1))
    rows = F.filter(T.lines(F.coalesce(block, F.lit(""))), lambda x: x.contains(":") & ~F.ltrim(x).startswith("#"))
    pairs = F.transform(rows, lambda x: F.struct(F.lower(T.strip(F.substring_index(x, ":", 1))).alias("k"), F.regexp_replace(T.strip(F.regexp_replace(x, r"\A[^:]*:", "")), "^[\"']+|[\"']+$", "").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def title_of(path: Column, text: Column) -> Column:
    """In lower case: the front matter's title, else the first line that is not blank if it is a
    heading, else the file's name."""
    first = F.regexp_extract(text, r"\A\s*# ([^\r\n]*)", 1)
    stem = T.stem(F.substring_index(path, "/", -1), "md|markdown")
    return F.lower(T.strip(F.coalesce(F.nullif(F.try_element_at(meta_of(text), F.lit("title")), F.lit("")), F.nullif(first, F.lit("")), stem)))


def notes_of(raw: DataFrame) -> DataFrame:
    """file, source, stem, title, hash, mtime, supersedes, superseded_by of notes (path, text, mtime)."""
    meta = meta_of(F.col("text"))
    first = lambda keys: F.coalesce(*[F.nullif(T.stem(F.try_element_at("m", F.lit(k)), "md|markdown"), F.lit("")) for k in keys], F.lit(""))
    rows = raw.select("path", "mtime", meta.alias("m"), title_of(F.col("path"), F.col("text")).alias("title"), T.file_hash(F.col("text")).alias("hash"))
    return rows.select(
        F.substring_index("path", "/", -1).alias("file"),
        F.col("path").alias("source"),
        T.stem(F.substring_index("path", "/", -1), "md|markdown").alias("stem"),
        "title",
        "hash",
        "mtime",
        first(("supersedes", "supersedes_note")).alias("supersedes"),
        first(("superseded_by", "superseded-by", "replaced_by")).alias("superseded_by"),
    )


def superseded_live(notes: DataFrame) -> DataFrame:
    """(file, superseded_by, target_exists) of notes (file, stem, superseded_by) that say they were replaced."""
    known = notes.select(F.col("stem").alias("superseded_by"), F.lit(True).alias("_known")).distinct()
    live = notes.where("superseded_by <> ''").select("file", "superseded_by")
    return live.join(known, "superseded_by", "left").select("file", "superseded_by", F.coalesce("_known", F.lit(False)).alias("target_exists"))


def dangling(notes: DataFrame) -> DataFrame:
    """(file, references): supersedes points at no note."""
    refs = notes.where("supersedes <> ''").select("file", F.col("supersedes").alias("references"))
    return refs.join(notes.select(F.col("stem").alias("references")).distinct(), "references", "left_anti").select("file", "references")


def duplicate_truth(notes: DataFrame) -> DataFrame:
    """(title, files): more than one note and more than one content under one title."""
    g = notes.groupBy("title").agg(F.count("*").alias("n"), F.count_distinct("hash").alias("contents"), F.sort_array(F.collect_list("file")).alias("files"))
    return g.where("n > 1 AND contents > 1").select("title", "files")


def stale(notes: DataFrame, cited: DataFrame, now: float, days: int = STALE_DAYS) -> DataFrame:
    """(file, age_days): older than `days` and never cited."""
    age = (F.lit(now) - F.col("mtime")) / 86400
    return notes.join(cited.where("count > 0").select("source"), "source", "left_anti").where(age > days).select("file", F.round(age, 1).alias("age_days"))


def scan(notes: DataFrame, cited: DataFrame, now: float, days: int = STALE_DAYS) -> DataFrame:
    """(category, file, detail): all findings of one pass."""
    row = lambda df, name, file, detail: df.select(F.lit(name).alias("category"), file.alias("file"), detail.alias("detail"))
    return (
        row(superseded_live(notes), "superseded_live", F.col("file"), F.col("superseded_by"))
        .unionByName(row(duplicate_truth(notes), "duplicate_truth", F.array_join("files", ", "), F.col("title")))
        .unionByName(row(dangling(notes), "dangling", F.col("file"), F.col("references")))
        .unionByName(row(stale(notes, cited, now, days), "stale", F.col("file"), F.col("age_days").cast("string")))
    )


def report(findings: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first rows of each category with its size; counts and first rows are found apart, so no
    category is gathered in one place."""
    n = findings.groupBy("category").agg(F.count("*").alias("n"))
    nth = F.row_number().over(W.partitionBy("category").orderBy("file", "detail"))
    return findings.withColumn("nth", nth).where(F.col("nth") <= shown).join(n, "category").select(*findings.columns, "n", "nth")
