"""Removal of passages that occurred before, by overlapping windows of three lines.

Every three consecutive lines of a document (blank ones do not count) are hashed;
of each window that occurs again anywhere, the occurrence with the lowest
(doc_id, line) stays, and the lines that later ones cover are removed together.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import apart, durable, table

_BLANK = " \t\n\x0b\x0c\r"
LINES = 3


def windows(docs: DataFrame, lines: int = LINES, long_words: int | None = None) -> DataFrame:
    """(doc_id, th, at, hi, lo, covers): the window's 128-bit hash, its first line and all line numbers it covers.

    long_words: if given, a line of more words than that is a window by itself too.
    """
    line = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(_BLANK)).alias("t")),
    )
    row = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.filter(line, lambda x: x.t != "").alias("l"))
    sets = [f"l[k + {j}].t" for j in range(lines)]
    found = F.expr(
        f"CASE WHEN size(l) >= {lines} THEN transform(sequence(0, size(l) - {lines}), k -> named_struct("
        f"'h', named_struct('hi', xxhash64({', '.join(sets)}), 'lo', xxhash64({lines}, {', '.join(sets[::-1])})), 'covers', array({', '.join(f'l[k + {j}].i' for j in range(lines))}))) "
        "ELSE array() END"
    )
    if long_words is not None:
        long = F.filter("l", lambda x: (F.length(x.t) > 2 * long_words) & (F.size(F.split(x.t, r"[\x20\x09-\x0D]+")) > long_words))
        found = F.concat(found, F.transform(long, lambda x: F.struct(F.struct(F.xxhash64(x.t).alias("hi"), F.xxhash64(F.lit(1), x.t).alias("lo")).alias("h"), F.array(x.i).alias("covers"))))
    out = row.select("doc_id", "th", F.explode(found).alias("w"))
    return out.select("doc_id", "th", F.col("w.covers")[0].alias("at"), F.col("w.h.hi").alias("hi"), F.col("w.h.lo").alias("lo"), F.col("w.covers").alias("covers"))


def repeats(docs: DataFrame, lines: int = LINES, long_words: int | None = None) -> DataFrame:
    """(doc_id, th, gone): the sorted line numbers to remove from each document that has some.

    The windows are made once and written; then the first place of each hash is
    aggregated, and joined back.
    """
    found = durable(windows(docs, lines, long_words), "windows")
    place = F.struct("doc_id", "th", "at")
    first = found.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("hi", "lo", "first")
    later = found.join(first, ["hi", "lo"]).where(place != F.col("first"))
    return later.select("doc_id", "th", F.explode("covers").alias("i")).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("i")).alias("gone"))


def dedup_lines(docs: DataFrame, lines: int = LINES, long_words: int | None = None) -> DataFrame:
    """docs with the repeated lines taken out of text; n_chars, if there, is counted anew.

    Every row stays, perhaps with an empty text.  Lines are compared without the
    blanks around them; kept lines are unchanged.  A null text stays null; texts of
    fewer than three lines lose nothing, however long (but for long_words, see windows()).
    A null doc_id comes before all others.  Rows with the same doc_id (or none) and text
    are one document, and lose nothing to each other.  Whole texts are read, a row at a
    time.  No rows give no rows.  A column n_removed of docs gives way, and so do
    columns that differ from another in case only.  Skew: the firsts are pre-aggregated
    before their shuffle, and the join back is an inner join that adaptive execution can
    split.
    """
    docs, rest = apart(docs, ("doc_id", "text"), ("n_removed",), whole=True)
    gone = repeats(docs, lines, long_words).select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), F.col("gone").alias("_gone"))
    both = docs.select("_row", F.xxhash64("text").alias("_th")).join(gone, F.col("_row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h")), "left")
    both = both.select("_row", "_gone", F.when(F.col("_gone").isNotNull(), F.split("_row.text", "\n", -1)).alias("_lines"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _gone), i -> _lines[i]), '\n')")
    both = both.select("_row", "_gone", F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(kept).alias("_text"))
    new = {"text": F.col("_text")}
    for c in rest:
        if c.lower() == "n_chars":
            new[c] = F.when(F.col("_gone").isNull(), F.col(f"_row.`{c}`")).otherwise(F.length("_text")).cast(docs.schema["_row"].dataType[c].dataType)
    return both.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in rest], F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated passages, n_removed lines, for every document."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_OP3 = r"""
WITH l AS (
  SELECT doc_id, text, i, trim(line, E' \t\n\x0b\x0c\r') AS t
  FROM (SELECT doc_id, text, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) - 1 AS i FROM documents)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE t <> ''
), w AS (
  SELECT a.doc_id, a.i AS pos, [a.i, b.i, c.i] AS covers, [a.t, b.t, c.t] AS h
  FROM n a JOIN n b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN n c ON c.doc_id = a.doc_id AND c.k = a.k + 2
), f AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS nth FROM w
), gone AS (
  SELECT DISTINCT doc_id, unnest(covers) AS i FROM f WHERE nth > 1
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(g.n, 0)::BIGINT AS n_removed
FROM documents d
LEFT JOIN (SELECT l.doc_id, string_agg(l.line, E'\n' ORDER BY l.i) AS text
           FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) - 1 AS i FROM documents) l
           ANTI JOIN gone USING (doc_id, i) GROUP BY l.doc_id) k ON k.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
"""
