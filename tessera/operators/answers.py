"""What goes to a model and what comes back: contexts, previews, verification reports, model hooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Caps in characters, marks and sentences of the reports.
HIT_TEXT, PREVIEW, QUERY_CAP, QUESTION_CAP, EMBED_CAP, RERANK_LLM, RERANK_LOCAL, HISTORY = 500, 120, 2000, 8000, 4000, 300, 512, 8
MARKS = {"supported": "✓", "partial": "~", "unsupported": "✗"}


def where(source: Column, section: Column) -> Column:
    return F.concat(source, F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" > "), section)).otherwise(""))


def _listed(hits: DataFrame, block: Column, between: str, name: str) -> DataFrame:
    rows = hits.select("query_id", F.struct("rank", block.alias("b")).alias("r")).groupBy("query_id").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return rows.select("query_id", F.array_join(F.transform("rs", lambda x: x.b), between).alias(name))


def rendered(hits: DataFrame) -> DataFrame:
    """(query_id, result): numbered hits with their place and the beginning of their text."""
    return _listed(hits, F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), where(F.col("source"), F.col("section")), F.lit("\n"), F.substring("text", 1, HIT_TEXT)), "\n\n", "result")


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context): the excerpts of an answer's prompt; replaced notes are marked (superseded_by, effective)."""
    old = F.concat(F.lit("\n[SUPERSEDED by "), F.col("superseded_by"), F.when(F.coalesce("effective", F.lit("")) != "", F.concat(F.lit(" (effective "), F.col("effective"), F.lit(")"))).otherwise(""), F.lit(" — historical, not current practice]"))
    note = F.when(F.coalesce("superseded_by", F.lit("")) != "", old).otherwise("")
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" | section: "), F.col("section"))).otherwise("")
    block = F.concat(F.lit("[chunk "), F.col("rank").cast("string"), F.lit(" | source: "), F.col("source"), section, F.lit("]"), note, F.lit("\n"), F.col("text"))
    return _listed(hits, block, "\n\n---\n\n", "context")


def outside(hits: DataFrame, root: str) -> DataFrame:
    """Hits that do not lie in a folder (a generated page must not feed on generated pages)."""
    r = root.replace("\\", "/").lower().rstrip("/")
    path = F.lower(F.replace("source", F.lit("\\"), F.lit("/")))
    return hits.where(~((path == r) | F.startswith(path, F.lit(r + "/"))))


def verification(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, report) of claims (query_id, pos, claim, status, excerpts, cross_file, reason)."""
    sizes = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("source").alias("files"))
    both = claims.join(sizes, "query_id")
    refs = F.filter("excerpts", lambda i: (i > 0) & (i <= F.col("n")))
    listed = F.array_join(F.transform(refs, lambda i: i.cast("string")), ", ")
    place = F.when(F.size(refs) == 1, F.concat(F.lit(" [excerpt "), listed, F.lit("]"))).when(F.size(refs) > 1, F.concat(F.lit(" [excerpts "), listed, F.lit("]"))).otherwise("")
    mark = F.coalesce(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])[F.lower("status")], F.lit("?"))
    reason = F.when(F.trim("reason") != "", F.concat(F.lit(": "), F.trim("reason"))).otherwise("")
    cross = (
        F.when(F.lower("cross_file") == "unstated", F.concat(F.lit("  ⚠ cross-file inference not in the sources"), reason))
        .when((F.lower("cross_file") == "ok") & (F.size(refs) > 1), "  (cross-file join checked)")
        .otherwise("")
    )
    line = F.concat(F.lit("  "), mark, F.lit(" "), F.trim("claim"), place, cross)
    rows = both.select("query_id", "n", "files", F.struct("pos", line.alias("line")).alias("l")).groupBy("query_id", "n", "files").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    head = F.when(
        F.col("files") > 1,
        F.concat(F.lit("Claim-by-claim check across "), F.col("files").cast("string"), F.lit(" files ("), F.col("n").cast("string"), F.lit(" excerpts; ✓ supported, ~ partial, ✗ unsupported, ⚠ unlicensed cross-file join):")),
    ).otherwise("Claim-by-claim check against the sources (✓ supported, ~ partial, ✗ unsupported):")
    return rows.select("query_id", F.concat(head, F.lit("\n"), F.array_join(F.transform("ls", lambda x: x.line), "\n")).alias("report"))


def embed_input(text: Column) -> Column:
    """What an embedding model gets of a text."""
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, EMBED_CAP)


def plain(text: Column) -> Column:
    """Markdown as prose: without a first heading line, emphasis, code and list marks."""
    t = F.regexp_replace(text, r"\A\s*#{1,6}\s+[^\n]*\n?", "")
    return F.trim(F.regexp_replace(t, r"(?m)\*\*|\*|`|^#{1,6}\s+|^[-*]\s+", ""))


def cite(source: Column, section: Column) -> Column:
    """A hit's place without its first heading, which repeats the title."""
    parts = F.filter(F.split(F.coalesce(section, F.lit("")), " > "), lambda x: x != "")
    shown = F.when(F.size(parts) > 1, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    return F.concat_ws(" > ", F.array(source), shown)
