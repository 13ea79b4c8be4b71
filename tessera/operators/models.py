"""What model hooks are asked and how their replies are read; an unreadable reply changes nothing.

A hook is a function from a column of prompts to a column of replies, null where it failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import answers

Ask = Callable[[Column], Column]

# Facts kept of a conversation, characters of it that are read, and the best relevance.
FACTS, TRANSCRIPT, BEST = 3, 2000, 3

CLAIM = "struct<claim:string,status:string,excerpts:array<int>,cross_file:string,reason:string>"


def listed(reply: Column, item: str) -> Column:
    """The items of one type in the outermost [...] of a reply, which may stand in prose or a fence; null without a list."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), "array<variant>")
    return F.filter(F.transform(found, lambda x: F.try_variant_get(x, "$", item)), lambda x: x.isNotNull())


def relevance(hits: DataFrame, queries: DataFrame, ask: Ask) -> DataFrame:
    """(query_id, id, score): one prompt for each query lists its hits' first characters, and
    the reply is pairs [number, 0 to 3].  No rows for a query with fewer than two hits, or
    whose reply has no pair."""
    numbered = hits.select("query_id", F.struct("rank", "id", F.substring("text", 1, answers.RERANK_LLM).alias("text")).alias("h")).groupBy("query_id").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    listing = F.array_join(F.transform("hs", lambda h, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), h["text"])), "\n\n")
    prompt = F.concat(F.lit(f"Rate how well each candidate answers the query, 0 (not) to {BEST} (fully). Reply with a JSON array of [number, rating] only.\n\nQuery: "), "asked", F.lit("\n\nCandidates:\n"), listing)
    rows = numbered.where(F.size("hs") >= 2).join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
    pairs = rows.select("query_id", "hs", listed(ask(prompt), "array<double>").alias("ps"))
    one = pairs.select("query_id", "hs", F.explode(F.filter("ps", lambda p: F.size(p) == 2)).alias("p"))
    rated = one.select("query_id", F.get("hs", F.col("p")[0].cast("int"))["id"].alias("id"), F.col("p")[1].alias("score"))
    return rated.where("id IS NOT NULL").groupBy("query_id", "id").agg(F.max("score").alias("score"))


def similarity(hits: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """(query_id, id, score) by a model of (query, passage) pairs that sees the first characters of
    a passage; no rows for a query with fewer than two hits, or that the model failed on."""
    n = hits.groupBy("query_id").count().where("count >= 2").select("query_id")
    both = hits.join(n, "query_id").join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
    return both.select("query_id", "id", score(F.col("asked"), F.substring("text", 1, answers.RERANK_LOCAL)).cast("double").alias("score")).where("score IS NOT NULL")


def claims(replies: DataFrame) -> DataFrame:
    """(query_id, pos, claim, status, excerpts, cross_file, reason) of replies (query_id, reply)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = replies.select("query_id", F.posexplode(listed(F.col("reply"), CLAIM)).alias("pos", "c")).select("query_id", "pos", "c.*")
    return rows.where("claim IS NOT NULL").select("query_id", "pos", "claim", empty("status"), F.coalesce("excerpts", F.expr("CAST(array() AS array<int>)")).alias("excerpts"), empty("cross_file"), empty("reason"))


def facts(replies: DataFrame) -> DataFrame:
    """(query_id, pos, title, text): the first facts with a text of replies (query_id, reply)."""
    found = F.filter(listed(F.col("reply"), "struct<title:string,text:string>"), lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) != "")
    return replies.select("query_id", F.posexplode(F.slice(found, 1, FACTS)).alias("pos", "f")).select("query_id", "pos", "f.title", "f.text")
