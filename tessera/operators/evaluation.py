"""Retrieval quality over a table of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Words that a text and a passage in it are met on; passages up to which they are broadcast, and hashes up to which they are a set.
KEY, FEW = 5, 20_000
#: Short passages that a text is held against in one pass.
BLOCK = 500


def holding(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, source) of docs (source, text) that contain a passage (query_id, text).

    A passage of KEY + 2 words or more has KEY whole words inside; docs are met on the hash
    of every such run of theirs, and only those that meet are searched.  Hashes of up to FEW
    passages are a set that a text's own are held against; more are joined without the texts.  Shorter ones are an
    array that each text is held against, a block of BLOCK passages at a time.
    """
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    cut = passages.where("text <> ''").select("query_id", F.col("text").alias("passage"), words(F.col("text")).alias("w"))
    long = cut.where(F.size("w") >= KEY + 2).select("query_id", "passage", F.xxhash64(*[F.col("w")[k + 1] for k in range(KEY)]).alias("key"))
    runs = F.expr(f"CASE WHEN size(w) >= {KEY} THEN transform(sequence(0, size(w) - {KEY}), i -> xxhash64({', '.join(f'w[i + {k}]' for k in range(KEY))})) ELSE array() END")
    keyed = docs.select("source", "text", words(F.col("text")).alias("w")).select("source", "text", runs.alias("keys"))
    few = F.broadcast(long) if passages.count() <= FEW else long
    wanted = [r.key for r in long.select("key").distinct().limit(FEW + 1).collect()]
    if len(wanted) <= FEW:  # a text goes with the keys that it shares with a passage, not with each run of its own
        mine = keyed.select("source", "text", F.filter("keys", lambda x: x.isin(*wanted)).alias("keys")) if wanted else keyed.limit(0)
        met = mine.select("source", "text", F.explode(F.array_distinct("keys")).alias("key")).join(few, "key").where(F.contains("text", "passage")).select("query_id", "source")
    else:
        pairs = keyed.select("source", F.explode(F.array_distinct("keys")).alias("key")).join(long.select("query_id", "key"), "key").select("source", "query_id").distinct()
        met = docs.select("source", "text").join(pairs, "source").join(long.select("query_id", "passage"), "query_id").where(F.contains("text", "passage")).select("query_id", "source")
    short = cut.where(F.size("w") < KEY + 2).select("query_id", "passage")
    known: list[str] = []
    for r in short.select("passage").distinct().orderBy("passage").toLocalIterator():
        known.append(r.passage)
        if len(known) == BLOCK:
            met, known = met.unionByName(_held(docs, known, short)), []
    return (met.unionByName(_held(docs, known, short)) if known else met).distinct()


def _held(docs: DataFrame, passages: list[str], asked: DataFrame) -> DataFrame:
    hits = docs.select("source", F.explode(F.filter(F.array(*map(F.lit, passages)), lambda p: F.contains(F.col("text"), p))).alias("passage"))
    return hits.join(asked, "passage").select("query_id", "source")


def first_ranks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, rank): the first hit whose source contains the case's expect; null if there is none."""
    ok = hits.join(cases.select("query_id", "expect"), "query_id").where(F.contains("source", "expect"))
    return cases.select("query_id").join(ok.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")


def metrics(ranks: DataFrame, k: int = 5) -> DataFrame:
    """One row: cases, recall_at_1, recall_at_k, mrr."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    r = F.col("rank")
    return ranks.agg(F.count("*").alias("cases"), share(r == 1).alias("recall_at_1"), share(r <= k).alias(f"recall_at_{k}"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"))


def compared(cases: DataFrame, variants: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """(variant, found, cases): hit@k by variant."""
    out = None
    for name, hits in variants.items():
        ranks = first_ranks(cases, hits.where(F.col("rank") <= k))
        row = ranks.agg(F.count("rank").alias("found"), F.count("*").alias("cases")).select(F.lit(name).alias("variant"), "found", "cases")
        out = row if out is None else out.unionByName(row)
    return out


def exact_evidence(cases: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, found): a hit with the case's source, section and passage among the first k."""
    ok = hits.where(F.col("rank") <= k).join(cases.select("query_id", F.col("source").alias("s"), F.col("section").alias("c"), "evidence"), "query_id")
    ok = ok.where((F.col("source") == F.col("s")) & (F.col("section") == F.col("c")) & F.contains("text", "evidence"))
    return cases.select("query_id").join(ok.select("query_id", F.lit(True).alias("found")).distinct(), "query_id", "left").select("query_id", F.coalesce("found", F.lit(False)).alias("found"))
