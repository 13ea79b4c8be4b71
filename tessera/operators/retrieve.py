"""Hybrid retrieval for a table of queries: channels, fusion, filters, feedback, reranking.

Order of a search: each channel's best `fetch`, reciprocal-rank fusion with a bonus
for literal identifiers, the best `fetch` of that, then filters, feedback, reranking
and the limit.  Filters come after the cut, so a filtered search may return fewer
than k rows; `prefilter` is there for those who want it otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import DIMENSIONS, token_bucket
from tessera.operators import lexical
from tessera.operators.nearest import Best
from tessera.scratch import durable

# The fusion constant, hits of a search, over-fetch, what a bad rating
# adds to a distance and what stands in for a missing one.
RRF_K, TOP_K, OVER_FETCH, BAD_RATING, PENALTY_SHARE, MISSING_DISTANCE = 60, 5, 4, 0.5, 0.3, 0.5
#: Queries that one dense search broadcasts at most.
QUERY_BLOCK = 4096
#: Queries up to which token hashes are compared, and texts scored, without Python.
FEW_QUERIES = 16
#: Different identifiers up to which each text is held against all of them.
LITERAL_TERMS = 200


def fetch_size(k: int, hybrid: bool = True, filtered: bool = False) -> int:
    return max(k * OVER_FETCH, 1) if hybrid or filtered else max(k, 1)


# ---- channels -----------------------------------------------------------------


def _blocks(queries: DataFrame) -> list[DataFrame]:
    n = queries.count()
    if n <= QUERY_BLOCK:
        return [queries]
    queries, parts = durable(queries, "queries"), -(-n // (QUERY_BLOCK // 2))  # each block reads them, none makes them anew
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]


def _nearest(corpus: DataFrame, queries: DataFrame, k: int, matrices: Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(query_id, id, distance, rank) of corpus (id, payload) and queries (query_id, vec).

    matrices: of a batch's payloads, (rows, their vectors) for each length of vectors.  The
    queries are broadcast a block at a time; a batch's vectors of a length meet them in matrix
    products of Best.cells values at most, and a task keeps its own k best, so k rows a query
    and task are shuffled.
    """
    spark, found = corpus.sparkSession, None
    for block in _blocks(queries):
        by: dict[int, tuple[list, list]] = {}
        for r in block.where(F.col("vec").isNotNull()).collect():
            v = np.array(r.vec, np.float64)
            length = np.linalg.norm(v)
            if length > 0 and np.isfinite(length):
                names, vs = by.setdefault(len(v), ([], []))
                names.append(r.query_id)
                vs.append(v / length)
        shared = spark.sparkContext.broadcast({d: (np.array(n, np.int64), np.array(v)) for d, (n, v) in by.items()})

        def run(batches, shared=shared):
            known = shared.value
            best = {d: Best(len(names), k) for d, (names, _) in known.items()}
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for rows, x in matrices(b.column(1)):
                    if x.shape[1] not in known or not len(x):
                        continue
                    names, q = known[x.shape[1]]
                    step = max(1, Best.cells // len(names))
                    for i in range(0, len(x), step):
                        y = x[i : i + step]
                        length = np.linalg.norm(y, axis=1)
                        ok = (length > 0) & np.isfinite(length)
                        d = 1 - q @ (np.where(ok[:, None], y, 0) / np.where(ok, length, 1)[:, None]).T
                        best[x.shape[1]].add(np.where(ok, np.round(d, 9), np.inf), ids[rows[i : i + step]])
            for d, found in best.items():
                r, v, i = found.rows()
                yield pa.RecordBatch.from_arrays([pa.array(known[d][0][r]), pa.array(i), pa.array(v)], ["query_id", "id", "distance"])

        part = corpus.mapInArrow(run, "query_id long, id long, distance double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]).astype(int):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(query_id, id, distance, rank): the k nearest by cosine, exactly, in double precision.

    queries: (query_id, vec).  Vectors of another length than a query's are no hits of it;
    null and zero vectors, and ones with null or infinite components, are none either.
    Ties of rounded distances go by id.
    """
    part = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col))
    return _nearest(part, queries, max(k, 1), _by_length).where(F.col("rank") <= k)


def hashed_top_k(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The dense channel with token-hash embeddings: (query_id, id, distance, rank) for docs (id, text).

    Each text's buckets are found once; a few queries are then held against them in the
    JVM, more of them by matrix products.  Nothing of the documents is shuffled but the best.
    """
    buckets = lambda text: F.transform(F.array_distinct(T.tokens(text)), lambda t: token_bucket(t).cast("int"))
    dims = F.sequence(F.lit(0), F.lit(DIMENSIONS - 1))
    asked = queries.select("query_id", buckets(F.col("text")).alias("b")).select("query_id", F.transform(dims, lambda i: F.size(F.filter("b", lambda x: x == i)).cast("double")).alias("vec"))
    part = docs.where(F.col("text").isNotNull()).select(F.col("id").cast("long").alias("id"), buckets(F.col("text")).alias("b"))
    if queries.count() <= FEW_QUERIES:
        return _held_against(part, asked, max(k, 1)).where(F.col("rank") <= k)

    def counted(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((len(lists), DIMENSIONS))
        np.add.at(out, (np.repeat(np.arange(len(lists)), lengths), lists.flatten().to_numpy(zero_copy_only=False)), 1)
        yield np.arange(len(lists)), out

    return _nearest(part, asked, max(k, 1), counted).where(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


def _held_against(part: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank) of part (id, b: buckets) and a few queries (query_id, vec), in Catalyst."""
    # squares of the bucket counts, from the sorted buckets: the n-th of a run adds 2 n - 1
    start = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))
    n = lambda acc, x: F.when(acc["at"] == x, acc["n"] + 1).otherwise(1)
    square = F.aggregate(F.sort_array("b"), start, lambda acc, x: F.struct(x.alias("at"), n(acc, x).alias("n"), (acc["sum"] + 2 * n(acc, x) - 1).cast("double").alias("sum")), lambda acc: acc["sum"])
    length = F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x)
    few = asked.select("query_id", "vec", F.sqrt(length).alias("long")).where("long > 0")
    both = part.select("id", "b", F.sqrt(square).alias("size")).join(F.broadcast(few))
    dot = F.aggregate("b", F.lit(0.0), lambda t, x: t + F.get("vec", x))
    near = both.select("query_id", "id", F.round(1 - F.try_divide(dot, F.col("size") * F.col("long")), 9).alias("distance"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "id"))
    return near.withColumn("rank", rank).where((F.col("rank") <= k) & F.col("distance").isNotNull())


def lexical_top_k(docs: DataFrame, queries: DataFrame, k: int, tokenizer: str = "default", index: lexical.LexicalIndex | None = None) -> DataFrame:
    whole = {"tinyint", "smallint", "int", "bigint"} >= {dict(docs.dtypes)["id"], dict(queries.dtypes)["query_id"]}
    if index is None and whole and queries.count() > FEW_QUERIES:
        return lexical.best(docs, queries, k, tokenizer)
    scored = index.scores(queries) if index else lexical.search(docs, queries, name=tokenizer)
    return lexical.top_k(scored, k).select("query_id", "id", "score", "rank")


def literal_hits(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, n): how many of a query's identifiers a text contains.

    Only queries that name an identifier take part.  Up to LITERAL_TERMS different identifiers
    are an array that each text is held against, in one pass without a join; more of them
    go by trigrams.
    """
    asked = queries.select("query_id", F.explode(T.identifier_terms(F.col("text"))).alias("term")).distinct()
    known = [r.term for r in asked.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    if len(known) > LITERAL_TERMS:
        found = by_trigrams(docs, asked.select("term").distinct())
    else:
        terms = F.array(*map(F.lit, sorted(known))) if known else F.expr("CAST(array() AS array<string>)")
        low = docs.select("id", F.lower("text").alias("low")) if known else docs.select("id", F.lower("text").alias("low")).limit(0)
        found = low.select("id", F.explode(F.filter(terms, lambda t: F.contains(F.col("low"), t))).alias("term"))
    return found.join(asked, "term").groupBy("query_id", "id").agg(F.count("*").alias("n")).select("query_id", "id", "n")


def _trigrams(run: Column) -> Column:
    """The different trigrams of an ASCII string, in linear time."""
    chars = lambda cs: F.transform(F.sequence(F.lit(0), F.size(cs) - 3), lambda i: F.concat(cs[i], cs[i + 1], cs[i + 2]))
    return F.array_distinct(F.flatten(F.transform(F.array(F.split(run, "(?!^)(?=.)")), chars)))


def by_trigrams(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term) of terms that texts contain, by equi-joins alone.

    An identifier lies inside one run of the characters that identifiers have, so a text is
    its different runs.  Terms meet the runs of the whole corpus, each once, by their rarest
    trigram there, and are then looked for in the run itself; the runs that hold a term
    lead back to the texts.
    """
    runs = docs.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9_.:/-]{3,})"), F.lit(1)))).alias("run"))
    grams = runs.select("run").distinct().select("run", F.explode(_trigrams(F.col("run"))).alias("gram"))
    mine = terms.where(F.length("term") >= 3).select("term", F.explode(_trigrams(F.col("term"))).alias("gram"))
    often = grams.join(mine.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("often"))
    rarest = mine.join(often, "gram").groupBy("term").agg(F.min_by("gram", F.struct("often", "gram")).alias("gram"))
    holds = grams.join(rarest, "gram").where(F.contains("run", "term")).select("run", "term")
    return runs.join(holds, "run").select("id", "term").distinct()


# ---- fusion -------------------------------------------------------------------


def contribution(rank: Column, k: int = RRF_K) -> Column:
    """rank from 1."""
    return 1.0 / (F.lit(k) + rank)


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, first_seen, distance) of ranked lists (query_id, id, rank): a union
    and one aggregation.  first_seen is where the id first stands, list by list; distance is the
    least of the lists that have one, so that no list is made again for it."""
    step = 1 << 40
    near = lambda d: F.col("distance") if "distance" in d.columns else F.lit(None).cast("double").alias("distance")
    parts = [d.select("query_id", "id", contribution(F.col("rank"), k).alias("c"), (F.col("rank") + F.lit(i * step)).cast("long").alias("at"), near(d)) for i, d in enumerate(lists)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("query_id", "id").agg(F.sum("c").alias("score"), F.min("at").alias("first_seen"), F.min("distance").alias("distance"))


def fuse(vector: DataFrame, lexical_: DataFrame, literal: DataFrame | None, fetch: int, k: int = RRF_K) -> DataFrame:
    """The best `fetch` of each query after fusion, with rank; ties keep the order
    vector list, lexical list, literal hits by id."""
    fused = rrf([vector, lexical_], k)
    if literal is not None:
        bonus = literal.select("query_id", "id", F.col("n").cast("double").alias("score"), (F.col("id").cast("long") + F.lit(1 << 42)).alias("first_seen"), F.lit(None).cast("double").alias("distance"))
        fused = fused.unionByName(bonus).groupBy("query_id", "id").agg(F.sum("score").alias("score"), F.min("first_seen").alias("first_seen"), F.min("distance").alias("distance"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "first_seen"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= fetch)


def merge_variants(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """One ranked list of the lists of a query's rewrites."""
    merged = rrf(lists, k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "first_seen"))
    return merged.withColumn("rank", rank)


# ---- after the cut ------------------------------------------------------------


def filters(tag: str | None = None, path_contains: str | None = None, since: float | None = None, exact: str | None = None) -> Column:
    """What a hit must meet; a filter that is empty, 0 or None is off."""
    cond = F.lit(True)
    if tag:
        cond = cond & F.array_contains(F.transform(F.split("tags", ","), lambda x: F.lower(T.strip(x))), tag.lower())
    if path_contains:
        cond = cond & F.contains(T.folded_path(F.col("source")), F.lit(path_contains.lower().replace("\\", "/")))
    if since:
        cond = cond & (F.coalesce("mtime", F.lit(0.0)) >= since)
    if exact:
        cond = cond & F.contains(F.lower("text"), F.lit(exact.lower()))
    return cond


def parse_since(value: Column) -> Column:
    """YYYY-MM-DD or YYYY-MM as the epoch seconds of its midnight in the session's time zone; null otherwise."""
    return F.unix_timestamp(F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), F.try_to_timestamp(value, F.lit("yyyy-MM")))).cast("double")


def penalties(feedback: DataFrame) -> DataFrame:
    """(chunk_id, penalty) of ratings (chunk_id, verdict)."""
    return feedback.where("verdict = 'bad'").groupBy("chunk_id").agg((F.lit(BAD_RATING) * F.count("*")).alias("penalty"))


def apply_feedback(hits: DataFrame, feedback: DataFrame, resort: bool = False) -> DataFrame:
    """hits with the distance raised for bad ratings (a missing or zero distance counts
    as 0.5 then); the order changes only with resort."""
    p = penalties(feedback).withColumnRenamed("chunk_id", "id")
    base = F.coalesce(F.nullif("distance", F.lit(0.0)), F.lit(MISSING_DISTANCE))
    out = hits.join(p, "id", "left").withColumn("distance", F.when(F.col("penalty") > 0, base + F.col("penalty") * PENALTY_SHARE).otherwise(F.col("distance"))).drop("penalty")
    if resort:
        out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "rank")))
    return out


def rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """hits by scores (query_id, id, score), the missing as 0; ties keep their order.

    Fail-open: a query without scores, or with a single hit, keeps its order.
    """
    both = hits.join(scores.select("query_id", "id", F.col("score").alias("rerank_score")), ["query_id", "id"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")))


def relative(hits: DataFrame, score: str = "score") -> DataFrame:
    """hits with each score as a share of its query's best."""
    return hits.withColumn("relative", F.try_divide(F.col(score), F.max(score).over(W.partitionBy("query_id"))))


def candidates(
    docs: DataFrame,
    queries: DataFrame,
    fetch: int,
    mode: str = "hybrid",
    tokenizer: str = "default",
    rrf_k: int = RRF_K,
    index: lexical.LexicalIndex | None = None,
    vectors: Callable[[DataFrame, int], DataFrame] | None = None,
    among: DataFrame | None = None,
) -> DataFrame:
    """The best `fetch` (query_id, id, rank, score, distance) of each query before any filter.

    vectors: the dense channel, from (queries, fetch) to (query_id, id, distance, rank); token
    hashes without it.  among: the ids that count; lexical statistics are of all docs.
    """
    inside = docs.join(among, "id", "left_semi") if among is not None else docs
    if mode != "lexical":
        vector = vectors(queries, fetch) if vectors else hashed_top_k(inside, queries, fetch)
    if mode != "vector":
        if among is None:
            words = lexical_top_k(docs, queries, fetch, tokenizer, index)
        else:
            scored = index.scores(queries) if index else lexical.search(docs, queries, name=tokenizer)
            words = lexical.top_k(scored.join(among, "id", "left_semi"), fetch).select("query_id", "id", "score", "rank")
    if mode == "vector":
        best = vector.withColumn("score", contribution(F.col("rank"), rrf_k))
    elif mode == "lexical":
        best = words.withColumn("distance", F.lit(None).cast("double"))
    else:
        best = fuse(vector, words, literal_hits(inside, queries), fetch, rrf_k)
    return best.select("query_id", "id", "rank", "score", "distance")


def finish(docs: DataFrame, best: DataFrame, k: int, cond: Column, feedback: DataFrame | None = None, rerank_with: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Payload for the candidates, then filters, feedback, reranking and the limit."""
    hits = docs.join(best, "id").where(cond)
    if feedback is not None:
        hits = apply_feedback(hits, feedback)
    if rerank_with is not None:
        hits = rerank(hits, rerank_with(hits))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    mode: str = "hybrid",
    tag: str | None = None,
    path_contains: str | None = None,
    since: float | None = None,
    exact: str | None = None,
    feedback: DataFrame | None = None,
    rerank_with: Callable[[DataFrame], DataFrame] | None = None,
    prefilter: bool = False,
    variants: list[DataFrame] | None = None,
    **channels,
) -> DataFrame:
    """Ranked hits (query_id, rank, id, source, text, tags, mtime, distance, score) of
    queries (query_id, text) in docs (id, source, text, tags, mtime).

    Payload is joined last, to the ids that are left.  variants: rewrites of the queries, as
    further tables; their lists are merged before filters, feedback and reranking.  channels:
    see candidates().
    """
    filtered = bool(tag or path_contains or since or exact or rerank_with)
    cond = filters(tag, path_contains, since, exact)
    among = docs.where(cond).select("id") if prefilter and filtered else None
    fetch = fetch_size(max(k, 0), mode == "hybrid", filtered)
    best = candidates(docs, queries, fetch, mode, among=among, **channels)
    if variants:
        lists = [best, *(candidates(docs, v, fetch, mode, among=among, **channels) for v in variants)]
        best = merge_variants(lists, channels.get("rrf_k", RRF_K)).where(F.col("rank") <= fetch)
    return finish(docs, best.select("query_id", "id", "rank", "score", "distance"), k, cond, feedback, rerank_with)
