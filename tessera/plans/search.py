"""Vector channel, fusion, filters, feedback, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import cosine_distance, hash_embedding, hash_vector
from tessera.operators import cells, retrieve
from tessera.plans import sql
from tessera.plans.catalog import query, table
from tessera.plans.lexical import asked, documents


def notes(spark, d):
    """The documents as indexed notes."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"),
        "text",
        F.concat("lang", F.lit(",note")).alias("tags"),
        (F.lit(1700000000.0) + F.col("doc_id")).alias("mtime"),
    )


def shown(hits):
    return hits.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.round("distance", 4).alias("distance"))


@query("""SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4) AS distance FROM embeddings
ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9), vec_id LIMIT 10""")
def vector_topk(spark, d):
    """Ten nearest of one vector, in Catalyst."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    near = e.join(F.broadcast(q)).select("vec_id", F.round(cosine_distance(F.col("embedding"), F.col("q")), 9).alias("distance"))
    return near.orderBy("distance", "vec_id").limit(10).select("vec_id", F.round("distance", 4).alias("distance"))


NEAREST = """SELECT query_id, vec_id, round(distance, 4) AS distance, rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE rank <= 5"""


@query(NEAREST)
def vector_batch_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    found = retrieve.dense_top_k(e, q, 5, "vec_id", "embedding")
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 4).alias("distance"), "rank")


@query(NEAREST)
def vector_cells_topk(spark, d):
    """The same by cells, of which those that can't hold a neighbour are left out."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec"))
    found = cells.CellIndex.build(e, "vec_id", "embedding").search(q, 5)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 4).alias("distance"), "rank")


@query(f"WITH {sql.QUERIES}, {sql.HASHED} SELECT id AS doc_id, count(*) AS buckets, round(max(w), 6) AS heaviest, round(sum(w * w), 6) AS norm FROM dv GROUP BY id")
def hash_embed_norm(spark, d):
    v = hash_embedding(table(spark, d, "documents"), "doc_id", "text")
    return v.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("buckets"), F.round(F.max("weight"), 6).alias("heaviest"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm"))


@query(f"""WITH t AS (SELECT item_id, unnest(list_distinct({sql.TOKENS})) AS t FROM benchmark), b AS (SELECT item_id, ('0x' || right(sha256(t), 2))::INT AS b, count(*) AS n FROM t GROUP BY ALL)
SELECT item_id, b::BIGINT AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)::DOUBLE), 9) AS weight FROM b""")
def hash_vector_sha256(spark, d):
    """The 256-dimensional embedding as a dense vector, its non-zero components."""
    v = table(spark, d, "benchmark").select("item_id", F.posexplode(hash_vector(F.col("text"), 256, "sha256")).alias("bucket", "weight"))
    return v.where("weight > 0").select("item_id", "bucket", F.round("weight", 9).alias("weight"))


@query(f"WITH {sql.QUERIES}, {sql.HASHED} SELECT query_id, id AS doc_id, round(distance, 4) AS distance, rank FROM vec WHERE rank <= 20")
def vector_channel(spark, d):
    return retrieve.hashed_top_k(documents(spark, d), asked(spark), 20).select("query_id", F.col("id").alias("doc_id"), F.round("distance", 4).alias("distance"), "rank")


@query(f"WITH {sql.QUERIES}, {sql.LITERAL} SELECT query_id, id AS doc_id, n FROM lit WHERE n > 0")
def literal_channel(spark, d):
    return retrieve.literal_hits(documents(spark, d), asked(spark)).withColumnRenamed("id", "doc_id")


@query(f"""WITH {sql.QUERIES}, {sql.BM25}, {sql.HASHED}, p AS (SELECT query_id, id, 1::DOUBLE / (60 + rank) AS c FROM vec WHERE rank <= 20 UNION ALL SELECT query_id, id, 1::DOUBLE / (60 + rank) FROM lex WHERE rank <= 20)
SELECT query_id, id AS doc_id, round(sum(c), 6) AS score FROM p GROUP BY query_id, id""")
def rrf_fuse(spark, d):
    docs, q = documents(spark, d), asked(spark)
    return retrieve.rrf([retrieve.hashed_top_k(docs, q, 20), retrieve.lexical_top_k(docs, q, 20)]).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(sql.hits())
def hybrid_search(spark, d):
    return shown(retrieve.search(notes(spark, d), asked(spark), 5))


@query(sql.hits("list_contains(list_transform(string_split(n.tags, ','), lambda x: lower(trim(x))), 'fr')"))
def search_tag(spark, d):
    return shown(retrieve.search(notes(spark, d), asked(spark), 5, tag="FR"))


@query(sql.hits("contains(lower(n.source), 'src1/')"))
def search_path(spark, d):
    return shown(retrieve.search(notes(spark, d), asked(spark), 5, path_contains="SRC1\\"))


@query(sql.hits("n.mtime >= 1700000100"))
def search_since(spark, d):
    return shown(retrieve.search(notes(spark, d), asked(spark), 5, since=1700000100.0))


@query(sql.hits("contains(lower(n.text), 'the th')"))
def search_exact(spark, d):
    return shown(retrieve.search(notes(spark, d), asked(spark), 5, exact="The th"))


@query(f"WITH {sql.QUERIES}, {sql.HASHED} SELECT query_id, rank, id AS doc_id, round(1::DOUBLE / (60 + rank), 6) AS score, round(distance, 4) AS distance FROM vec WHERE rank <= 5")
def search_vector_mode(spark, d):
    return shown(retrieve.search(notes(spark, d), asked(spark), 5, mode="vector"))


@query(f"WITH {sql.QUERIES}, {sql.BM25} SELECT query_id, rank, id AS doc_id, score FROM lex WHERE rank <= 5")
def search_lexical_mode(spark, d):
    return shown(retrieve.search(notes(spark, d), asked(spark), 5, mode="lexical")).drop("distance")


@query(f"""WITH {sql.QUERIES}, {sql.BM25}, w AS (SELECT l.query_id, l.id, l.score FROM bm l JOIN documents d ON d.doc_id = l.id WHERE d.lang = 'fr'),
g AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM w) SELECT query_id, rank, id AS doc_id FROM g WHERE rank <= 5""")
def search_prefiltered(spark, d):
    """The extension that filters before the cut (with the corpus statistics of all documents)."""
    return retrieve.search(notes(spark, d), asked(spark), 5, mode="lexical", tag="fr", prefilter=True).select("query_id", "rank", F.col("id").alias("doc_id"))


@query(f"""WITH {sql.QUERIES}, {sql.BM25}, a AS (SELECT id, rank FROM lex WHERE query_id = 0 AND rank <= 20), b AS (SELECT id, rank FROM lex WHERE query_id = 1 AND rank <= 20),
p AS (SELECT id, 1::DOUBLE / (60 + rank) AS c, rank AS seen FROM a UNION ALL SELECT id, 1::DOUBLE / (60 + rank), rank + 1099511627776 FROM b),
s AS (SELECT id, sum(c) AS score, min(seen) AS seen FROM p GROUP BY id)
SELECT * FROM (SELECT id AS doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, seen) AS rank FROM s) WHERE rank <= 10""")
def multi_query_rrf(spark, d):
    """Two variants of one query, merged."""
    best = retrieve.lexical_top_k(documents(spark, d), asked(spark), 20)
    lists = [best.where(F.col("query_id") == i).withColumn("query_id", F.lit(0)) for i in (0, 1)]
    return retrieve.merge_variants(lists).where("rank <= 10").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("SELECT doc_id, 0.5::DOUBLE * count(*) AS penalty FROM labels WHERE quality = 0 GROUP BY doc_id")
def feedback_penalties(spark, d):
    rated = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 0, "bad").otherwise("good").alias("verdict"))
    return retrieve.penalties(rated).withColumnRenamed("chunk_id", "doc_id")


@query(f"""WITH {sql.QUERIES}, {sql.HASHED}, p AS (SELECT doc_id AS id, 0.5::DOUBLE * count(*) AS penalty FROM labels WHERE quality = 0 GROUP BY doc_id)
SELECT query_id, id AS doc_id, rank, round(CASE WHEN penalty > 0 THEN coalesce(nullif(distance, 0), 0.5) + penalty * 0.3 ELSE distance END, 4) AS distance FROM vec LEFT JOIN p USING (id) WHERE rank <= 50""")
def feedback_distance(spark, d):
    rated = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 0, "bad").otherwise("good").alias("verdict"))
    hits = retrieve.apply_feedback(retrieve.hashed_top_k(documents(spark, d), asked(spark), 50), rated)
    return hits.select("query_id", F.col("id").alias("doc_id"), "rank", F.round("distance", 4).alias("distance"))


@query(f"""WITH {sql.QUERIES}, {sql.BM25}, s AS (SELECT l.query_id, l.id, l.rank, (l.id % 4)::DOUBLE AS r FROM lex l WHERE rank <= 10 AND l.id % 3 <> 0 UNION ALL SELECT query_id, id, rank, 0 FROM lex WHERE rank <= 10 AND id % 3 = 0)
SELECT query_id, id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, rank) AS rank FROM s""")
def rerank_stub(spark, d):
    """Scores of a stand-in for a model: the id modulo 4, none for every third hit."""
    hits = retrieve.lexical_top_k(documents(spark, d), asked(spark), 10).select("query_id", "id", "rank")
    scores = hits.where("id % 3 <> 0").select("query_id", "id", (F.col("id") % 4).cast("double").alias("score"))
    return retrieve.rerank(hits, scores).select("query_id", F.col("id").alias("doc_id"), "rank")


@query("SELECT event_id, epoch(date_trunc('day', ts)) AS by_day, epoch(date_trunc('month', ts)) AS by_month, NULL::DOUBLE AS neither FROM events")
def since_parser(spark, d):
    e = table(spark, d, "events")
    since = retrieve.parse_since
    return e.select("event_id", since(F.date_format("ts", "yyyy-MM-dd")).alias("by_day"), since(F.date_format("ts", "yyyy-MM")).alias("by_month"), since(F.lit("last week")).alias("neither"))
