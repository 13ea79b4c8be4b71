"""Incremental maintenance: documents against an older state of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import incremental, lexical, postings
from tessera.plans.catalog import query, table
from tessera.plans.lexical import asked, documents
from tessera.plans.sql import BM25, QUERIES
from tessera.plans.structure import WINDOWS
from tessera.scratch import scratch_path
from tessera.sources.segments import SegmentTable

PATH = "source || '/' || doc_id || '.md'"
OLD = f"SELECT {PATH} AS path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha1(text) END AS hash FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT 'gone/' || n_nationkey || '.md', 'x' FROM nation"
CHUNKS = f"SELECT {PATH} AS source, chunk, sha1(piece)[1:16] AS chash, piece AS text FROM ({WINDOWS}) w JOIN documents USING (doc_id)"


def path():
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def new_docs(spark, d):
    return table(spark, d, "documents").select(path().alias("path"), T.file_hash(F.col("text")).alias("hash"))


def old_docs(spark, d):
    old = table(spark, d, "documents").where("doc_id % 10 <> 3").select(path().alias("path"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise(T.file_hash(F.col("text"))).alias("hash"))
    return old.unionByName(table(spark, d, "nation").select(F.format_string("gone/%d.md", "n_nationkey").alias("path"), F.lit("x").alias("hash")))


def chunks(spark, d):
    cut = table(spark, d, "documents").select("doc_id", path().alias("source"), F.posexplode(T.windows(F.col("text"))).alias("chunk", "text"))
    return cut.withColumn("chash", T.chunk_hash(F.col("text")))


@query(f"SELECT d.path, CASE WHEN o.hash IS NULL THEN 'added' WHEN o.hash = d.hash THEN 'unchanged' ELSE 'updated' END AS status FROM (SELECT {PATH} AS path, sha1(text) AS hash FROM documents) d LEFT JOIN ({OLD}) o USING (path)")
def ingest_classify(spark, d):
    return incremental.classify(new_docs(spark, d), old_docs(spark, d)).select("path", "status")


@query(f"SELECT CASE WHEN o.hash IS NULL THEN 'added' WHEN o.hash = d.hash THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS n FROM (SELECT {PATH} AS path, sha1(text) AS hash FROM documents) d LEFT JOIN ({OLD}) o USING (path) GROUP BY 1")
def ingest_report(spark, d):
    return incremental.report(incremental.classify(new_docs(spark, d), old_docs(spark, d)))


@query("SELECT 'gone/' || n_nationkey || '.md' AS source FROM nation")
def prune_sources(spark, d):
    return incremental.vanished(old_docs(spark, d).withColumnRenamed("path", "source"), new_docs(spark, d))


@query(f"WITH c AS ({CHUNKS}), o AS (SELECT source, chash, min(chunk) AS k FROM c WHERE chunk % 2 = 0 GROUP BY ALL) SELECT c.source, c.chunk, o.k IS NOT NULL AS reused, o.k::DOUBLE AS value FROM c LEFT JOIN o USING (source, chash)")
def vector_reuse(spark, d):
    new = chunks(spark, d)
    old = new.where("chunk % 2 = 0").select("source", "chunk", "chash", F.array(F.col("chunk").cast("double")).alias("vec"))
    return incremental.reuse(new, old).select("source", "chunk", F.col("vec").isNotNull().alias("reused"), F.get("vec", F.lit(0)).alias("value"))


@query(f"WITH c AS ({CHUNKS}) SELECT source, chunk, chash, CASE WHEN source LIKE 'src1/%' THEN 'new' ELSE 'old' END AS state FROM c WHERE NOT (source LIKE 'src1/%' AND chunk > 0) AND source NOT LIKE 'src2/%'")
def upsert_result(spark, d):
    """Sources under src1 come again with one chunk each, those under src2 have come to nothing."""
    index = chunks(spark, d).select("source", "chunk", "chash", F.lit("old").alias("state"))
    fresh = index.where("source LIKE 'src1/%' AND chunk = 0").withColumn("state", F.lit("new"))
    touched = index.where("source LIKE 'src1/%' OR source LIKE 'src2/%'").select("source")
    return incremental.upsert(index, fresh, touched)


@query(f"WITH c AS ({CHUNKS}) SELECT source, count(*) AS chunks FROM c GROUP BY source")
def per_source_counts(spark, d):
    return incremental.per_source(chunks(spark, d))


@query(f"WITH c AS ({CHUNKS}) SELECT count(*) AS chunks, count(DISTINCT source) AS files FROM c")
def index_summary(spark, d):
    return incremental.summary(chunks(spark, d))


@query(f"WITH c AS ({CHUNKS}), p AS (SELECT DISTINCT source AS prefix FROM documents UNION ALL SELECT 'src' UNION ALL SELECT source || '/' || doc_id || '.md' FROM documents WHERE doc_id = 7) SELECT prefix, count(c.source) AS chunks FROM p LEFT JOIN c ON c.source = prefix OR starts_with(c.source, prefix || '/') GROUP BY prefix")
def source_prefix_chunks(spark, d):
    """A folder's name is no prefix of another's; a file is its own."""
    p = table(spark, d, "documents")
    prefixes = p.select(F.col("source").alias("prefix")).distinct().unionByName(spark.range(1).select(F.lit("src").alias("prefix"))).unionByName(p.where("doc_id = 7").select(path().alias("prefix")))
    return incremental.under(incremental.per_source(chunks(spark, d)), prefixes)


@query(f"WITH c AS ({CHUNKS}) SELECT prefix, count(*) AS chunks FROM c JOIN (VALUES ('src1'), ('src2/')) v(prefix) ON starts_with(c.source, prefix) GROUP BY prefix")
def harness_prefix_chunks(spark, d):
    prefixes = spark.createDataFrame([("src1",), ("src2/",)], "prefix string")
    return incremental.under(incremental.per_source(chunks(spark, d)), prefixes, slash=False)


@query(f"""WITH c AS ({CHUNKS}) SELECT source, chunk, source || '::' || chunk AS id, chash, 0.333333::DOUBLE AS first FROM c""")
def export_rows(spark, d):
    """Each row survives the way to JSON and back."""
    c = chunks(spark, d).select(F.concat_ws("::", "source", F.col("chunk").cast("string")).alias("id"), "source", "chunk", F.lit("").alias("section"), "text", F.lit("").alias("tags"), F.lit("").alias("links"), F.lit(0.0).alias("mtime"), F.lit("").alias("hash"), "chash", F.array(F.lit(1.0) / 3).alias("vec"))
    back = F.from_json("line", "id string, text string, vec array<double>")
    return incremental.export_rows(c).select("source", "chunk", back.alias("r")).select("source", "chunk", "r.id", T.chunk_hash(F.col("r.text")).alias("chash"), F.col("r.vec")[0].alias("first"))


@query(f"""WITH c AS (SELECT x.*, doc_id FROM ({CHUNKS}) x JOIN (SELECT {PATH} AS source, doc_id FROM documents) d USING (source))
SELECT source, chunk, chash, CASE WHEN doc_id % 7 = 0 THEN 'second' WHEN doc_id % 10 = 3 THEN 'third' ELSE 'first' END AS state
FROM c WHERE doc_id % 11 <> 0 AND NOT (doc_id % 7 = 0 AND chunk > 0)""")
def segmented_index(spark, d):
    """Three passes on a table in segments: most documents; those of every seventh cut to one
    chunk; new ones, and every eleventh pruned.  Merged on reading, some buckets compacted."""
    t = SegmentTable(spark, scratch_path(spark, "segmented"), buckets=16, most=2)
    of = F.regexp_extract("source", r"/(\d+)\.md$", 1).cast("long")
    every = chunks(spark, d).select("source", "chunk", "chash", of.alias("doc"))
    made = lambda rows, state: rows.withColumn("state", F.lit(state))
    t.replace(made(every.where("doc % 10 <> 3"), "first"))
    seventh = every.where("doc % 7 = 0")
    t.upsert(made(seventh.where("chunk = 0"), "second"), seventh.select("source"))
    t.upsert(made(every.where("doc % 10 = 3 AND doc % 7 <> 0"), "third"), every.where("doc % 11 = 0").select("source"))
    t.delete(every.where("doc % 11 = 0").select("source"))
    return t.read().select("source", "chunk", "chash", "state")


@query(f"WITH {QUERIES}, {BM25} SELECT query_id, id AS doc_id, score, rank FROM lex WHERE rank <= 10")
def bm25_delta_topk(spark, d):
    """An index of other documents, brought to these by three batches of deltas."""
    docs = documents(spark, d)
    wrong = docs.where("id % 7 = 0").select("id", F.translate("text", "aet", "tea").alias("text"))
    gone = table(spark, d, "nation").select((F.col("n_nationkey") + 1_000_000_000).cast("long").alias("id"), F.concat(F.lit("the thand "), "n_name").alias("text"))
    index = postings.DeltaIndex(spark, scratch_path(spark, "postings"))
    index.build(docs.where("id % 10 <> 3 AND id % 7 <> 0").unionByName(wrong).unionByName(gone), "a")
    none = docs.limit(0)
    index.apply(none, docs.where("id % 10 = 3 AND id % 7 <> 0"), "b")
    index.apply(wrong, docs.where("id % 7 = 0"), "c")
    index.apply(gone, none, "d")
    return lexical.top_k(index.scores(asked(spark)), 10).select("query_id", F.col("id").alias("doc_id"), "score", "rank")
