"""Tokenizers and BM25."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import blockmax, lexical, retrieve
from tessera.plans.catalog import query, table
from tessera.plans.sql import ASKED, BM25, QUERIES, TOK, TOKENS


def asked(spark):
    return spark.createDataFrame(list(ASKED.items()), "query_id long, text string")


def documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {QUERIES}, {BM25} SELECT query_id, id AS doc_id, score, rank FROM lex WHERE rank <= 10")
def bm25_topk(spark, d):
    return lexical.top_k(lexical.search(documents(spark, d), asked(spark)), 10).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query(f"WITH {QUERIES}, {BM25} SELECT query_id, id AS doc_id, score, rank FROM lex WHERE rank <= 10")
def bm25_index_topk(spark, d):
    """The same by way of a whole index."""
    return lexical.top_k(lexical.LexicalIndex.build(documents(spark, d)).scores(asked(spark)), 10).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query(f"WITH queries AS (SELECT item_id AS query_id, text FROM benchmark), {BM25} SELECT query_id, id AS doc_id, score, rank FROM lex WHERE rank <= 10")
def bm25_blockmax_topk(spark, d):
    """All benchmark items as queries, by block maxima: ranges of documents that can't reach the tenth score are left out."""
    asked_for = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return blockmax.BlockIndex.build(documents(spark, d)).search(asked_for, 10).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query(f"WITH {QUERIES}, {BM25} SELECT query_id, id AS doc_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS relative FROM lex WHERE rank <= 10")
def relative_scores(spark, d):
    best = lexical.top_k(lexical.search(documents(spark, d), asked(spark)), 10)
    return retrieve.relative(best).select("query_id", F.col("id").alias("doc_id"), F.round("relative", 6).alias("relative"))


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term")
def tok_default_tf(spark, d):
    i = lexical.LexicalIndex.build(documents(spark, d))
    return i.postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term ORDER BY df DESC, term LIMIT 20")
def term_df_top(spark, d):
    return lexical.LexicalIndex.build(documents(spark, d)).frequencies.orderBy(F.desc("df"), "term").limit(20)


@query(f"SELECT count(*) AS n, round(avg(len({TOKENS})), 6) AS avgdl, sum((len({TOKENS}) = 0)::INT)::BIGINT AS empty FROM documents")
def doc_length_stats(spark, d):
    toks = lexical.tokenised(documents(spark, d), "id", "text")
    return toks.agg(F.count("*").alias("n"), F.round(F.avg(F.size("tokens")), 6).alias("avgdl"), F.count_if(F.size("tokens") == 0).alias("empty"))


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS toks, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)+'), lambda x: replace(x, '-', '')) AS j FROM documents)
SELECT doc_id, (len(toks) + len(j))::BIGINT AS n_tokens, array_to_string(j, ' ') AS joined FROM t""")
def tok_hyphen_join(spark, d):
    toks = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("a"), T.tokens_hyphen_join(F.col("text")).alias("b"))
    return toks.select("doc_id", F.size("b").alias("n_tokens"), F.array_join(F.slice("b", F.size("a") + 1, F.greatest(F.size("b") - F.size("a"), F.lit(0))), " ").alias("joined"))


@query(rf"""WITH t AS (SELECT doc_id, {TOKENS} AS toks, regexp_extract_all(lower(text), '[a-z0-9]+(?:[-_.:/]+[a-z0-9]+)+|[a-z0-9]*[a-z]\d[a-z0-9]*|\d+[a-z][a-z0-9]*') AS i FROM documents),
e AS (SELECT doc_id, toks, list_sort(list_filter(list_distinct(i), lambda x: NOT list_contains(toks, x))) AS extra FROM t)
SELECT doc_id, (len(toks) + len(extra))::BIGINT AS n_tokens, array_to_string(extra, ' ') AS extra FROM e""")
def tok_identifier(spark, d):
    toks = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("a"), T.tokens_identifier(F.col("text")).alias("b"))
    extra = F.slice("b", F.size("a") + 1, F.greatest(F.size("b") - F.size("a"), F.lit(0)))
    return toks.select("doc_id", F.size("b").alias("n_tokens"), F.array_join(F.sort_array(extra), " ").alias("extra"))


@query(r"""WITH t AS (SELECT doc_id, lower(translate(text, 'aeiou', '全文检索库')) AS x FROM documents),
p AS (SELECT doc_id, list_concat(list_concat(regexp_extract_all(x, '[a-z0-9]+'), list_transform(regexp_extract_all(x, '[a-z0-9]+(?:-[a-z0-9]+)+'), lambda y: replace(y, '-', ''))),
  flatten(list_transform(regexp_extract_all(x, '[\x{4e00}-\x{9fff}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))) AS toks FROM t)
SELECT doc_id, len(toks)::BIGINT AS n_tokens, md5(array_to_string(toks, ' ')) AS digest FROM p""")
def tok_cjk_bigram(spark, d):
    """The documents hold no CJK text, so their vowels are made into some."""
    toks = table(spark, d, "documents").select("doc_id", T.tokens_cjk_bigram(F.translate("text", "aeiou", "全文检索库")).alias("t"))
    return toks.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-_.:/]{1,2}[A-Za-z0-9]+)+|[A-Za-z]*\d[A-Za-z0-9]*'), lambda x: trim(lower(x), '-_.:/')),
 lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+')))), ' ') AS terms FROM documents""")
def identifier_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.sort_array(T.identifier_terms(F.col("text"))), " ").alias("terms"))


_ = TOK
