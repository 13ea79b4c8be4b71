"""Retrieval quality, and what is shown of hits and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import answers, evaluation, models, retrieve
from tessera.plans import sql
from tessera.plans.catalog import query, table
from tessera.plans.lexical import asked
from tessera.plans.search import notes

#: Cases: a benchmark item asks for a document that has the item's whole text.
CASES = """queries AS (SELECT item_id AS query_id, text FROM benchmark),
cases AS (SELECT b.item_id AS query_id, min(d.source || '/' || d.doc_id || '.md') AS expect FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id)"""


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def cases(spark, d):
    found = evaluation.holding(notes(spark, d).select("source", "text"), questions(spark, d))
    return found.groupBy("query_id").agg(F.min("source").alias("expect"))


@query(f"""WITH {CASES}, {sql.BM25}, h AS (SELECT l.query_id, l.rank FROM lex l JOIN cases c USING (query_id) JOIN documents d ON d.doc_id = l.id WHERE l.rank <= 5 AND contains(d.source || '/' || d.doc_id || '.md', c.expect)),
r AS (SELECT query_id, min(rank) AS rank FROM cases LEFT JOIN h USING (query_id) GROUP BY query_id)
SELECT count(*) AS cases, round(avg((coalesce(rank, 99) = 1)::INT), 6) AS recall_at_1, round(avg((coalesce(rank, 99) <= 5)::INT), 6) AS recall_at_5, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM r""")
def recall_mrr(spark, d):
    n = notes(spark, d)
    hits = retrieve.lexical_top_k(n, questions(spark, d), 5).join(n.select("id", "source"), "id")
    return evaluation.metrics(evaluation.first_ranks(cases(spark, d), hits))


@query(f"""WITH {CASES}, {sql.BM25}, {sql.HASHED},
v AS (SELECT 'lexical' AS variant, query_id, id FROM lex WHERE rank <= 5 UNION ALL SELECT 'vector', query_id, id FROM vec WHERE rank <= 5),
f AS (SELECT DISTINCT variant, query_id FROM v JOIN cases c USING (query_id) JOIN documents d ON d.doc_id = v.id WHERE contains(d.source || '/' || d.doc_id || '.md', c.expect))
SELECT variant, count(f.query_id) AS found, count(*) AS cases FROM (VALUES ('lexical'), ('vector')) x(variant) CROSS JOIN cases LEFT JOIN f USING (variant, query_id) GROUP BY variant""")
def bench_hit_at_k(spark, d):
    n, q = notes(spark, d), questions(spark, d)
    named = {"lexical": retrieve.lexical_top_k(n, q, 5), "vector": retrieve.hashed_top_k(n, q, 5)}
    return evaluation.compared(cases(spark, d), {k: h.join(n.select("id", "source"), "id") for k, h in named.items()})


@query(f"""WITH {CASES}, {sql.BM25}, top AS (SELECT l.query_id, d.source || '/' || d.doc_id || '.md' AS source, CASE WHEN d.doc_id % 2 = 0 THEN 'Part' ELSE '' END AS section, d.text FROM lex l JOIN documents d ON d.doc_id = l.id WHERE l.rank <= 5),
w AS (SELECT q.query_id, c.expect AS source, CASE WHEN q.query_id % 2 = 0 THEN 'Part' ELSE '' END AS section, q.text AS evidence FROM cases c JOIN queries q USING (query_id))
SELECT w.query_id, bool_or(coalesce(top.source = w.source AND top.section = w.section AND contains(top.text, w.evidence), false)) AS found FROM w LEFT JOIN top USING (query_id) GROUP BY w.query_id""")
def exact_evidence(spark, d):
    """File, section and passage of a retrieved hit must agree with the case."""
    n, q = notes(spark, d), questions(spark, d)
    wanted = cases(spark, d).join(q, "query_id").select("query_id", F.col("expect").alias("source"), F.when(F.col("query_id") % 2 == 0, "Part").otherwise("").alias("section"), F.col("text").alias("evidence"))
    found = retrieve.lexical_top_k(n, q, 5).join(n.select("id", "source", "text"), "id").withColumn("section", F.when(F.col("id") % 2 == 0, "Part").otherwise(""))
    return evaluation.exact_evidence(wanted, found)


HITS = f"""WITH {sql.QUERIES}, {sql.BM25}, hits AS (SELECT l.query_id, l.rank, d.source || '/' || d.doc_id || '.md' AS source, CASE WHEN d.doc_id % 2 = 0 THEN 'Part' ELSE '' END AS section, d.text, CASE WHEN d.doc_id % 3 = 0 THEN 'n-' || d.doc_id ELSE '' END AS superseded_by, CASE WHEN d.doc_id % 6 = 0 THEN '2024-01-01' ELSE '' END AS effective
FROM lex l JOIN documents d ON d.doc_id = l.id WHERE l.rank <= 5)"""


def hits(spark, d):
    n = notes(spark, d)
    found = retrieve.lexical_top_k(n, asked(spark), 5).join(n.select("id", "source", "text"), "id")
    i = F.col("id")
    return found.withColumns({"section": F.when(i % 2 == 0, "Part").otherwise(""), "superseded_by": F.when(i % 3 == 0, F.format_string("n-%d", i)).otherwise(""), "effective": F.when(i % 6 == 0, "2024-01-01").otherwise("")})


@query(HITS + " SELECT query_id, md5(string_agg('[' || rank || '] ' || source || CASE WHEN section <> '' THEN ' > ' || section ELSE '' END || chr(10) || substr(text, 1, 500), chr(10) || chr(10) ORDER BY rank)) AS digest FROM hits GROUP BY query_id")
def render_hits(spark, d):
    return answers.rendered(hits(spark, d)).select("query_id", F.md5(F.col("result").cast("binary")).alias("digest"))


@query(HITS + """ SELECT query_id, md5(string_agg('[chunk ' || rank || ' | source: ' || source || CASE WHEN section <> '' THEN ' | section: ' || section ELSE '' END || ']' || CASE WHEN superseded_by <> '' THEN chr(10) || '[SUPERSEDED by ' || superseded_by || CASE WHEN effective <> '' THEN ' (effective ' || effective || ')' ELSE '' END || ' — historical, not current practice]' ELSE '' END
|| chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest FROM hits GROUP BY query_id""")
def context_render(spark, d):
    return answers.context(hits(spark, d)).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"))


@query(HITS + " SELECT query_id, source FROM hits WHERE NOT starts_with(lower(source), 'src1/')")
def self_reference_guard(spark, d):
    return answers.outside(hits(spark, d), "SRC1/").select("query_id", "source")


@query(f"""WITH {CASES}, {sql.BM25},
hits AS (SELECT l.query_id, l.rank, d.source FROM lex l JOIN documents d ON d.doc_id = l.id WHERE l.rank <= 3),
sizes AS (SELECT query_id, count(*) AS n, count(DISTINCT source) AS files FROM hits GROUP BY query_id),
c AS (SELECT item_id AS query_id, n, files, trim(replace(substr(text, 1, 40), chr(10), ' ')) AS head, trim(replace(right(text, 30), chr(10), ' ')) AS tail, item_id % 4 AS k FROM benchmark JOIN sizes ON query_id = item_id)
SELECT query_id, md5(CASE WHEN files > 1 THEN 'Claim-by-claim check across ' || files || ' files (' || n || ' excerpts; ✓ supported, ~ partial, ✗ unsupported, ⚠ unlicensed cross-file join):' ELSE 'Claim-by-claim check against the sources (✓ supported, ~ partial, ✗ unsupported):' END
|| chr(10) || '  ' || CASE k WHEN 0 THEN '✓' WHEN 1 THEN '~' WHEN 2 THEN '✗' ELSE '?' END || ' ' || head || CASE WHEN n > 1 THEN ' [excerpts 1, 2]' ELSE ' [excerpt 1]' END
|| CASE k WHEN 0 THEN '  ⚠ cross-file inference not in the sources: ' || tail WHEN 1 THEN CASE WHEN n > 1 THEN '  (cross-file join checked)' ELSE '' END ELSE '' END
|| chr(10) || '  ✓ ' || tail) AS report FROM c""")
def verify_render(spark, d):
    """Reports on two claims about each benchmark item, read from a model's reply in prose, over its best three documents."""
    n, q = notes(spark, d), questions(spark, d)
    found = retrieve.lexical_top_k(n, q, 3).join(n.select("id", "source"), "id").withColumn("source", F.regexp_replace("source", "/.*", ""))
    flat = lambda c: F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))
    k, head, tail = F.col("query_id") % 4, flat(F.substring("text", 1, 40)), flat(F.right("text", F.lit(30)))
    said = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    claim = lambda text, status, excerpts, cross, reason: F.struct(text.alias("claim"), status.alias("status"), F.array(*map(F.lit, excerpts)).cast("array<int>").alias("excerpts"), cross.alias("cross_file"), reason.alias("reason"))
    first = claim(head, said("Supported", "partial", "UNSUPPORTED", "odd"), (1, 2, 9), said("unstated", "ok", "n/a", ""), tail)
    reply = F.concat(F.lit("Here it is:\n```\n"), F.to_json(F.array(first, claim(tail, F.lit("supported"), (), F.lit("ok"), F.lit("")))), F.lit("\n```"))
    report = answers.verification(models.claims(q.select("query_id", reply.alias("reply"))), found)
    return report.select("query_id", F.md5(F.col("report").cast("binary")).alias("report"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '^\s*#{1,6}\s+[^\n]*\n?', ''), '(?m)\*\*|\*|`|^#{1,6}\s+|^[-*]\s+', '', 'g')) AS plain FROM documents""")
def plain_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", answers.plain(F.col("text")).alias("plain"))
