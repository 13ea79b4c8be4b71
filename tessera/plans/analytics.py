"""Analytics over logs and notes: events stand in for the query log, labels for feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import governance, logs, topics
from tessera.plans.catalog import query, table
from tessera.plans.sql import TOKENS
from tessera.sources import harness

#: The log's last day and moment.
TODAY, NOW = "2024-01-30", 1706659200.0

LOG = """SELECT event_id AS ord, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'agent ' || user_id % 7 END AS label, 'editor' AS role,
CASE WHEN event_type = 'click' THEN 'ask' ELSE 'search' END AS kind, '  ' || event_type || ' Q' || user_id || ' ' AS query,
CASE WHEN (props::JSON ->> 'k')::INT < 25 THEN 0 ELSE (props::JSON ->> 'k')::INT // 10 END AS hits, CASE WHEN user_id % 4 = 0 THEN '' WHEN user_id % 4 = 1 THEN 'top.md > Part' ELSE 'notes/u' || user_id || '/n.md > Part' END AS top, value AS ms FROM events"""
FEEDBACK = "SELECT doc_id, source || '/' || doc_id || '.md::' || doc_id % 3 AS chunk_id, CASE WHEN quality = 0 THEN 'bad' ELSE 'good' END AS verdict FROM labels JOIN documents USING (doc_id)"


def log(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    u = F.col("user_id")
    return e.select(
        F.col("event_id").alias("ord"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.when(u % 5 == 0, "").otherwise(F.format_string("agent %d", u % 7)).alias("label"),
        F.lit("editor").alias("role"),
        F.when(F.col("event_type") == "click", "ask").otherwise("search").alias("kind"),
        F.format_string("  %s Q%d ", "event_type", "user_id").alias("query"),
        F.when(k < 25, 0).otherwise((k / 10).cast("int")).alias("hits"),
        F.when(u % 4 == 0, "").when(u % 4 == 1, "top.md > Part").otherwise(F.format_string("notes/u%d/n.md > Part", "user_id")).alias("top"),
        F.col("value").alias("ms"),
    )


def feedback(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return both.select("doc_id", F.format_string("%s/%d.md::%d", "source", "doc_id", F.col("doc_id") % 3).alias("chunk_id"), F.when(F.col("quality") == 0, "bad").otherwise("good").alias("verdict"))


P95 = "CASE WHEN len(s) >= 20 THEN (s[j] * (20 - (19 * (len(s) + 1) - j * 20)) + s[j + 1] * (19 * (len(s) + 1) - j * 20)) / 20 END"


def snapshot_sql(order: str, verdict: str) -> str:
    return f"""SELECT q.n AS queries, coalesce(round(zero / n, 4), 0) AS zero_hit_rate, round(ah, 2) AS avg_hits, round(am, 1) AS avg_ms, round({P95}, 1) AS p95_ms, f.total AS feedback_total,
round(bad / (bad + good), 4) AS bad_rate, round((bad + good) / n, 4) AS feedback_coverage
FROM (SELECT n, zero, ah, am, s, greatest(1, least(len(s) - 1, (19 * (len(s) + 1)) // 20)) AS j FROM (SELECT count(*) AS n, count_if(hits = 0) AS zero, avg(hits) AS ah, avg(ms) AS am, list_sort(list(ms)) AS s FROM (SELECT * FROM log ORDER BY ord {order} LIMIT 200))) q,
(SELECT count(*) AS total, count_if(v = 'bad') AS bad, count_if(v = 'good') AS good FROM (SELECT {verdict} AS v FROM feedback)) f"""


@query(f"WITH log AS ({LOG}), feedback AS ({FEEDBACK}) {snapshot_sql('DESC', 'verdict')}")
def quality_snapshot(spark, d):
    return logs.quality_snapshot(log(spark, d), feedback(spark, d))


@query(f"""WITH log AS ({LOG}), feedback AS ({FEEDBACK}), c AS ({snapshot_sql('DESC', "CASE WHEN doc_id % 2 = 0 THEN 'bad' ELSE verdict END")}), b AS (SELECT * REPLACE (avg_hits + 2 AS avg_hits, zero_hit_rate - 0.2 AS zero_hit_rate) FROM ({snapshot_sql('DESC', 'verdict')}))
SELECT * FROM (SELECT 0::BIGINT AS pos, 'feedback_degradation' AS kind, 'critical' AS severity FROM c, b WHERE c.bad_rate - b.bad_rate >= 0.08 AND c.feedback_total >= 10
UNION ALL SELECT 1, 'stale_truth', 'critical' FROM c, b WHERE c.bad_rate - b.bad_rate >= 0.08 AND c.zero_hit_rate <= b.zero_hit_rate
UNION ALL SELECT 2, 'zero_hit_spike', 'warning' FROM c, b WHERE c.zero_hit_rate - b.zero_hit_rate >= 0.1
UNION ALL SELECT 3, 'fewer_hits', 'warning' FROM c, b WHERE c.avg_hits - b.avg_hits <= -1)""")
def quality_drift(spark, d):
    """Against a baseline with more hits, fewer misses and better ratings."""
    worse = feedback(spark, d).withColumn("verdict", F.when(F.col("doc_id") % 2 == 0, "bad").otherwise(F.col("verdict")))
    base = logs.quality_snapshot(log(spark, d), feedback(spark, d)).withColumns({"avg_hits": F.col("avg_hits") + 2, "zero_hit_rate": F.col("zero_hit_rate") - 0.2})
    return logs.drift(logs.quality_snapshot(log(spark, d), worse), base)


@query(f"SELECT kind, round({P95}, 6) AS p95 FROM (SELECT kind, s, greatest(1, least(len(s) - 1, (19 * (len(s) + 1)) // 20)) AS j FROM (SELECT event_type AS kind, list_sort(list(value)) AS s FROM events GROUP BY event_type))")
def p95_exclusive(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), "value")
    return logs.p95_by(e, "kind", "value").select("kind", F.round("p95", 6).alias("p95"))


LEDGER = "SELECT event_id AS ord, epoch(ts) AS ts, 'mem/' || user_id || '.md' AS source, CASE WHEN event_type = 'click' THEN '' ELSE event_type || ' ' || event_id END AS query FROM events"


def ledger(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("ord"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        F.format_string("mem/%d.md", "user_id").alias("source"),
        F.when(F.col("event_type") == "click", "").otherwise(F.format_string("%s %d", "event_type", "event_id")).alias("query"),
    )


CITED = f"SELECT source, count(*) AS count, max(ts) AS last_ts, array_to_string(list_reverse(list(query ORDER BY ts DESC, ord DESC) FILTER (query <> '')[1:3]), '|') AS queries FROM ({LEDGER}) GROUP BY source"


@query(f"SELECT source, count, round(last_ts, 3) AS last_ts, queries FROM ({CITED})")
def citation_rollup(spark, d):
    return logs.citations(ledger(spark, d)).select("source", "count", F.round("last_ts", 3).alias("last_ts"), F.array_join("queries", "|").alias("queries"))


@query(f"SELECT regexp_replace(chunk_id, '::[0-9]+$', '') AS source, count(*) AS corrections FROM ({FEEDBACK}) WHERE verdict = 'bad' GROUP BY 1")
def corrections_rollup(spark, d):
    return logs.corrections(feedback(spark, d))


MEMORIES = "SELECT 'mem/' || c_custkey || '.md' AS source, c_custkey || '.md' AS file, length(c_name)::BIGINT AS bytes, 1706659200.0::DOUBLE - c_custkey * 86400 / 2 AS mtime FROM customer"


def memories(spark, d):
    return table(spark, d, "customer").select(F.format_string("mem/%d.md", "c_custkey").alias("source"), F.format_string("%d.md", "c_custkey").alias("file"), F.length("c_name").cast("long").alias("bytes"), (F.lit(NOW) - F.col("c_custkey") * 86400 / 2).alias("mtime"))


@query(f"""WITH m AS ({MEMORIES}), c AS ({CITED}), b AS (SELECT 'mem/' || doc_id || '.md' AS source, count(*) AS corrections FROM labels WHERE quality = 0 GROUP BY doc_id)
SELECT file, bytes, round(greatest(0, (1706659200 - mtime) / 86400), 1) AS age_days, coalesce(count, 0) AS citations, coalesce(corrections, 0) AS corrections, coalesce(queries, '') AS recent,
CASE WHEN coalesce(corrections, 0) > 0 THEN 'corrected' ELSE '' END || CASE WHEN corrections > 0 AND coalesce(count, 0) = 0 AND (1706659200 - mtime) / 86400 >= 30 THEN ',' ELSE '' END || CASE WHEN coalesce(count, 0) = 0 AND (1706659200 - mtime) / 86400 >= 30 THEN 'never-cited' ELSE '' END AS flags
FROM m LEFT JOIN c USING (source) LEFT JOIN b USING (source)""")
def memory_health(spark, d):
    bad = table(spark, d, "labels").select(F.format_string("mem/%d.md::0", "doc_id").alias("chunk_id"), F.when(F.col("quality") == 0, "bad").otherwise("good").alias("verdict"))
    h = logs.memory_health(memories(spark, d), logs.citations(ledger(spark, d)), logs.corrections(bad), NOW)
    return h.select("file", "bytes", "age_days", "citations", "corrections", F.array_join("recent_queries", "|").alias("recent"), F.array_join("flags", ",").alias("flags"))


# ---- governance: every document is a note -------------------------------------

GOV = f"""SELECT doc_id || '.md' AS file, source || '/' || doc_id || '.md' AS source, doc_id::VARCHAR AS stem, lower(trim(substr(text, 1, 12))) AS title, sha1(text)[1:16] AS hash, {NOW}::DOUBLE - doc_id * 43200 AS mtime,
CASE WHEN doc_id % 40 = 0 THEN (doc_id + 37)::VARCHAR ELSE '' END AS superseded_by, CASE WHEN doc_id % 30 = 0 THEN (doc_id * 2)::VARCHAR ELSE '' END AS supersedes FROM documents"""


def notes(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        F.format_string("%d.md", i).alias("file"),
        F.format_string("%s/%d.md", "source", i).alias("source"),
        i.cast("string").alias("stem"),
        F.lower(F.trim(F.substring("text", 1, 12))).alias("title"),
        T.chunk_hash(F.col("text")).alias("hash"),
        (F.lit(NOW) - i * 43200).alias("mtime"),
        F.when(i % 40 == 0, T.stem(F.format_string("[[%d.md|new]]", i + 37))).otherwise("").alias("superseded_by"),
        F.when(i % 30 == 0, (i * 2).cast("string")).otherwise("").alias("supersedes"),
    )


def cited(spark, d):
    return notes(spark, d).where("CAST(stem AS BIGINT) % 3 = 0").select("source", F.lit(1).alias("count"))


@query(f"WITH n AS ({GOV}) SELECT a.file, a.superseded_by, EXISTS (FROM n b WHERE b.stem = a.superseded_by) AS target_exists FROM n a WHERE a.superseded_by <> ''")
def gov_superseded_live(spark, d):
    return governance.superseded_live(notes(spark, d))


@query(f"WITH n AS ({GOV}) SELECT file, supersedes AS references FROM n a WHERE supersedes <> '' AND NOT EXISTS (FROM n b WHERE b.stem = a.supersedes)")
def gov_dangling(spark, d):
    return governance.dangling(notes(spark, d))


@query(f"WITH n AS ({GOV}) SELECT title, array_to_string(list_sort(list(file)), ',') AS files FROM n GROUP BY title HAVING count(*) > 1 AND count(DISTINCT hash) > 1")
def gov_duplicate_truth(spark, d):
    return governance.duplicate_truth(notes(spark, d)).select("title", F.array_join("files", ",").alias("files"))


@query(f"WITH n AS ({GOV}) SELECT file, round(({NOW} - mtime) / 86400, 1) AS age_days FROM n WHERE ({NOW} - mtime) / 86400 > 180 AND stem::BIGINT % 3 <> 0")
def gov_stale(spark, d):
    return governance.stale(notes(spark, d), cited(spark, d), NOW)


@query(f"""WITH n AS ({GOV}), f AS (SELECT 'superseded_live' AS category FROM n WHERE superseded_by <> '' UNION ALL SELECT 'dangling' FROM n a WHERE supersedes <> '' AND NOT EXISTS (FROM n b WHERE b.stem = a.supersedes)
UNION ALL SELECT 'stale' FROM n WHERE ({NOW} - mtime) / 86400 > 180 AND stem::BIGINT % 3 <> 0 UNION ALL SELECT 'duplicate_truth' FROM (SELECT title FROM n GROUP BY title HAVING count(*) > 1 AND count(DISTINCT hash) > 1))
SELECT category, count(*) AS n, least(20, count(*)) AS shown FROM f GROUP BY category""")
def gov_report(spark, d):
    r = governance.report(governance.scan(notes(spark, d), cited(spark, d), NOW))
    return r.groupBy("category").agg(F.max("n").alias("n"), F.count("*").alias("shown"))


# ---- dashboard ----------------------------------------------------------------


@query(f"""WITH log AS ({LOG}) SELECT span, count(*) AS total, count_if(kind = 'search')::BIGINT AS searches, count_if(kind <> 'search')::BIGINT AS asks, round(avg(hits), 1) AS avg_hits, round(100 * count_if(hits = 0) / count(*))::BIGINT AS zero_pct, round(100 * count_if(hits = 0) / count(*)) >= 30 AS warn
FROM log JOIN (VALUES ('today', '2024-01-30'), ('7d', '2024-01-24'), ('30d', '2024-01-01'), ('all', '')) v(span, first) ON ts[1:10] >= first GROUP BY span""")
def dashboard_cards(spark, d):
    return logs.cards_by_span(log(spark, d), TODAY)


@query(f"WITH log AS ({LOG}) SELECT lower(trim(query)) AS query, count(*) AS n, sum(hits)::BIGINT AS hits FROM log GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8")
def top_queries(spark, d):
    return logs.top_queries(log(spark, d))


@query(f"WITH log AS ({LOG}) SELECT trim(query) AS query, max(ts) AS ts FROM log WHERE hits = 0 GROUP BY 1 ORDER BY ts DESC, 1 LIMIT 8")
def zero_hit_queries(spark, d):
    return logs.zero_hit_queries(log(spark, d))


@query(f"WITH log AS ({LOG}), c AS (SELECT (DATE '2024-02-01' - i::INT)::DATE AS day FROM range(14) t(i)) SELECT strftime(day, '%Y-%m-%d') AS day, count(log.ts) AS n FROM c LEFT JOIN log ON log.ts[1:10] = strftime(day, '%Y-%m-%d') GROUP BY day")
def activity_14d(spark, d):
    """Up to two days after the log's last row."""
    return logs.activity(log(spark, d), "2024-02-01").select(F.col("day").cast("string").alias("day"), "n")


@query(f"WITH log AS ({LOG}) SELECT CASE WHEN label = '' THEN 'local' ELSE label END AS agent, count(*) AS n FROM log GROUP BY 1")
def agent_counts(spark, d):
    return logs.agents(log(spark, d))


FOLDERS = f"SELECT *, CASE WHEN top = '' THEN '(no source)' WHEN top LIKE 'top%' THEN '/' ELSE regexp_extract(top, '^(.*)/[^/]*$', 1) END AS folder FROM ({LOG})"


@query(f"SELECT folder, count(*) AS n, max(ts) AS ts, arg_max(query, (ts, ord)) AS query FROM ({FOLDERS}) GROUP BY folder")
def session_groups(spark, d):
    return logs.sessions(log(spark, d))


@query(f"SELECT folder, ord, nth FROM (SELECT folder, ord, row_number() OVER (PARTITION BY folder ORDER BY ts DESC, ord DESC) AS nth FROM ({FOLDERS})) WHERE nth BETWEEN 51 AND 100")
def session_page(spark, d):
    return logs.session_page(log(spark, d), 1).select("folder", "ord", "nth")


@query(f"SELECT ord, query FROM ({LOG}) WHERE contains(lower(query || chr(1) || top || chr(1) || label || chr(1) || kind || chr(1) || role), 'q12') AND label = 'agent 5'")
def session_filter(spark, d):
    return logs.matching(log(spark, d), " Q12 ", "agent 5").select("ord", "query")


@query(f"SELECT ord, ts FROM ({LOG}) ORDER BY ts DESC, ord DESC LIMIT 500")
def recent_log(spark, d):
    return logs.recent(log(spark, d), 9999, "ts", "ord").select("ord", "ts")


@query("SELECT CASE WHEN c_mktsegment LIKE 'A%' THEN 'a' ELSE 'b' END || '-' || c_nationkey AS type, c_custkey::VARCHAR AS key, (c_custkey % 10)::DOUBLE AS mtime FROM customer WHERE c_mktsegment LIKE 'A%' ORDER BY mtime DESC, type, key LIMIT 50")
def state_list(spark, d):
    """Newest first, ties by type and key; one type prefix, 50 rows."""
    rows = table(spark, d, "customer").select(F.format_string("%s-%d", F.when(F.col("c_mktsegment").startswith("A"), "a").otherwise("b"), "c_nationkey").alias("type"), F.col("c_custkey").cast("string").alias("key"), (F.col("c_custkey") % 10).cast("double").alias("mtime"))
    return logs.state_records(rows, "a", 50)


@query(f"SELECT query_id, source FROM (SELECT DISTINCT 0::BIGINT AS query_id, 'mem/' || user_id || '.md' AS source FROM events WHERE event_type = 'view')")
def citation_ledger(spark, d):
    """Hits on memories, once for each source."""
    e = table(spark, d, "events")
    hits = e.select(F.lit(0).alias("query_id"), F.format_string("mem/%d.md", "user_id").alias("source"), F.when(F.col("event_type") == "view", "x, Memory").otherwise("memory-like").alias("tags"), F.col("event_id").alias("rank"))
    return logs.ledger_rows(hits)


@query(r"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}|[\x{4e00}-\x{9fff}]{2,4}'))) AS term FROM documents)
SELECT term, count(*) AS chunks FROM w WHERE NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ('the', 'of', 'and') GROUP BY term HAVING count(*) >= 4 ORDER BY chunks DESC, term LIMIT 8""")
def wiki_topics(spark, d):
    return topics.suggested(table(spark, d, "documents"), spark.createDataFrame([("the",), ("of",), ("and",)], "slug string"))


DIGEST = """WITH f AS (SELECT source AS owner, doc_id || '.md' AS name, '### ' || doc_id || '.md' || chr(10) || substr(trim(text, E' \\n\\t\\r'), 1, 700) || chr(10) || chr(10) AS part, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS nth FROM documents),
s AS (SELECT *, sum(length(part)) OVER (PARTITION BY owner ORDER BY nth)::BIGINT - length(part) AS spent FROM f)
SELECT owner, nth, name, length(substr(part, 1, (14000 - spent)::INT))::BIGINT AS n, md5(substr(part, 1, (14000 - spent)::INT)) AS digest FROM s WHERE spent < 14000"""


@query(DIGEST)
def digest_budget(spark, d):
    files = table(spark, d, "documents").select(F.col("source").alias("owner"), F.format_string("%d.md", "doc_id").alias("name"), "text", F.col("doc_id").alias("mtime"), F.col("doc_id").alias("path"))
    return topics.digest(files).select("owner", "nth", "name", F.length("part").alias("n"), F.md5(F.col("part").cast("binary")).alias("digest"))


FINGER = "SELECT source AS owner, sha1(string_agg(doc_id || '.md:' || sha1(text), chr(10) ORDER BY source || '/' || doc_id || '.md'))[1:16] AS fingerprint FROM documents GROUP BY source"


def contents(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("owner"), F.format_string("%s/%d.md", "source", "doc_id").alias("path"), F.format_string("%d.md", "doc_id").alias("name"), F.col("text").alias("content"))


@query(FINGER)
def content_fingerprint(spark, d):
    return topics.fingerprints(contents(spark, d))


@query(f"SELECT owner, CASE WHEN owner LIKE 'src1%' THEN 'stale' WHEN owner LIKE 'src%5' THEN 'missing' ELSE 'fresh' END AS status FROM ({FINGER})")
def digest_freshness(spark, d):
    now = topics.fingerprints(contents(spark, d))
    stored = now.where("owner LIKE 'src1%' OR owner NOT LIKE 'src%5'").withColumn("fingerprint", F.when(F.col("owner").startswith("src1"), "other").otherwise(F.col("fingerprint")))
    return topics.freshness(now, stored)


@query("""SELECT source AS owner, count(*) AS files, sum(strlen(text))::BIGINT AS chars, max(doc_id)::DOUBLE AS last_updated, sum(doc_id % 3)::BIGINT AS chunks, CASE WHEN source LIKE 'src1%' THEN 'fresh' ELSE 'missing' END AS status, CASE WHEN source = 'src2' THEN '/no' ELSE '' END AS missing_roots FROM documents GROUP BY source""")
def harness_stats(spark, d):
    """The folders of the notes as tools' memories, some with a stored digest, one with a root that is missing."""
    own = contents(spark, d).join(table(spark, d, "documents").select(F.format_string("%s/%d.md", "source", "doc_id").alias("path"), F.col("doc_id").cast("double").alias("mtime"), F.octet_length("text").alias("size")), "path")
    owners = [r.owner for r in own.select("owner").distinct().collect()]
    names = spark.createDataFrame([(o, ["/no"] if o == "src2" else []) for o in owners], "owner string, missing_roots array<string>")
    counts = table(spark, d, "documents").select(F.format_string("%s/%d.md", "source", "doc_id").alias("source"), (F.col("doc_id") % 3).alias("chunks"))
    stored = topics.fingerprints(own).where("owner LIKE 'src1%'")
    return harness.summed(names, own, [(o, f"{o}/") for o in owners], counts, stored).withColumn("missing_roots", F.array_join("missing_roots", ","))


_ = TOKENS
