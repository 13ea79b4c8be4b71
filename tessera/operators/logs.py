"""Analytics over the engine's own logs: quality, citations, memory health, dashboard, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.scratch import durable

# Windows, caps and what counts as drift or as stale.
QUALITY_WINDOW, P95_LEAST = 200, 20
ZERO_HIT_RISE, BAD_RATE_RISE, HITS_DROP, FEEDBACK_LEAST = 0.10, 0.08, -1.0, 10
STALE_DAYS, RECENT_QUERIES, RING, TOP, DAYS, ZERO_WARN, PAGE = 30, 3, 500, 8, 14, 30, 50


def recent(log: DataFrame, n: int, *order: str) -> DataFrame:
    """The n last rows, 1 to RING of them."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(max(1, min(n, RING)))


def p95_exclusive(values: Column) -> Column:
    """The last of 19 cut points that divide the values into 20 parts, by the exclusive
    method; null for fewer than 20 values."""
    s, n = F.sort_array(values), F.size(values)
    at = F.least(F.greatest((F.lit(19) * (n + 1) / 20).cast("int"), F.lit(1)), n - 1)
    share = F.lit(19) * (n + 1) - at * 20
    cut = (F.element_at(s, at) * (20 - share) + F.element_at(s, at + 1) * share) / 20
    return F.when(n >= P95_LEAST, cut)


def values_at(rows: DataFrame, key: str, value: str, ranks: DataFrame) -> DataFrame:
    """(key, rank, value): the values at given ranks (key, rank from 1) of each key's values in order.

    Equal values are counted first; what is left is dealt out by ranges of key and value, so a
    key with most of the rows lies in many parts.  Sums by part say which part has a rank,
    and only within such parts is there an order to go through: no task has a whole key.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    parts = durable(counted.repartitionByRange(key, value).withColumn("_part", F.spark_partition_id()), "ranges")
    upto = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = parts.groupBy(key, "_part").agg(F.sum("n").alias("_n")).withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    wanted = sums.join(ranks, key).where((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_n"))).select(key, "_part", "_before", "rank")
    within = W.partitionBy(key, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    there = parts.join(wanted.select(key, "_part").distinct(), [key, "_part"], "left_semi").withColumn("_upto", F.sum("n").over(within))
    at = F.col("rank") - F.col("_before")
    return there.join(wanted, [key, "_part"]).where((at <= F.col("_upto")) & (at > F.col("_upto") - F.col("n"))).select(key, "rank", value)


def p95_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, p95) as p95_exclusive() has it, from the two ranks that it needs."""
    n = rows.groupBy(key).agg(F.count(value).alias("n")).withColumn("at", F.least(F.greatest((F.lit(19) * (F.col("n") + 1) / 20).cast("int"), F.lit(1)), F.col("n") - 1))
    ranks = n.where(F.col("n") >= P95_LEAST).select(key, F.explode(F.array("at", F.col("at") + 1)).alias("rank"))
    two = values_at(rows, key, value, ranks).join(n, key)
    share = F.lit(19) * (F.col("n") + 1) - F.col("at") * 20
    cut = two.groupBy(key).agg(F.sum(F.col(value) * F.when(F.col("rank") == F.col("at"), 20 - share).otherwise(share) / 20).alias("p95"))
    return n.select(key).join(cut, key, "left").select(key, "p95")


def quality_snapshot(queries: DataFrame, feedback: DataFrame, window: int = QUALITY_WINDOW, order: str = "ord") -> DataFrame:
    """One row about the last `window` queries (hits, ms) and all feedback (verdict)."""
    last = queries.orderBy(F.desc(order)).limit(window)
    hits, ms = F.coalesce("hits", F.lit(0)), F.coalesce("ms", F.lit(0.0))
    q = last.agg(
        F.count("*").alias("queries"),
        F.count_if(hits == 0).alias("zero"),
        F.avg(hits).alias("avg_hits"),
        F.avg(ms).alias("avg_ms"),
        F.collect_list(ms).alias("all_ms"),
    )
    f = feedback.agg(F.count("*").alias("feedback_total"), F.count_if(F.col("verdict") == "bad").alias("bad"), F.count_if(F.col("verdict") == "good").alias("good"))
    share = lambda a, b, d: F.coalesce(F.round(F.try_divide(a, b), d), F.lit(0.0))
    rated = F.col("bad") + F.col("good")
    return q.join(f, how="cross").select(
        "queries",
        share(F.col("zero"), F.col("queries"), 4).alias("zero_hit_rate"),
        F.coalesce(F.round("avg_hits", 2), F.lit(0.0)).alias("avg_hits"),
        F.coalesce(F.round("avg_ms", 1), F.lit(0.0)).alias("avg_ms"),
        F.round(p95_exclusive(F.col("all_ms")), 1).alias("p95_ms"),
        "feedback_total",
        share(F.col("bad"), rated, 4).alias("bad_rate"),
        share(rated, F.col("queries"), 4).alias("feedback_coverage"),
    )


def drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(kind, severity): alerts of one snapshot against another, critical first; none without a baseline."""
    c, b = (s.select(*[F.col(x).alias(f"{p}_{x}") for x in ("zero_hit_rate", "bad_rate", "avg_hits", "feedback_total")]) for s, p in ((current, "c"), (baseline, "b")))
    worse = F.col("c_bad_rate") - F.col("b_bad_rate") >= BAD_RATE_RISE
    rules = [
        ("feedback_degradation", "critical", worse & (F.col("c_feedback_total") >= FEEDBACK_LEAST)),
        ("stale_truth", "critical", worse & (F.col("c_zero_hit_rate") <= F.col("b_zero_hit_rate"))),
        ("zero_hit_spike", "warning", F.col("c_zero_hit_rate") - F.col("b_zero_hit_rate") >= ZERO_HIT_RISE),
        ("fewer_hits", "warning", F.col("c_avg_hits") - F.col("b_avg_hits") <= HITS_DROP),
    ]
    fired = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("kind"), F.lit(s).alias("severity"), r.alias("on")) for i, (k, s, r) in enumerate(rules)])
    return c.join(b, how="cross").select(F.inline(F.filter(fired, lambda x: x["on"]))).select("pos", "kind", "severity").orderBy("pos")


def ledger_rows(hits: DataFrame, tag: str = "memory") -> DataFrame:
    """(query_id, source): each memory that a query used, once, for the citation ledger."""
    mine = F.array_contains(F.transform(F.split("tags", ","), lambda x: F.lower(F.trim(x))), tag)
    return hits.where(mine).groupBy("query_id", "source").agg(F.min("rank").alias("rank")).drop("rank")


def citations(ledger: DataFrame) -> DataFrame:
    """(source, count, last_ts, queries): the queries are the last three, in order of (ts, ord)."""
    mine = ledger.where("source <> ''")
    nth = F.row_number().over(W.partitionBy("source").orderBy(F.desc("ts"), F.desc("ord")))
    last = mine.where(F.coalesce("query", F.lit("")) != "").withColumn("nth", nth).where(F.col("nth") <= RECENT_QUERIES)
    asked = last.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("nth")).alias("k"), "query"))), lambda x: x.query).alias("queries"))
    counts = mine.groupBy("source").agg(F.count("*").alias("count"), F.max("ts").alias("last_ts"))
    return counts.join(asked, "source", "left").select("source", "count", "last_ts", F.coalesce("queries", F.expr("CAST(array() AS array<string>)")).alias("queries"))


def corrections(feedback: DataFrame) -> DataFrame:
    """(source, corrections): bad ratings by the source of their chunk id."""
    source = F.regexp_replace("chunk_id", r"(?s)::(?!.*::).*$", "")
    return feedback.where("verdict = 'bad'").select(source.alias("source")).where("source <> ''").groupBy("source").agg(F.count("*").alias("corrections"))


def memory_health(notes: DataFrame, cited: DataFrame, corrected: DataFrame, now: float) -> DataFrame:
    """One row for each note (source, file, bytes, mtime): use, decay and flags, most used first."""
    days = lambda t: F.round((F.lit(now) - t) / 86400, 1)
    n, bad = F.coalesce("count", F.lit(0)), F.coalesce("corrections", F.lit(0))
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("mtime")) / 86400)
    flags = F.array_compact(F.array(F.when(bad > 0, "corrected"), F.when((n == 0) & (age >= STALE_DAYS), "never-cited")))
    out = notes.join(cited, "source", "left").join(corrected, "source", "left")
    return out.select(
        "file",
        "bytes",
        F.round(age, 1).alias("age_days"),
        n.alias("citations"),
        F.when(F.col("last_ts") > 0, days(F.col("last_ts"))).alias("last_cited_days_ago"),
        bad.alias("corrections"),
        F.coalesce("queries", F.expr("CAST(array() AS array<string>)")).alias("recent_queries"),
        flags.alias("flags"),
    ).orderBy(F.desc("citations"), F.desc("corrections"), "file")


# ---- dashboard and sessions ---------------------------------------------------


def in_range(ts: Column, span: str, today: str) -> Column:
    """ts lies in span (today, 7d, 30d or all) up to the day `today`."""
    back = {"today": 0, "7d": 6, "30d": 29}.get(span)
    if back is None:
        return F.lit(True)
    day, end = F.to_date(ts), F.to_date(F.lit(today))
    return day == end if back == 0 else day >= F.date_sub(end, back)


SPANS = ("today", "7d", "30d", "all")


def cards(log: DataFrame, by: str | None = None) -> DataFrame:
    """One row (for each value of by): total, searches, asks, avg_hits, zero_pct, warn."""
    hits = F.coalesce("hits", F.lit(0))
    zero = F.coalesce(F.round(100 * F.try_divide(F.count_if(hits == 0), F.count("*"))).cast("long"), F.lit(0))
    grouped = log.groupBy(by) if by else log.groupBy()
    return grouped.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("kind") == "search").alias("searches"),
        (F.count("*") - F.count_if(F.col("kind") == "search")).alias("asks"),
        F.coalesce(F.round(F.avg(hits), 1), F.lit(0.0)).alias("avg_hits"),
        zero.alias("zero_pct"),
        (zero >= ZERO_WARN).alias("warn"),
    )


def cards_by_span(log: DataFrame, today: str) -> DataFrame:
    """(span, cards) of all spans in one pass; a span without rows has none."""
    spans = F.array_compact(F.array(*[F.when(in_range(F.col("ts"), s, today), F.lit(s)) for s in SPANS]))
    return cards(log.select("ts", "kind", "hits", F.explode(spans).alias("span")), "span")


def top_queries(log: DataFrame, n: int = TOP) -> DataFrame:
    q = F.lower(F.trim("query"))
    return log.where(q != "").groupBy(q.alias("query")).agg(F.count("*").alias("n"), F.sum(F.coalesce("hits", F.lit(0))).alias("hits")).orderBy(F.desc("n"), "query").limit(n)


def zero_hit_queries(log: DataFrame, n: int = TOP) -> DataFrame:
    """The n different queries without hits that were asked last."""
    q = F.trim("query")
    return log.where((F.coalesce("hits", F.lit(0)) <= 0) & (q != "")).groupBy(q.alias("query")).agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "query").limit(n)


def activity(log: DataFrame, today: str, days: int = DAYS) -> DataFrame:
    """(day, n) of the last days, also those without a row."""
    spark, end = log.sparkSession, F.to_date(F.lit(today))
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    counts = log.where(F.to_date("ts").between(F.date_sub(end, days - 1), end)).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def agents(log: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("label", F.lit("")), F.lit("local"))
    return log.groupBy(name.alias("agent")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "agent")


def folder(top: Column) -> Column:
    """The folder of a log row's best source: (no source), / or the path."""
    path = F.trim(F.substring_index(F.coalesce(top, F.lit("")), " > ", 1))
    up = F.regexp_extract(path, r"^(.+)[/\\][^/\\]*$", 1)
    return F.when(path == "", "(no source)").when(up == "", "/").otherwise(up)


def sessions(log: DataFrame) -> DataFrame:
    """(folder, n, ts, query): log rows by folder with the last query, the latest folder first."""
    return log.groupBy(folder(F.col("top")).alias("folder")).agg(F.count("*").alias("n"), F.max("ts").alias("ts"), F.max_by("query", F.struct("ts", "ord")).alias("query")).orderBy(F.desc("ts"), "folder")


def session_page(log: DataFrame, page: int = 0, size: int = PAGE) -> DataFrame:
    """Rows page * size + 1 to (page + 1) * size of each folder, newest first."""
    n = F.row_number().over(W.partitionBy("folder").orderBy(F.desc("ts"), F.desc("ord")))
    rows = log.withColumn("folder", folder(F.col("top"))).withColumn("nth", n)
    return rows.where(F.col("nth").between(page * size + 1, (page + 1) * size))


def matching(log: DataFrame, needle: str, label: str | None = None) -> DataFrame:
    """Rows that contain a text in any of their words, and have a label."""
    low = needle.strip().lower()
    cond = F.exists(F.array("query", "top", "label", "kind", "role"), lambda x: F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lit(low))) if low else F.lit(True)
    return log.where(cond & ((F.col("label") == label) if label else F.lit(True)))


def state_records(rows: DataFrame, prefix: str = "", n: int | None = None) -> DataFrame:
    """State records (type, key, mtime, ...) of types that begin with a prefix, newest first, ties by type and key."""
    found = rows.where(F.col("type").startswith(prefix)).orderBy(F.desc("mtime"), "type", "key")
    return found.limit(n) if n is not None else found
