"""Link graph, entities, supersession."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import knowledge, links, supersession
from tessera.plans.catalog import query, table

EDGES = "SELECT 'Supplier ' || l_suppkey AS s, 'ships' AS p, 'Part ' || l_partkey AS o, 'order ' || l_orderkey AS source FROM lineitem"


def edges(spark, d):
    return table(spark, d, "lineitem").select(F.format_string("Supplier %d", "l_suppkey").alias("s"), F.lit("ships").alias("p"), F.format_string("Part %d", "l_partkey").alias("o"), F.format_string("order %d", "l_orderkey").alias("source"))


@query(f"WITH e AS ({EDGES}), x AS (SELECT s AS name, source FROM e UNION ALL SELECT o, source FROM e) SELECT name, count(*) AS degree, array_to_string(list_sort(list_distinct(list(source)))[1:5], ',') AS sources FROM x GROUP BY name")
def entity_degree(spark, d):
    return knowledge.entities(edges(spark, d)).select("name", "degree", F.array_join("sources", ",").alias("sources"))


@query(f"WITH e AS ({EDGES}) SELECT s, p, o, source, 'in' AS direction FROM e WHERE lower(o) = 'part 1' UNION ALL SELECT s, p, o, source, 'out' FROM e WHERE lower(s) = 'part 1'")
def graph_neighbors(spark, d):
    return knowledge.neighbours(edges(spark, d), " PART 1 ")


@query(f"WITH e AS ({EDGES}), x AS (SELECT s AS name FROM e UNION ALL SELECT o FROM e) SELECT name, count(*) AS degree FROM x GROUP BY name ORDER BY degree DESC, name LIMIT 10")
def hub_top10(spark, d):
    return knowledge.hubs(knowledge.entities(edges(spark, d)))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS s, 'in' AS p, 'region ' || n_regionkey AS o FROM nation")
def triples_parse(spark, d):
    """Replies with fences, prose, short and blank triples around one good one."""
    reply = F.format_string('Sure:\n```json\n[["%s", " in ", "region %d"], ["a", "b"], ["", "x", "y"]]\n```', "n_name", "n_regionkey")
    t = table(spark, d, "nation").select("n_nationkey", F.explode(knowledge.triples_of(reply)).alias("t"))
    return t.select("n_nationkey", "t.s", "t.p", "t.o")


@query(f"WITH e AS ({EDGES}) SELECT s, o, source, CASE WHEN substr(source, 7)::BIGINT % 5 = 0 THEN 'fresh' ELSE 'kept' END AS state FROM e WHERE substr(source, 7)::BIGINT % 7 <> 0 OR substr(source, 7)::BIGINT % 5 = 0 ")
def graph_rebuild(spark, d):
    """Orders divisible by 5 changed, those by 7 (and not by 5) vanished."""
    e = edges(spark, d).withColumn("state", F.lit("kept"))
    n = F.substring("source", 7, 20).cast("long")
    files = e.select("source").distinct().where((n % 7 != 0) | (n % 5 == 0)).withColumn("hash", F.when(n % 5 == 0, "new").otherwise("old"))
    processed = e.select("source").distinct().withColumn("hash", F.lit("old"))
    fresh = lambda changed: edges(spark, d).join(changed.select("source"), "source").withColumn("state", F.lit("fresh")).select(e.columns)
    after, _ = knowledge.rebuild(e, processed, files, fresh)
    return after.select("s", "o", "source", "state")


# ---- notes: nations, regions and suppliers that link to them ------------------

NOTES = "SELECT 'nations/' || n_name || '.md' AS source FROM nation UNION ALL SELECT 'regions/' || r_name || '.md' FROM region UNION ALL SELECT 'old/nations/' || n_name || '.md' FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'suppliers/' || s_suppkey || '.md' FROM supplier"
LINKS = """SELECT 'suppliers/' || s_suppkey || '.md' AS source, unnest([n_name, 'Nations/' || n_name, 'missing ' || s_suppkey, 'regions/' || r_name || '.md', 'suppliers/' || s_suppkey]) AS target
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def notes(spark, d):
    nation = table(spark, d, "nation")
    return (
        nation.select(F.format_string("nations/%s.md", "n_name").alias("source"))
        .unionByName(table(spark, d, "region").select(F.format_string("regions/%s.md", "r_name").alias("source")))
        .unionByName(nation.where("n_nationkey % 4 = 0").select(F.format_string("old/nations/%s.md", "n_name").alias("source")))
        .unionByName(table(spark, d, "supplier").select(F.format_string("suppliers/%d.md", "s_suppkey").alias("source")))
    )


def mapped(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    made = F.format_string("%s,Nations/%s,missing %d,regions/%s.md,suppliers/%d", "n_name", "n_name", "s_suppkey", "r_name", "s_suppkey")
    rows = s.select(F.format_string("suppliers/%d.md", "s_suppkey").alias("source"), made.alias("links"))
    return links.link_map(rows.withColumn("chunk", F.lit(0)).unionByName(rows.select("source", F.lit("later").alias("links"), F.lit(1).alias("chunk"))))


@query(f"SELECT source, target FROM ({LINKS})")
def link_map(spark, d):
    return links.exploded(mapped(spark, d))


@query(f"WITH n AS ({NOTES}), l AS ({LINKS}), s AS (SELECT source AS note, lower(regexp_replace(regexp_extract(source, '[^/]*$'), '\\.md$', '')) AS stem FROM n) SELECT DISTINCT note, l.source FROM l JOIN s ON lower(l.target) = stem WHERE l.source <> note")
def backlinks(spark, d):
    return links.backlinks(links.exploded(mapped(spark, d)), notes(spark, d))


@query(f"WITH n AS ({NOTES}), l AS ({LINKS}), s AS (SELECT source AS note, lower(regexp_replace(regexp_extract(source, '[^/]*$'), '\\.md$', '')) AS stem FROM n) SELECT note, count(*) AS n FROM l JOIN s ON regexp_replace(lower(regexp_extract(l.target, '[^/]*$')), '\\.md$', '') = stem WHERE l.source <> note GROUP BY note")
def backlink_counts(spark, d):
    return links.backlink_counts(links.exploded(mapped(spark, d)), notes(spark, d))


@query(f"""WITH n AS ({NOTES}), l AS ({LINKS}), p AS (SELECT source AS note, string_split(regexp_replace(lower(source), '\\.md$', ''), '/') AS a FROM n),
k AS (SELECT key, count(*) AS c, min(note) AS note FROM (SELECT note, unnest(list_transform(range(1, len(a) + 1), lambda i: array_to_string(a[i:], '/'))) AS key FROM p) GROUP BY key),
r AS (SELECT l.source, l.target, coalesce(x.source, k.note) AS note FROM l LEFT JOIN n x ON x.source = l.target LEFT JOIN k ON k.c = 1 AND k.key = regexp_replace(lower(l.target), '\\.md$', ''))
SELECT source, target, note, note IS NULL AS ghost FROM r WHERE note IS NULL OR note <> source""")
def link_resolution(spark, d):
    return links.resolved(links.exploded(mapped(spark, d)), notes(spark, d))


@query(f"WITH n AS ({NOTES}), p AS (SELECT source, string_split(regexp_replace(source, '\\.md$', ''), '/') AS a FROM n) SELECT source, CASE WHEN count(*) OVER (PARTITION BY a[-1]) > 1 AND len(a) > 1 THEN a[-2] || '/' || a[-1] ELSE a[-1] END AS label FROM p")
def label_disambiguation(spark, d):
    return links.labels(notes(spark, d))


# ---- supersession: the orders of a customer, one after another ----------------

CHAIN = "SELECT 'order-' || o_orderkey AS stem, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"


def decisions(spark, d):
    from pyspark.sql import Window as W

    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ord"),
        F.format_string("order-%d", "o_orderkey").alias("stem"),
        F.format_string("orders/order-%d.md", "o_orderkey").alias("path"),
        F.coalesce(F.lag(F.format_string("order-%d", "o_orderkey")).over(by), F.lit("")).alias("supersedes"),
        F.lit("").alias("superseded_by"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective"),
        F.row_number().over(by).alias("k"),
    )


@query(f"WITH c AS ({CHAIN}) SELECT a.stem, coalesce(b.stem, '') AS supersedes, coalesce(n.stem, '') AS superseded_by, a.day AS effective FROM c a LEFT JOIN c b ON b.o_custkey = a.o_custkey AND b.k = a.k - 1 LEFT JOIN c n ON n.o_custkey = a.o_custkey AND n.k = a.k + 1")
def supersede_collect(spark, d):
    return supersession.collect(decisions(spark, d)).select("stem", "supersedes", "superseded_by", "effective")


@query(f"WITH c AS ({CHAIN}), s AS (SELECT o_custkey, stem AS start FROM c WHERE k = 2) SELECT start, k - 1 AS pos, stem, day AS effective FROM c JOIN s USING (o_custkey)")
def supersede_chain(spark, d):
    """Whole lines, walked from each customer's second order."""
    t = decisions(spark, d)
    return supersession.chains(supersession.collect(t), t.where("k = 2").select("stem"))


@query(f"WITH c AS ({CHAIN}), s AS (SELECT o_custkey, stem AS start FROM c WHERE k = 1) SELECT start, arg_max(stem, k) AS current, count(*) AS length FROM c JOIN s USING (o_custkey) GROUP BY start")
def supersede_current(spark, d):
    t = decisions(spark, d)
    return supersession.current(supersession.chains(supersession.collect(t), t.where("k = 1").select("stem")))


@query(f"WITH c AS ({CHAIN}) SELECT a.stem || '.md' AS source, n.stem AS superseded_by FROM c a LEFT JOIN c n ON n.o_custkey = a.o_custkey AND n.k = a.k + 1")
def supersede_annotate(spark, d):
    t = decisions(spark, d)
    return supersession.annotate(t.select(F.concat("stem", F.lit(".md")).alias("source")), supersession.collect(t)).select("source", "superseded_by")
