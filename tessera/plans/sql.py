"""Pieces of oracle SQL that several queries share (DuckDB's dialect)."""

from __future__ import annotations

TOK = r"[a-z0-9]+|[\x{4e00}-\x{9fff}]"
TOKENS = f"regexp_extract_all(lower(text), '{TOK}')"
#: Queries of the search plans.
ASKED = {0: "the thand ering hation", 1: "anea example.com there is"}
QUERIES = "queries AS (SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{v}')" for k, v in ASKED.items()) + ") v(query_id, text))"

BM25 = f"""
toks AS (SELECT doc_id AS id, {TOKENS} AS toks FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM toks),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM toks) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS}) AS term FROM queries) GROUP BY ALL),
bm AS (SELECT query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
       FROM qt JOIN freq USING (term) JOIN post USING (term), stats GROUP BY query_id, id),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm)"""

HASHED = f"""
dt AS (SELECT id, count(*) AS n, b FROM (SELECT id, ('0x' || right(md5(t), 2))::INT % 128 AS b FROM (SELECT doc_id AS id, unnest(list_distinct({TOKENS})) AS t FROM documents)) GROUP BY id, b),
dv AS (SELECT id, b, n / sqrt(sum(n * n) OVER (PARTITION BY id)::DOUBLE) AS w FROM dt),
qn AS (SELECT query_id, count(*) AS n, b FROM (SELECT query_id, ('0x' || right(md5(t), 2))::INT % 128 AS b FROM (SELECT query_id, unnest(list_distinct({TOKENS})) AS t FROM queries)) GROUP BY query_id, b),
qv AS (SELECT query_id, b, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)::DOUBLE) AS w FROM qn),
vd AS (SELECT query_id, id, round(1 - sum(dv.w * qv.w), 9) AS distance FROM dv JOIN qv USING (b) GROUP BY query_id, id),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM vd)"""

LITERAL = r"""
terms AS (SELECT query_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-_.:/]{1,2}[A-Za-z0-9]+)+|[A-Za-z]*\d[A-Za-z0-9]*'), lambda x: trim(lower(x), '-_.:/')), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+'))) AS ts FROM queries),
lit AS (SELECT query_id, doc_id AS id, len(list_filter(ts, lambda t: contains(lower(text), t))) AS n FROM terms, documents WHERE len(ts) > 0)"""


def hybrid(fetch: int) -> str:
    """CTEs up to `fused`: the best `fetch` of each query with rank."""
    return f"""WITH {QUERIES}, {BM25}, {HASHED}, {LITERAL},
parts AS (
  SELECT query_id, id, 1::DOUBLE / (60 + rank) AS c, rank AS seen FROM vec WHERE rank <= {fetch}
  UNION ALL SELECT query_id, id, 1::DOUBLE / (60 + rank), rank + 1099511627776 FROM lex WHERE rank <= {fetch}
  UNION ALL SELECT query_id, id, n::DOUBLE, id + 4398046511104 FROM lit WHERE n > 0
), summed AS (SELECT query_id, id, sum(c) AS score, min(seen) AS seen FROM parts GROUP BY query_id, id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen) AS rank FROM summed) WHERE rank <= {fetch}),
notes AS (SELECT doc_id AS id, source || '/' || doc_id || '.md' AS source, text, lang || ',note' AS tags, 1700000000::DOUBLE + doc_id AS mtime FROM documents)"""


def hits(condition: str = "true", fetch: int = 20, k: int = 5) -> str:
    return f"""{hybrid(fetch)}
SELECT query_id, rank, doc_id, round(score, 6) AS score, round(distance, 4) AS distance FROM (
  SELECT f.query_id, f.id AS doc_id, f.score, v.distance, row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank) AS rank
  FROM fused f JOIN notes n ON n.id = f.id LEFT JOIN (SELECT * FROM vec WHERE rank <= {fetch}) v ON v.query_id = f.query_id AND v.id = f.id
  WHERE {condition}) WHERE rank <= {k}"""
