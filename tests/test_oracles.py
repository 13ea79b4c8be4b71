"""Every query with oracle SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    assert {c: KINDS[t] for c, t in df.dtypes} == {x[0]: str(x[1]) for x in found.description}
    order = sorted(names)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert ours == theirs


def test_queries_without_oracle_have_rows(spark, sf):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, sf).count() > 0


def test_no_python_where_catalyst_can_do_it(spark, sf):
    for name in ("bm25_topk", "hybrid_search", "chunk_windows", "frontmatter_meta", "link_resolution", "quality_snapshot", "supersede_chain", "chunk_breadcrumbs", "chunk_markdown_prose", "literal_channel"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_titles_with_open_references(spark, tmp_path):
    titles = ["a &amp;&amp", "&amp b &lt;c&gt; &quot;", "x & y &nbsp; &amp;lt; &#38; &lt", "plain"]
    spark.createDataFrame([(i, f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>text</p></body></html>") for i, t in enumerate(titles)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    theirs = c.execute(catalog.oracle_sql()["html_title"]).fetchall()
    assert sorted(map(tuple, catalog.queries()["html_title"](spark, str(tmp_path)).collect())) == sorted(theirs)


#: Texts that a reader of mark-up may change or drop, and their plain neighbours.
ODD = [None, "", "  \n ", "\n\na", "a\n\n\n", "a\r\nb", "a\rb\x0bc\x0cd", "a\x1cb\x85c d", "\xa0a　", "a\x1f", "* head\ntext", "  + item\n+", "*bold* #+ [x]", "[[a]] [[http://x.y][z]]", "#+TITLE: other\nb", "# h\ntext", "#h\n ```\n# code\n```\nend", "~~~\nopen",
       "x" * 1429, "x" * 1430, "x" * 1400 + "\n# h\n" + "y" * 900, "x" * 800 + " " * 900 + "y", "x" * 800 + " \xa0" * 450 + "y", "a　b\n\nc", "\r" + "x" * 1429, "# " + "t" * 1427, ("l" * 79 + "\r\n") * 30, "😀" * 900]


def held_against_sql(spark, folder, name, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = c.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(map(tuple, catalog.queries()[name](spark, folder).select(names).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_org_of_odd_texts_and_tags(spark, tmp_path):
    tags = [(None, "s"), ("en", None), ("", ""), ("a:b", " s"), ("x, y", "e\nn")]
    rows = [(i, t, "en", "src1") for i, t in enumerate(ODD)] + [(100 + i, "x", *t) for i, t in enumerate(tags)] + [(None, "x", "en", "s")]
    held_against_sql(spark, str(tmp_path), "org_to_md", rows)


@pytest.mark.parametrize("name", ["sql_chunks", "chunk_markdown_prose", "chunk_tail_merge"])
def test_chunks_of_odd_texts(spark, tmp_path, name):
    held_against_sql(spark, str(tmp_path), name, [(i, t, "en", "s") for i, t in enumerate(ODD)])
