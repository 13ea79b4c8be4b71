"""SQL functions give what the column expressions they are made from give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sql
from tessera.operators import chunking


def test_functions_equal_their_columns(spark):
    names = sql.register(spark)
    assert len(names) == len(sql.FUNCTIONS) + 1
    texts = ["Hello user-id A1 [[x|y]] it's", None, "", "---\ntags: [a, 'b']\ntitle: \"T\\n\"\n---\n# Head > line\n全文检索 and v1.2", "a\\b/C d.md", "x != y <= (z) and (not) or"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    df.createOrReplaceTempView("texts_of_sql_functions")
    for name, f in sql.FUNCTIONS.items():
        mine = spark.sql(f"SELECT i, to_json(struct(tessera_{name}(t) AS r)) AS r FROM texts_of_sql_functions ORDER BY i").collect()
        theirs = df.select("i", F.to_json(F.struct(f(F.col("t")).alias("r"))).alias("r")).orderBy("i").collect()
        assert mine == theirs, name


def test_chunks_as_a_table_function(spark):
    sql.register(spark)
    docs = spark.createDataFrame([("a", "# A\n" + "word " * 60 + "\n```\n# no\n```\n## B\nend"), ("b", None), ("c", "short")], "path string, content string")
    docs.createOrReplaceTempView("docs_of_sql_functions")
    got = spark.sql("SELECT d.path, c.chunk, c.text, c.section FROM docs_of_sql_functions d, LATERAL tessera_chunks(d.content, 80, 20) c")
    want = chunking.chunks(docs, 80, 20).select("path", "chunk", "text", "section")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Nested" not in plan
