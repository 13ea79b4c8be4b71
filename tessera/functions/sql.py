"""The text functions under names of their own in SQL.

`register(spark)` makes temporary SQL functions (`tessera_tokens(text)`, ...) from the same column
expressions that DataFrames use, and the table function `tessera_chunks(text, size, overlap[, plain])`,
which stands in FROM with LATERAL; where plain holds, a text is no Markdown.  They are inlined by Catalyst: no Python, nothing hidden
from the optimizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking

#: SQL name, by function of one text.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "tokens": T.tokens,
    "tokens_hyphen_join": T.tokens_hyphen_join,
    "tokens_cjk_bigram": T.tokens_cjk_bigram,
    "tokens_identifier": T.tokens_identifier,
    "identifier_terms": T.identifier_terms,
    "wikilinks": T.wikilinks,
    "front_matter": T.front_matter,
    "body": T.body,
    "file_title": T.file_title,
    "file_hash": T.file_hash,
    "chunk_hash": T.chunk_hash,
    "stem": T.stem,
    "slug": T.slug,
    "folded_path": T.folded_path,
    "may_be_markdown": chunking.may_be_markdown,
}
_PARTS = re.compile(r"('(?:[^'\\]|\\.|'')*')", re.S)
_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|==|!=|[=<>!+\-*/%]|\b(?:and|or|not)\b)(?=\()")


def sql_of(column: Column) -> str:
    """A column of built-in functions as SQL text; operators are called by their names."""
    parts = _PARTS.split(column._jc.node().sql())
    return "".join(p if k % 2 else _OPERATOR.sub(lambda m: f"`{m[1]}`", p) for k, p in enumerate(parts))


def register(spark: SparkSession, prefix: str = "tessera_") -> list[str]:
    """Make the functions known to a session; their names."""
    for name, f in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(given STRING) RETURN {sql_of(f(F.col('given')))}")
    cut = sql_of(chunking.split(F.col("given"), F.col("size"), F.col("overlap"), F.col("plain")))
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}chunks(given STRING, size INT, overlap INT, plain BOOLEAN DEFAULT false) "
        f"RETURNS TABLE (chunk INT, text STRING, section STRING) RETURN SELECT pos, c.text, c.section FROM (SELECT posexplode({cut}) AS (pos, c))"
    )
    return [*(f"{prefix}{n}" for n in FUNCTIONS), f"{prefix}chunks"]
