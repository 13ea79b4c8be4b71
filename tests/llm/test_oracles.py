"""Queries of the later operators against their SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tessera.llm import registry


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_chat_formatting", "op13_ranked_search"])
def test_query_equals_oracle(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = c.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    rows = registry.QUERIES[name](spark, sf).select(*names).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(found.fetchall(), key=repr)
