"""The registered queries and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

#: Modules that register queries.
MODULES = ("lexical", "search", "structure", "maintenance", "graphs", "analytics", "assessment", "streams")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; whole numbers come out as long."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        _queries[fn.__name__] = run
        if oracle is not None:
            _oracles[fn.__name__] = oracle
        return fn

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tessera.plans.{m}")


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["bm25_topk"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
