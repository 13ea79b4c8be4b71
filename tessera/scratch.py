"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a folder of this machine serves a local master, as in tests;
    any other master is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/tessera-scratch"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean_up() -> None:
    for path, spark in list(_made.items()):
        try:
            _remove(spark, path)
        except Exception:  # the JVM has gone already
            return


def scratch_path(spark: SparkSession, what: str = "t") -> str:
    """A fresh folder in the shared directory, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def durable(df: DataFrame, what: str = "t") -> DataFrame:
    """Write df once to the shared directory and read it back.

    Cuts the lineage, so a lost executor costs a re-read, and what several later
    steps use is computed once.
    """
    path = scratch_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Durable frames made inside are released at the end, but for those handed to what it gives."""
    kept: list[DataFrame] = []
    _scopes.append([])

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        made = _scopes.pop()
        for df in made:
            if not any(df is k for k in kept):
                release(df)
            elif _scopes:
                _scopes[-1].append(df)


def written(spark: SparkSession, lines: Iterable[str], schema: str, what: str) -> DataFrame:
    """A table of the driver's CSV lines, which go to the shared directory a megabyte at a
    time; so Spark knows its size, and executors read it as any other table."""
    path = f"{scratch_path(spark, what)}/rows.csv"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    run, size = [], 0
    for line in lines:
        run.append(line)
        size += len(line)
        if size > 1_000_000:
            out.write(bytearray("".join(f"{x}\n" for x in run).encode()))
            run, size = [], 0
    out.write(bytearray("".join(f"{x}\n" for x in run).encode()))
    out.close()
    return spark.read.schema(schema).csv(path)


def release(df: DataFrame) -> None:
    """Remove the files of a durable() frame that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path and _made.pop(path, None):
        _remove(df.sparkSession, path)
