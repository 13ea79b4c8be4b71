"""Dense vectors: cosine, and deterministic token-hash embeddings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import tokens

#: Fixed value: dimensions of the token-hash embedding.
DIMENSIONS = 128
# Dimensions, start and factor of the 64-bit FNV-1a embedding.
FNV_DIMENSIONS, FNV_START, FNV_TIMES = 64, 0xCBF29CE484222325, 0x100000001B3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null for a zero vector."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def token_bucket(token: Column, dimensions: int = DIMENSIONS, digest: str = "md5") -> Column:
    """md5 or sha256 of the token modulo a power of two up to 256."""
    hashed = F.md5(token) if digest == "md5" else F.sha2(token, 256)
    return (F.conv(F.right(hashed, F.lit(2)), 16, 10).cast("int") % dimensions).cast("int")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it inside a lambda."""
    return F.transform(F.array(value), f)[0]


def bucket_counts(buckets: Column, dimensions: int) -> Column:
    """How often each of 0 to dimensions - 1 is among the buckets: one fold over the buckets,
    sorted together with a mark behind each dimension."""
    marks = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: 2 * i + 1)
    start = F.struct(F.expr("CAST(array() AS array<double>)").alias("out"), F.lit(0.0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        done = F.struct(F.concat(acc["out"], F.array(acc["n"])).alias("out"), F.lit(0.0).alias("n"))
        return F.when(x % 2 == 1, done).otherwise(F.struct(acc["out"].alias("out"), (acc["n"] + 1).alias("n")))

    ordered = F.array_sort(F.concat(F.transform(buckets, lambda b: 2 * b), marks))
    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def hash_vector(text: Column, dimensions: int = DIMENSIONS, digest: str = "md5") -> Column:
    """The unit vector that counts a text's different tokens by bucket; zeros for a null text and one without tokens."""
    buckets = F.transform(F.array_distinct(tokens(F.coalesce(text, F.lit("")))), lambda t: token_bucket(t, dimensions, digest))
    unit = lambda counts, n: F.transform(counts, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))
    return _once(bucket_counts(buckets, dimensions), lambda c: _once(norm(c), lambda n: unit(c, n)))


def _fnv_hashes(words: list[bytes]) -> dict[bytes, int]:
    """FNV-1a of each word; a step for each byte position of the longest, over all words that have it."""
    words = sorted(words, key=len, reverse=True)
    sizes = np.array([len(w) for w in words], np.int64)
    data, starts = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64), np.cumsum(sizes) - sizes
    out = np.full(len(words), FNV_START, np.uint64)
    for at in range(int(sizes[0]) if len(words) else 0):
        n = int(np.searchsorted(-sizes, -at, "left"))  # words longer than at
        out[:n] = (out[:n] ^ data[starts[:n] + at]) * np.uint64(FNV_TIMES)
    return dict(zip(words, out.tolist(), strict=True))


def _fnv(texts: pa.Array) -> pa.Array:
    split = [[w.encode() for w in (text or "").split()] for text in texts.to_pylist()]
    at = _fnv_hashes(list({w for ws in split for w in ws}))
    out = np.zeros((len(texts), FNV_DIMENSIONS))
    for row, words in zip(out, split, strict=True):
        np.add.at(row, np.array([at[w] % FNV_DIMENSIONS for w in words], np.int64), 1)
        if row.any():
            row /= np.linalg.norm(row)
    return pa.array(list(out), pa.list_(pa.float64()))


def fnv_vector(text: Column) -> Column:
    """The unit vector that counts a text's blank-separated words, each time they occur, by FNV-1a; a
    64-bit product that wraps, so Arrow batches."""
    return F.arrow_udf(_fnv, "array<double>")(text)


def hash_embedding(docs: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, bucket, weight): the unit vector that counts a text's different tokens by
    bucket, as its non-zero components."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token"))
    counts = words.groupBy("id", token_bucket(F.col("token"), dimensions).alias("bucket")).agg(F.count("*").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy("id")).cast("double"))
    return counts.select("id", "bucket", (F.col("n") / length).alias("weight"))
