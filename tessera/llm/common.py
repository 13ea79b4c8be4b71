"""What the operators of this subpackage share: columns, scratch tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tessera.scratch import durable, release, scratch, scratch_path, shared_dir, written

__all__ = ["apart", "components", "durable", "fields", "release", "scratch", "scratch_path", "shared_dir", "table", "tidy", "wider", "written"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wider(schema: StructType, more: str) -> StructType:
    """schema and the fields of a DDL string."""
    return StructType([*schema.fields, *_parse_datatype_string(more).fields])


def tidy(df: DataFrame, need: tuple[str, ...] = (), made: tuple[str, ...] = ()) -> DataFrame:
    """df with every name once, whatever its case, so that no name is ambiguous.

    The needed columns come under these names, wherever they stand (where several differ
    in case only, the one with the exact name, else the first).  Other columns that
    are named like a needed or a made one, or like one before them, give way.
    """
    names = df.columns
    low = [n.lower() for n in names]
    at = {}
    for n in need:
        if n.lower() not in low:
            raise ValueError(f"no column {n} among {', '.join(names)}")
        at[names.index(n) if n in names else low.index(n.lower())] = n
    taken, keep = {n.lower() for n in (*need, *made)}, []
    for k, n in enumerate(names):
        if k in at or low[k] not in taken:
            keep.append((k, at.get(k, n)))
            taken.add(low[k])
    if keep == list(enumerate(names)):
        return df
    if len(set(low)) == len(low):
        return df.select(*[F.col(f"`{names[k]}`").alias(n) for k, n in keep])
    flat = df.toDF(*[f"c{k}" for k in range(len(names))])
    return flat.select(*[F.col(f"c{k}").alias(n) for k, n in keep])


def apart(df: DataFrame, need: tuple[str, ...], made: tuple[str, ...] = (), whole: bool = False) -> tuple[DataFrame, list[str]]:
    """The needed columns and a struct _row of all others (with whole: of all columns) that
    no made column replaces, so that names of ours clash with none of df's; and the
    names in the struct, which has the field _ where there are none."""
    df = tidy(df, need, made)
    names = [c for c in df.columns if whole or c not in need]
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(True).alias("_"))
    return df.select(*need, row.alias("_row")), names


def fields(names: list[str], of: str = "_row") -> list:
    """The columns of a struct under their own names."""
    return [F.col(f"{of}.`{c}`").alias(c) for c in names]


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the least of u and its neighbours."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every neighbour below u, and u, is linked to the least of them (e has u > v)."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    lower = e.join(least.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (src, dst: long).

    Returns (node, component) for every node with an edge to another node;
    component is the smallest node of its component.  Alternating large-star and
    small-star steps, O(log^2 n) rounds; each round is one written table and
    nothing but a count and a checksum reaches the driver.  Hubs: the minimum per
    node is pre-aggregated before the shuffle, and the join back is an inner join
    whose skewed partitions adaptive execution can split.  It is a merge join at any size:
    the size of a compressed file says little of what a broadcast of it takes in the driver.
    Self-links, nulls and repeated edges are ignored; no edges give no rows.
    """
    state = None
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    while True:
        seen = Observation()
        after = durable(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("all")), "edges")
        if state is not None:
            release(before)
        now = seen.get
        if now == state or not now["n"]:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state, before, e = now, after, _small_star(_large_star(after))
