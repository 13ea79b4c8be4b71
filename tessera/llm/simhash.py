"""SimHash near-duplicates with a pigeonring filter.

Two 64-bit fingerprints of four 16-bit segments on a ring that differ in at most
3 bits have a segment from which every chain of l consecutive segments differs in
at most l * 3/4 bits: 0 in the first, 1 in two, 2 in three, 3 in all.  So only
such pairs are candidates:

* the first segment of the chain is equal;
* the second differs in one bit at most: the pairs are met by an equi-join on 32 bits,
  both segments, which one side probes as they are and with each bit that is 0 set to 1
  (about 36 rows for each different fingerprint);
* the cumulative budgets for two and three segments are tested in the join, before
  the full Hamming check.

The joins are merge joins by hint: Spark takes the rows that are made of a fingerprint for no
larger than the compressed file that it is read from, and would broadcast millions of them.

Groups need no list of all pairs: each fingerprint is first linked with the smallest one
of the same 32 bits, and then only pairs whose components still differ are made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, durable, scratch, table, tidy

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 65_536


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text; 0 for a text without words."""
    got = words(text)
    if not got:
        return 0
    joined, n = b" ".join(got), len(got)
    if n < width:
        starts, ends = [0], [len(joined)]
    else:
        size = np.fromiter(map(len, got), np.int64, n)
        at = np.cumsum(size + 1) - size - 1
        starts, ends = at[: n - width + 1].tolist(), (at + size)[width - 1 :].tolist()
    one, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), _BLOCK):
        h = np.array([one(joined[i:j], 42) for i, j in zip(starts[k : k + _BLOCK], ends[k : k + _BLOCK])], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp: signed long) for every row; texts stay in the executors' batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def _turned(fps: DataFrame) -> DataFrame:
    """fps with i and r, the fingerprint turned so that segment i comes first, for all four i."""
    turned = "CASE i WHEN 0 THEN fp WHEN 1 THEN shiftrightunsigned(fp, 16) | shiftleft(fp, 48) WHEN 2 THEN shiftrightunsigned(fp, 32) | shiftleft(fp, 32) ELSE shiftrightunsigned(fp, 48) | shiftleft(fp, 16) END"
    return fps.withColumn("i", F.explode(F.array(*map(F.lit, range(4))))).withColumn("r", F.expr(turned))


#: Of turned fingerprints ra and rb: what chains of two, three and four segments may differ in.
_CHAIN = "bit_count((ra ^ rb) & 4294967295) <= 1 AND bit_count((ra ^ rb) & 281474976710655) <= 2 AND bit_count(ra ^ rb) <= 3"
_KEY = "CAST(i AS BIGINT) * 4294967296 + (r & 4294967295)"


def links(fps: DataFrame, more: str = "true") -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints (column fp) at 3 or fewer differing bits.

    more: a condition on the other columns of fps, which are named x and y for the two sides.
    """
    others = [c for c in fps.columns if c != "fp"]
    side = lambda n: [F.col("fp").alias("f" + n), F.col("r").alias("r" + n), *(F.col(c).alias({"a": "x", "b": "y"}[n] + c) for c in others)]
    turned = _turned(fps)
    flips = F.expr("filter(sequence(-1, 15), k -> k < 0 OR (shiftrightunsigned(r, 16 + k) & 1) = 0)")
    probe = turned.withColumn("k", F.explode(flips)).select(F.expr(f"{_KEY} + CASE WHEN k < 0 THEN 0 ELSE shiftleft(65536L, k) END").alias("key"), "k", *side("a"))
    met = probe.join(turned.select(F.expr(_KEY).alias("key"), *side("b")).hint("merge"), "key").where(f"(k >= 0 OR fa < fb) AND {_CHAIN} AND {more}")
    return met.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct()


def _stars(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) at 3 or fewer differing bits, of each fingerprint and the smallest one with the same 32 bits."""
    keyed = _turned(fps).select(F.expr(_KEY).alias("key"), F.col("fp").alias("b"))
    least = keyed.groupBy("key").agg(F.min("b").alias("a"), F.max("b").alias("most")).where("a < most").select("key", "a")
    return keyed.join(least.hint("merge"), "key").where("a < b AND bit_count(a ^ b) <= 3").select("a", "b").distinct()


def grouped(reps: DataFrame) -> DataFrame:
    """(fp, rep, component_id) of different fingerprints (fp, rep), written: component_id is the smallest rep reachable."""
    for pairs in (_stars, lambda fps: links(fps, "xcomponent_id <> ycomponent_id")):
        known = reps if "component_id" in reps.columns else reps.withColumn("component_id", F.col("rep"))
        ends = lambda n, to: known.select(F.col("fp").alias(n), F.col("component_id").alias(to))
        given = pairs(known.select("fp", "component_id") if "component_id" in reps.columns else known.select("fp"))
        found = components(given.join(ends("a", "src").hint("merge"), "a").join(ends("b", "dst").hint("merge"), "b").select("src", "dst"))
        after = known.join(found.select(F.col("node").alias("component_id"), "component").hint("merge"), "component_id", "left")
        reps = durable(after.select("fp", "rep", F.coalesce("component", "component_id").alias("component_id")), "groups")
    return reps


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component_id) of every row of docs; its other columns are not looked at.

    Equal fingerprints are one class, so copies are never expanded into pairs;
    only different fingerprints are joined.  component_id is the smallest id
    reachable over links of 3 or fewer differing bits.
    Null and wordless texts have fingerprint 0 and link like any other.  Whole texts are
    read, a batch at a time.  Repeated ids keep their rows; a null id gets component null
    unless its class has another id.  No rows give no rows.
    """
    with scratch() as keep:
        docs = tidy(docs, (id_col, text_col))
        fp = keep(durable(fingerprints(docs, id_col, text_col, width), "fp"))
        label = keep(grouped(durable(fp.groupBy("fp").agg(F.min("id").alias("rep")), "reps")))
    return fp.join(label.select("fp", "component_id").hint("merge"), "fp").select("id", "fp", "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept, for every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        (F.col("id") == F.col("component_id")).alias("kept"),
    )


def keep_one(docs: DataFrame, width: int = 5, least: float | None = None) -> DataFrame:
    """docs without the near-duplicates of a row with a smaller doc_id; all columns stay.

    With least, documents whose sets of `width`-word shingles have a Jaccard similarity
    of that or more are near-duplicates too, however many bits differ.
    Rows that share a doc_id stay or go together, and stay if one of them is the
    smallest of its group.  Rows without a doc_id stay.  No rows give no rows.  Whole texts
    are read.  Of columns that differ in case only, the first stays.
    """
    docs = tidy(docs, ("doc_id", "text"))
    with scratch() as keep:
        found = near_duplicates(docs).select("id", F.col("component_id").alias("component"))
        if least is not None:
            from tessera.llm.shingles import similar

            found = similar(docs, durable(found.where("id IS NOT NULL"), "components"), width, least)
        gone = found.groupBy("id").agg(F.max(F.col("id") == F.col("component")).alias("kept")).where("NOT kept")
        gone = keep(durable(gone.select(F.col("id").alias("doc_id")), "gone"))
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)
