"""A bounded sample of labelled rows for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.llm.common import durable, scratch

_RANGE = 1 << 20


def fold(mod: int):
    """crc32 of doc_id as text, modulo mod (null for a null doc_id)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def sampled_ids(labelled: DataFrame, per_class: int, classes: int) -> tuple[DataFrame, dict]:
    """Of labelled (doc_id, label), about per_class rows of each of the `classes` most
    frequent labels, by a hash of doc_id, and the number of rows of each of them.

    Two bounds hold whatever the corpus: the classes, and the expected rows of each.
    """
    counts = {r.label: r.n for r in labelled.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(classes).collect()}
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("label") == F.lit(label), min(_RANGE, round(_RANGE * per_class / n))).otherwise(share)
    at = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(_RANGE))
    return labelled.where("label IS NOT NULL AND doc_id IS NOT NULL").where(at < share), counts


def bounded_texts(rows: DataFrame, chars: int, longest: int) -> list[Row]:
    """The rows (doc_id, text, label) of a sample in the order of a hash of doc_id, until their
    texts come to `chars` characters; texts longer than `longest` teach nothing.

    A doc_id and label that recur count once.  Only lengths reach the driver before the bound
    is applied.
    """
    with scratch():
        few = rows.where(F.length("text") <= longest).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        few = durable(few.withColumn("at", F.xxhash64("doc_id", F.lit(23))), "sample")
        upto, size = None, 0
        for r in few.groupBy("at").agg(F.sum(F.length("text")).alias("n")).orderBy("at").collect():
            size += r.n
            if size > chars:
                break
            upto = r["at"]
        got = few.where(F.col("at") <= upto).collect() if upto is not None else []
    return sorted(got, key=lambda r: (r["at"], r.doc_id, str(r.label)))
