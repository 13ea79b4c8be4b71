"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch of changes is summed to a few rows and committed once under its id: the
rows are written aside and moved into place in one rename, so a batch that is
tried again, or that dies half-way, counts once or not at all.  Totals are the sum
of all committed deltas; compact() folds old ones into one table, which names the
batches it has, and leaves them to the next compact() to remove.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import durable, scratch_path, table, tidy
from tessera.llm.tokens import count_tokens

KEYS = ["source", "lang", "tokenizer_version"]
_SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Additive deltas of changes (source, lang, tokenizer_version, op, n_tokens, old_tokens).

    insert: +1 document and +n_tokens; delete: -1 and -n_tokens; revise: the
    difference to old_tokens.  Null counts are 0, null keys are a group of their
    own, another op changes nothing; other columns are ignored.  Repeated rows are changes
    of their own; no rows give no rows.
    """
    changes = tidy(changes, (*KEYS, "op", "n_tokens", "old_tokens"))
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("op") == "revise", n - old).otherwise(sign * n)
    return changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


class TokenRollup:
    """A rollup kept under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._new = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._new(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _listed(self, kind: str) -> list[str]:
        p = self._new(f"{self.path}/{kind}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _publish(self, df: DataFrame, place: str) -> bool:
        """False if the place is taken: someone else was first."""
        aside, to = f"{self.path}/pending/{uuid.uuid4().hex}", self._new(f"{self.path}/{place}")
        df.coalesce(1).write.parquet(aside)
        self._fs.mkdirs(to.getParent())
        try:
            self._files.rename(self._new(aside), to, self._no_overwrite)
        except Exception:
            if not self._fs.exists(to):
                raise
            self._fs.delete(self._new(aside), True)
            return False
        return True

    def _bases(self) -> list[str]:
        return self._listed("base")

    def _folded(self) -> set[str]:
        """The batches that the last base has taken in, whose deltas may still be there."""
        bases = self._bases()
        return {r.batch for r in self.spark.read.parquet(f"{self.path}/base/{bases[-1]}/batches").collect()} if bases else set()

    def committed(self, batch_id: str) -> bool:
        """Whether a batch has been applied; batches folded long ago have an empty file each."""
        there = lambda kind: self._fs.exists(self._new(f"{self.path}/{kind}/{batch_id}"))
        return there("deltas") or there("folded") or batch_id in self._folded()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it had been applied before.

        The batch id is a name of letters, digits and _.=- (else, or without one, ValueError).
        A batch without rows counts as applied too.
        """
        if not batch_id or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.=-]*", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return not self.committed(batch_id) and self._publish(signed(changes), f"deltas/{batch_id}")

    def _sum(self) -> DataFrame:
        bases, folded = self._bases(), self._folded()
        paths = [f"{self.path}/base/{b}/totals" for b in bases[-1:]] + [f"{self.path}/deltas/{d}" for d in self._listed("deltas") if d not in folded]
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens; groups that came to nothing are left out."""
        return self._sum().where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold all committed deltas into one table; their ids stay known, and readers see one or the other.

        What the compaction before this one had folded is removed first, so a frame of
        totals() can be read until the second compaction after it was made.
        """
        old, bases = self._folded(), self._bases()
        for d in sorted(old):
            self._fs.mkdirs(self._new(f"{self.path}/folded"))
            self._fs.create(self._new(f"{self.path}/folded/{d}"), True).close()
            self._fs.delete(self._new(f"{self.path}/deltas/{d}"), True)
        batches = [d for d in self._listed("deltas") if d not in old]
        if not batches:
            return
        n = int(bases[-1]) + 1 if bases else 0
        aside, to = f"{self.path}/pending/{uuid.uuid4().hex}", self._new(f"{self.path}/base/{n:08d}")
        self._sum().coalesce(1).write.parquet(f"{aside}/totals")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.parquet(f"{aside}/batches")
        self._fs.mkdirs(to.getParent())
        self._files.rename(self._new(aside), to, self._no_overwrite)
        for b in bases[:-1]:
            self._fs.delete(self._new(f"{self.path}/base/{b}"), True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents: a load, the same load tried again, and a revision
    that counts each document's end-of-text token too."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    counted = durable(count_tokens(docs), "counts").withColumn("tokenizer_version", F.lit("word_bpe_49k"))
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    load = counted.withColumns({"op": F.lit("insert"), "old_tokens": F.lit(None).cast("long")})
    revised = counted.withColumns({"op": F.lit("revise"), "old_tokens": F.col("n_tokens"), "n_tokens": F.col("n_tokens") + 1})
    rollup.commit("load", load)
    rollup.commit("load", load)
    rollup.commit("count-end-of-text", revised)
    return rollup.totals()
