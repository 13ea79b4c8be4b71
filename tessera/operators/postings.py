"""A lexical index that follows its corpus by deltas.

Each batch writes one segment: the postings of the documents that came, tombstones (ids)
of those that went, and signed changes of the document frequencies; the number of documents
and of their tokens are sums in the manifest.  A posting counts unless its document has a
tombstone of a later batch.  So a batch costs what it changes, and scores are those of an
index built anew.  Segments are merged when there are more than MOST: all but the first, or
all of them once the others have a share of MERGE of its postings.

A manifest is current by one rename of the pointer; it names the version of the corpus
that it describes, so a reader knows whether the index is up to date.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokenizer
from tessera.operators import lexical
from tessera.sources import sinks

#: Segments before they are merged, and the share of the first from which it is merged too.
MOST, MERGE = 8, 0.25
#: Different query terms up to which they go to the scan as a filter, and rows of queries' terms up to
#: which these are broadcast.
FEW_TERMS, ASKED = 500, 10_000
#: Tokens of the documents behind a file.
FILE = 4_000_000
_POSTINGS, _GONE, _TERMS = "term string, id long, tf long, dl int, _seq long", "id long, _seq long", "term string, df long"


@dataclass
class _Manifest:
    name: str
    of: str
    tokenizer: str
    seq: int = 0
    n: int = 0
    total: int = 0
    segments: list[dict] = field(default_factory=list)  # name, postings, gone: rows


class DeltaIndex:
    """Postings of a corpus (id long, text) under a path."""

    def __init__(self, spark: SparkSession, path: str, name: str = "default") -> None:
        self.spark, self.path, self.name = spark, path.rstrip("/"), name

    def manifest(self) -> _Manifest | None:
        current = sinks.read_small(self.spark, f"{self.path}/CURRENT")
        text = sinks.read_small(self.spark, f"{self.path}/manifests/{current}.json") if current else None
        m = _Manifest(**json.loads(text)) if text else None
        return m if m and m.tokenizer == self.name else None

    def of(self) -> str | None:
        """The version of the corpus that the index describes."""
        m = self.manifest()
        return m.of if m else None

    def _publish(self, m: _Manifest) -> None:
        sinks.write_small(self.spark, f"{self.path}/manifests/{m.name}.json", json.dumps(asdict(m)))
        sinks.write_small(self.spark, f"{self.path}/CURRENT", m.name)

    def _read(self, m: _Manifest, what: str, schema: str, segments: list[dict] | None = None) -> DataFrame:
        named = [s["name"] for s in (m.segments if segments is None else segments) if s.get(what, 1)]
        paths = [f"{self.path}/{what}/{n}" for n in named]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _save(self, df: DataFrame, what: str, name: str, by: str, tokens: int) -> int:
        """Write df sorted by a column, in files of ranges; the number of its rows.  A batch of few
        tokens is one file, without the sample that ranges need."""
        path, files = f"{self.path}/{what}/{name}", -(-tokens // FILE)
        dealt = df.repartitionByRange(files, by) if files > 1 else df.repartition(1)
        dealt.sortWithinPartitions(by).write.option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path).count()  # from the files' footers

    # ---- writing ---------------------------------------------------------------

    def build(self, docs: DataFrame, of: str) -> None:
        """The index of docs anew."""
        before = self.manifest()
        self._commit(_Manifest(uuid.uuid4().hex, of, self.name, before.seq if before else 0), None, docs)

    def apply(self, removed: DataFrame, added: DataFrame, of: str) -> None:
        """Documents (id, text) that went, as they were indexed, and those that came.  An id may
        be in both; within each, ids are different."""
        before = self.manifest()
        if before is None:
            raise LookupError(f"no index under {self.path}")
        self._commit(_Manifest(uuid.uuid4().hex, of, self.name, before.seq, before.n, before.total, list(before.segments)), removed, added)

    def _commit(self, m: _Manifest, removed: DataFrame | None, added: DataFrame) -> None:
        m.seq += 1
        name = f"{m.seq:012d}-{m.name[:8]}"
        signed = lexical.tokenised(added, "id", "text", self.name).withColumn("sign", F.lit(1))
        if removed is not None:
            signed = signed.unionByName(lexical.tokenised(removed, "id", "text", self.name).withColumn("sign", F.lit(-1)))
        toks = signed.persist()
        try:
            sums = toks.agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.size("tokens")).alias("total"), F.sum(F.size("tokens")).alias("tokens"), F.count_if(F.col("sign") < 0).alias("went")).first()
            m.n, m.total = m.n + (sums.n or 0), m.total + (sums.total or 0)
            came = toks.where("sign = 1")
            each = came.select(F.col("id").cast("long").alias("id"), F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
            rows = self._save(each.select("term", "id", "tf", "dl", F.lit(m.seq).cast("long").alias("_seq")), "postings", name, "term", sums.tokens or 0)
            gone = self._save(toks.where("sign = -1").select(F.col("id").cast("long").alias("id"), F.lit(m.seq).cast("long").alias("_seq")), "gone", name, "id", sums.went or 0) if sums.went else 0
            changed = toks.select("sign", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.sum("sign").cast("long").alias("df")).where("df <> 0")
            self._save(changed, "terms", name, "term", sums.tokens or 0)
        finally:
            toks.unpersist()
        m.segments.append({"name": name, "postings": rows, "gone": gone})
        if len(m.segments) > MOST:
            later = sum(s["postings"] for s in m.segments[1:])
            self._merge(m, 0 if later > MERGE * m.segments[0]["postings"] else 1)
        self._publish(m)

    def _merge(self, m: _Manifest, start: int) -> None:
        """The segments from `start` on become one; with all, tombstones go."""
        part, name = m.segments[start:], f"{m.seq:012d}-{uuid.uuid4().hex[:8]}"
        gone = self._read(m, "gone", _GONE, part)
        n = sum(s["postings"] for s in part)
        rows = self._save(_alive(self._read(m, "postings", _POSTINGS, part), gone), "postings", name, "term", n)
        kept = self._save(gone.groupBy("id").agg(F.max("_seq").alias("_seq")), "gone", name, "id", sum(s["gone"] for s in part)) if start else 0
        sums = self._read(m, "terms", _TERMS, part).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        self._save(sums, "terms", name, "term", n)
        m.segments[start:] = [{"name": name, "postings": rows, "gone": kept}]

    def vacuum(self) -> None:
        """Remove what the current manifest does not use."""
        m = self.manifest()
        if m is None:
            return
        used = {s["name"] for s in m.segments}
        for what in ("postings", "gone", "terms"):
            sinks.drop_folders(self.spark, f"{self.path}/{what}", lambda n: n not in used)
        sinks.drop_folders(self.spark, f"{self.path}/manifests", lambda n: n != f"{m.name}.json")

    # ---- reading ---------------------------------------------------------------

    def frequencies(self) -> DataFrame:
        """(term, df > 0)."""
        return self._read(self._known(), "terms", _TERMS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def postings(self) -> DataFrame:
        """(term, id, tf, dl) of the documents that are there."""
        m = self._known()
        return _alive(self._read(m, "postings", _POSTINGS), self._read(m, "gone", _GONE) if any(s["gone"] for s in m.segments) else None).drop("_seq")

    def stats(self) -> DataFrame:
        """One row of (n, avgdl)."""
        m = self._known()
        return self.spark.range(1).select(F.lit(m.n).cast("long").alias("n"), F.lit(m.total / m.n if m.n else None).cast("double").alias("avgdl"))

    def _known(self) -> _Manifest:
        m = self.manifest()
        if m is None:
            raise LookupError(f"no index under {self.path}")
        return m

    def scores(self, queries: DataFrame, k1: float = lexical.K1, b: float = lexical.B) -> DataFrame:
        """(query_id, id, score > 0) for queries (query_id, text), as an index built anew gives it.

        Few terms are a filter of the scans, which then read the row groups that may hold
        them; more are broadcast up to ASKED rows, and joined beyond.  Tombstones meet the postings of the queries' terms only.
        """
        m = self._known()
        q = queries.select("query_id", F.explode(tokenizer(self.name)(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        rows, terms = self._read(m, "postings", _POSTINGS), self._read(m, "terms", _TERMS)
        asked = q.limit(ASKED + 1).collect()
        avgdl = m.total / m.n if m.n else 0.0
        if len(asked) <= ASKED:
            wanted = sorted({r.term for r in asked})
            if len(wanted) <= FEW_TERMS:
                only = F.col("term").isin(*wanted) if wanted else F.lit(False)
                rows, terms = rows.where(only), terms.where(only)
            else:
                terms = terms.join(F.broadcast(self.spark.createDataFrame([(t,) for t in wanted], "term string")), "term", "left_semi")
            df = {r.term: r.df for r in terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").collect()}
            weighed = [(r.query_id, r.term, r.qtf * math.log(1 + (m.n - df[r.term] + 0.5) / (df[r.term] + 0.5))) for r in asked if r.term in df]
            weights = F.broadcast(self.spark.createDataFrame(weighed, f"query_id {q.schema['query_id'].dataType.simpleString()}, term string, w double"))
        else:
            df = terms.join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
            weights = q.join(df, "term").select("query_id", "term", (F.col("qtf") * F.ln(1 + (F.lit(m.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))
        hits = _alive(rows.join(weights, "term"), self._read(m, "gone", _GONE) if any(s["gone"] for s in m.segments) else None)
        part = F.col("w") * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl)))
        return hits.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def _alive(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """rows (id, _seq) without those whose id has a later tombstone."""
    if gone is None:
        return rows
    last = gone.groupBy(F.col("id").alias("_id")).agg(F.max("_seq").alias("_at"))
    return rows.join(last, (rows["id"] == last._id) & (rows["_seq"] < last._at), "left_anti")
