"""A Parquet table in immutable segments, changed by source and merged when it is read.

Rows lie in buckets by the hash of their source.  A commit writes one segment: the new
rows of the sources it touches, in a folder for each bucket, and tombstones, the names
of these sources.  A row counts unless its source has a tombstone of a later commit,
so nothing is rewritten but what changes.  A manifest names the segments and their
buckets; it is written under a name of its own and becomes current by one rename of
the pointer, so readers keep the version that they began with, and a commit that failed
half-way is not there.

A bucket that `most` commits have touched since it was merged last is compacted: its live
rows become one new segment and its tombstones go.  Buckets that a commit did
not touch are never read by it nor rewritten.  There is one writer at a time; a commit
that finds another manifest than it began with stops.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources import sinks

#: Buckets of a new table, and segments of a bucket before it is compacted.
BUCKETS, MOST = 64, 8
#: Files of a bucket in one segment at most; also a source with very many rows has several.
FILES = 4
_SEQ, _DIR = "_seq", "_dir"


@dataclass
class Manifest:
    """segments, tombstones: name, seq and buckets that still count of each commit's rows and names."""

    name: str
    seq: int = 0
    buckets: int = BUCKETS
    schema: dict = field(default_factory=dict)
    segments: list[dict] = field(default_factory=list)
    tombstones: list[dict] = field(default_factory=list)

    def marked(self) -> set[int]:
        """Buckets with tombstones."""
        return {b for t in self.tombstones for b in t["buckets"]}

    def without(self, buckets: set[int]) -> tuple[list[dict], list[dict]]:
        """Segments and tombstones without these buckets."""
        cut = lambda xs: [s | {"buckets": left} for s in xs if (left := [b for b in s["buckets"] if b not in buckets])]
        return cut(self.segments), cut(self.tombstones)


class SegmentTable:
    """Rows of one schema with a string column `key` (source)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "source", buckets: int = BUCKETS, most: int = MOST) -> None:
        self.spark, self.path, self.key, self.buckets, self.most = spark, path.rstrip("/"), key, buckets, most

    # ---- manifests -------------------------------------------------------------

    def current(self) -> str | None:
        """The name of the current version."""
        return sinks.read_small(self.spark, f"{self.path}/CURRENT")

    def manifest(self, version: str | None = None) -> Manifest | None:
        name = version or self.current()
        text = sinks.read_small(self.spark, f"{self.path}/manifests/{name}.json") if name else None
        return Manifest(**json.loads(text)) if text else None

    def _publish(self, m: Manifest, before: str | None) -> str:
        if self.current() != before:
            raise RuntimeError(f"{self.path} was changed by another writer: nothing is committed")
        sinks.write_small(self.spark, f"{self.path}/manifests/{m.name}.json", json.dumps(asdict(m)))
        sinks.write_small(self.spark, f"{self.path}/CURRENT", m.name)
        return m.name

    # ---- reading ---------------------------------------------------------------

    def _files(self, m: Manifest, what: str, listed: list[dict], buckets: set[int] | None = None) -> list[str]:
        return [f"{self.path}/{what}/{s['name']}/{_DIR}={b}" for s in listed for b in s["buckets"] if buckets is None or b in buckets]

    def _load(self, m: Manifest, what: str, listed: list[dict], buckets: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(m.schema) if what == "segments" else StructType.fromDDL(f"{self.key} string, {_SEQ} long")
        paths = self._files(m, what, listed, buckets)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _live(self, m: Manifest, buckets: set[int] | None = None) -> DataFrame:
        """The rows that count, with _seq; only buckets that have tombstones are joined with them."""
        marked = m.marked() if buckets is None else m.marked() & buckets
        every = {b for s in m.segments for b in s["buckets"]} if buckets is None else buckets
        plain = self._load(m, "segments", m.segments, every - marked)
        if not marked:
            return plain
        rows = self._load(m, "segments", m.segments, marked)
        gone = self._load(m, "tombstones", m.tombstones, marked).groupBy(F.col(self.key).alias("_gone")).agg(F.max(_SEQ).alias("_at"))
        kept = rows.join(gone, rows[self.key].eqNullSafe(gone._gone) & (rows[_SEQ] < gone._at), "left_anti")
        return plain.unionByName(kept) if every - marked else kept

    def read(self, version: str | None = None) -> DataFrame | None:
        """All rows of a version (the current one), or None for a table never written."""
        m = self.manifest(version)
        return self._live(m).drop(_SEQ) if m else None

    def buckets_of(self, sources: DataFrame) -> set[int]:
        """The buckets of some sources (column key)."""
        m = self.manifest()
        return {r[0] for r in sources.select(self._bucket(m.buckets if m else self.buckets)).distinct().collect()}

    def of_sources(self, sources: DataFrame, buckets: set[int] | None = None) -> DataFrame | None:
        """The rows of some sources (column key), read from their buckets only (buckets: where these are known)."""
        m = self.manifest()
        if m is None:
            return None
        at = self.buckets_of(sources) if buckets is None else buckets
        return self._live(m, at).drop(_SEQ).join(sources.select(self.key).distinct(), self.key, "left_semi")

    # ---- writing ---------------------------------------------------------------

    def _bucket(self, buckets: int):  # noqa: ANN202
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, m: Manifest, what: str, name: str) -> list[int]:
        """df's rows in a folder for each bucket; the buckets that got rows."""
        path = f"{self.path}/{what}/{name}"
        part = F.pmod(F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]), F.lit(FILES))
        dealt = df.withColumn(_DIR, self._bucket(m.buckets)).repartition(_DIR, part).sortWithinPartitions(_DIR, self.key)
        dealt.write.partitionBy(_DIR).option("compression", "zstd").parquet(path)
        return sorted(int(n.rpartition("=")[2]) for n in sinks.folders_in(self.spark, path) if n.startswith(f"{_DIR}="))

    def replace(self, df: DataFrame) -> str:
        """All rows anew."""
        before = self.manifest()
        m = Manifest(uuid.uuid4().hex, (before.seq if before else 0) + 1, self.buckets)
        rows = df.withColumn(_SEQ, F.lit(m.seq).cast("long"))
        m.schema = json.loads(rows.schema.json())
        name = f"{m.seq:012d}-{m.name[:8]}"
        m.segments = [{"name": name, "seq": m.seq, "buckets": self._write(rows, m, "segments", name)}]
        return self._publish(m, before.name if before else None)

    def upsert(self, fresh: DataFrame, sources: DataFrame | None = None) -> str:
        """The rows of fresh replace all that their sources had; sources (column key) names further
        ones that now have none.  Repeated rows stay; sources that are null are a source too."""
        before = self.manifest()
        if before is None:
            return self.replace(fresh)
        m = Manifest(uuid.uuid4().hex, before.seq + 1, before.buckets, before.schema)
        name = f"{m.seq:012d}-{m.name[:8]}"
        names = [c for c in StructType.fromJson(m.schema).names if c != _SEQ]
        rows = fresh.select(*names).withColumn(_SEQ, F.lit(m.seq).cast("long"))
        at = self._write(rows, m, "segments", name)
        written = {"name": name, "seq": m.seq, "buckets": at}
        touched = self._load(m, "segments", [written]).select(self.key)
        touched = touched.unionByName(sources.select(self.key)) if sources is not None else touched
        marks = self._write(touched.distinct().withColumn(_SEQ, F.lit(m.seq).cast("long")), m, "tombstones", name)
        m.segments = [*before.segments, *([written] if at else [])]
        m.tombstones = [*before.tombstones, *([{"name": name, "seq": m.seq, "buckets": marks}] if marks else [])]
        self._compact(m)
        return self._publish(m, before.name)

    def delete(self, sources: DataFrame) -> str | None:
        """Take these sources out."""
        m = self.manifest()
        if m is None:
            return None
        none = self.spark.createDataFrame([], StructType([f for f in StructType.fromJson(m.schema).fields if f.name != _SEQ]))
        return self.upsert(none, sources)

    def _compact(self, m: Manifest) -> None:
        """Buckets with too many segments get one; m is changed in place."""
        count: dict[int, int] = {}
        for t in m.tombstones:
            for b in t["buckets"]:
                count[b] = count.get(b, 0) + 1
        full = {b for b, n in count.items() if n > self.most}
        if not full:
            return
        name = f"{m.seq:012d}-{uuid.uuid4().hex[:8]}"
        at = self._write(self._live(m, full), m, "segments", name)
        m.segments, m.tombstones = m.without(full)
        if at:
            m.segments.append({"name": name, "seq": m.seq, "buckets": at})

    def vacuum(self, keep: int = 2) -> set[str]:
        """Remove what no version but the newest `keep` and the current one uses; the versions that stay."""
        now = self.current()
        names = [n.removesuffix(".json") for n in sinks.names_in(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        found = sorted((m for n in names if (m := self.manifest(n))), key=lambda m: (m.seq, m.name == now), reverse=True)
        live = {m.name for m in found[:keep]} | ({now} if now else set())
        for m in found:
            if m.name not in live:
                sinks.drop_path(self.spark, f"{self.path}/manifests/{m.name}.json")
        kept = [m for m in found if m.name in live]
        for what in ("segments", "tombstones"):
            used: dict[str, set[str]] = {}
            for x in (x for m in kept for x in getattr(m, what)):
                used.setdefault(x["name"], set()).update(f"{_DIR}={b}" for b in x["buckets"])
            sinks.drop_folders(self.spark, f"{self.path}/{what}", lambda n, used=used: n not in used)
            for name, mine in used.items():
                sinks.drop_folders(self.spark, f"{self.path}/{what}/{name}", lambda n, mine=mine: n.startswith(_DIR) and n not in mine)
        return live
