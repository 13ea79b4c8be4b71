"""Readers of the engine's JSONL logs; lines that don't parse are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "queries": "ts string, label string, role string, kind string, query string, hits int, top string, ms double",
    "feedback": "chunk_id string, query string, verdict string, ts double",
    "citations": "ts double, via string, query string, source string",
    "audit": "ts string, label string, role string, action string, detail string",
}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a log with ord, their order: the line in a file, or the time in the names of files
    that hold a record each."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    at = F.regexp_extract("_metadata.file_name", r"^(\d{20})-", 1)
    order = F.when(at != "", at.cast("long")).otherwise(F.monotonically_increasing_id()).alias("ord")
    parsed = lines.select(F.from_json("value", SCHEMAS[kind], {"mode": "PERMISSIVE"}).alias("r"), order, F.try_parse_json("value").alias("v"))
    return parsed.where(F.col("v").isNotNull()).select("r.*", "ord")


def import_rows(spark: SparkSession, path: str, expected_model: str | None = None, force: bool = False) -> tuple[DataFrame, dict]:
    """Index rows and the trailer of an exported JSONL file.

    links may be a list or a comma-joined string.  Rows without a source or vector are
    skipped; vectors of different lengths, or another model without force, are refused.
    """
    schema = "id string, source string, chunk int, section string, text string, tags string, links string, mtime double, hash string, chash string, vec array<double>, __meta__ struct<chunks:bigint,embed_model:string,embed_dim:int>"
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")
    meta = rows.where("__meta__ IS NOT NULL").select("__meta__.*").first()
    known = meta.asDict() if meta else {}
    good = rows.where("source IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0").drop("__meta__")
    listed = F.from_json("links", "array<string>")
    good = good.withColumn("links", F.when(F.col("links").startswith("["), F.array_join(listed, ",")).otherwise(F.coalesce("links", F.lit(""))))
    dims = [r.n for r in good.select(F.size("vec").alias("n")).distinct().limit(2).collect()]
    if len(dims) > 1 or (dims and known.get("embed_dim") not in (None, dims[0])):
        raise ValueError("vectors of different lengths")
    if expected_model and known.get("embed_model") not in (None, "", expected_model) and not force:
        raise ValueError(f"exported with {known['embed_model']}, not {expected_model}")
    return good, known
