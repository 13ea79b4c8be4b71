"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents.  For all of them: whole texts are read,
also very long ones; repeated rows and rows without a doc_id stay rows of their own, unless
the stage says else; other columns of docs are left out, and of columns that differ in case
only, the one with the exact name counts; no rows give no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import crf, line_dedup, mixing, packing, simhash
from tessera.llm.common import durable, table, tidy

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _given(docs: DataFrame) -> DataFrame:
    return tidy(docs, tuple(COLUMNS)).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the line classifier accepts (operator 1), learnt from labels.

    Null, empty and blank texts are rejected.  Without labels of both kinds nothing is learnt,
    and all rows stay.
    """
    docs = _given(docs)
    return crf.keep_good(docs, crf.learn(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier one has (operator 3).

    Null texts stay null; rows with one doc_id (or none) and text lose nothing to each other.
    """
    return line_dedup.dedup_lines(_given(docs)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: by SimHash (operator 7), and by
    five-word shingles of a similarity of 0.8 or more.

    Null, empty and blank texts are one group.  Rows without a doc_id stay; rows that share
    one stay or go together.
    """
    return simhash.keep_one(_given(docs), width=5, least=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order in which the sources are scheduled (operator 6).

    Rows without a source are one source.  Rows with one doc_id, or none, go in any order.
    """
    return mixing.in_order(_given(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences (operator 10); of pieces of one
    length, those that come first in docs' files go to the first sequences.

    A null or empty text is one piece of one token; a very long one has many pieces.
    """
    docs = tidy(docs, ("doc_id", "text"))
    try:
        run, row = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1), F.col("_metadata.row_index")
        docs = docs.select("doc_id", "text", F.when(run != "", run).otherwise("0").cast("int").alias("run"), row.alias("row"))
    except AnalysisException:  # not read from files
        docs = docs.select("doc_id", "text", F.lit(0).alias("run"), F.lit(0).cast("long").alias("row"))
    cut = durable(packing.pieces(docs, keep=("run", "row")), "pieces")
    return packing.pack(cut, order_by=("run", "row", "doc_id", "piece"), run_of="run").drop("run", "row")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]

#: The classifier and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
