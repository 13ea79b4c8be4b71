"""Chat turns as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def documents(turns: DataFrame, export: str) -> DataFrame:
    """path, content, hash, tags of turns (title, turn, role, text); only users and assistants speak.

    A blank turn is an empty paragraph.
    """
    said = T.strip(F.coalesce("text", F.lit("")))
    line = F.when(said == "", F.lit("")).otherwise(F.concat(F.lit("**"), F.col("role"), F.lit("**: "), said))
    rows = turns.where(F.col("role").isin("user", "assistant")).groupBy("title").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("ls"))
    content = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.array_join(F.transform("ls", lambda x: x.line), "\n\n"))
    return rows.select(F.concat_ws("::", F.lit(export), F.col("title")).alias("path"), content.alias("content"), T.file_hash(content).alias("hash"), F.lit("chatlog").alias("tags"))
