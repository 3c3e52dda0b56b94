"""Splitting objects into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def objects(df: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """Rows (object_id, *keep, bytes); a null text is an empty object."""
    return df.select(F.col(id_col).alias("object_id"), *keep, F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("bytes"))


def fixed_chunks(objs: DataFrame, chunk_bytes: int = 65536) -> DataFrame:
    """Slices of ``chunk_bytes`` bytes, the last one short; an empty object has none.

    A narrow transformation: no shuffle, and the payload stays on its row.
    """
    starts = F.sequence(F.lit(0), F.octet_length("bytes") - 1, F.lit(chunk_bytes))
    return (
        objs.where(F.octet_length("bytes") > 0)
        .withColumn("input_offset", F.explode(starts))
        .withColumn("bytes", F.substring("bytes", F.col("input_offset") + 1, F.lit(chunk_bytes)))
        .withColumn("ordinal", (F.col("input_offset") / chunk_bytes).cast("int"))
        .withColumn("length", F.octet_length("bytes"))
    )


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    """Adds the content id: SHA-256 of the bytes in lower-case hex."""
    return chunks.withColumn("chunk_id", F.sha2("bytes", 256))
