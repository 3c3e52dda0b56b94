"""Queries on chunking, identity and exact duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import chunking, dedup


def fixed_chunk_dedup(spark, sf_dir):
    """Chunks, exact hits and their bytes by language, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    chunks = chunking.with_chunk_id(chunking.fixed_chunks(chunking.objects(docs, "doc_id", "text", "lang"), 4096)).drop("bytes")
    marked, hit = dedup.recipe(chunks), F.col("exact_hit")
    return marked.groupBy("lang").agg(
        F.count("*").alias("chunks"),
        F.count_if(hit).alias("exact_hits"),
        F.sum(F.col("length").cast("bigint")).alias("logical_bytes"),
        F.sum(F.when(hit, F.col("length")).otherwise(0).cast("bigint")).alias("exact_hit_bytes"),
    )


QUERIES = {"fixed_chunk_dedup": fixed_chunk_dedup}

ORACLES = {
    "fixed_chunk_dedup": """
WITH d AS (SELECT doc_id, lang, encode(text) AS b FROM documents WHERE text <> ''),
s AS (SELECT doc_id, lang, b, unnest(range(0, octet_length(b), 4096)) AS o FROM d),
c AS (SELECT doc_id, lang, o, array_slice(b, o + 1, o + 4096) AS p FROM s),
h AS (SELECT lang, octet_length(p) AS n, row_number() OVER (PARTITION BY sha256(p), octet_length(p) ORDER BY doc_id, o) AS k FROM c)
SELECT lang, count(*) AS chunks, count(*) FILTER (k > 1) AS exact_hits, CAST(sum(n) AS BIGINT) AS logical_bytes,
  CAST(coalesce(sum(n) FILTER (k > 1), 0) AS BIGINT) AS exact_hit_bytes
FROM h GROUP BY lang"""
}
