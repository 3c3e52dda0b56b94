"""Exact duplicates: owners, recipes, restore, lookups and their checks.

Payload bytes never go through the duplicate search: it works on (chunk_id, length, object_id, ordinal). Owners come from a grouped minimum,
which is combined before the shuffle, instead of a window over all copies, so a very common chunk costs one row for each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["chunk_id", "length"]


def owners(chunks: DataFrame) -> DataFrame:
    """(chunk_id, length, owner_object, owner_ordinal, copies): the first occurrence in object order owns a chunk."""
    found = chunks.groupBy(*KEY).agg(F.min(F.struct("object_id", "ordinal")).alias("o"), F.count("*").alias("copies"))
    return found.select(*KEY, F.col("o.object_id").alias("owner_object"), F.col("o.ordinal").alias("owner_ordinal"), "copies")


def recipe(chunks: DataFrame) -> DataFrame:
    """Chunks with their owner and exact_hit: whether an earlier occurrence holds the bytes."""
    joined = chunks.join(owners(chunks), KEY)
    return joined.withColumn("exact_hit", (F.col("object_id") != F.col("owner_object")) | (F.col("ordinal") != F.col("owner_ordinal")))


def restore(recipes: DataFrame, payload: DataFrame) -> DataFrame:
    """(object_id, bytes, verified): objects put together from their recipes; payload holds (chunk_id, length, bytes), each once.

    verified: every chunk was there and has the id of its bytes.
    """
    joined = recipes.select("object_id", "ordinal", *KEY).join(payload, KEY, "left")
    good = F.coalesce(F.sha2("bytes", 256) == F.col("chunk_id"), F.lit(False)) & (F.octet_length("bytes") == F.col("length"))
    parts = joined.withColumn("good", good).groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "bytes"))).alias("parts"), F.bool_and("good").alias("verified"))
    return parts.select("object_id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p.bytes)), "")).alias("bytes"), "verified")


def length_conflicts(chunks: DataFrame, length: str = "length") -> DataFrame:
    """Ids with more than one length: corruption."""
    return chunks.groupBy("chunk_id").agg(F.countDistinct(length).alias("lengths"), F.count("*").alias("occurrences")).where("lengths > 1")


def missing(required: DataFrame, locations: DataFrame, keys=("chunk_id", "logical_length")) -> DataFrame:
    """Required chunks without a location; must be empty."""
    return required.select(*keys).distinct().join(locations, list(keys), "left_anti")


def insert_no_replace(index: DataFrame, new: DataFrame, keys=("chunk_id", "length")) -> DataFrame:
    """Entries of ``new`` whose key the index does not hold; one for each key."""
    return new.dropDuplicates(list(keys)).join(index.select(*keys), list(keys), "left_anti")


def batched_lookup(keys: DataFrame, cache: DataFrame, index: DataFrame) -> DataFrame:
    """(key, location, source) in a row for each distinct key: the cache answers first, then the index; null where neither does."""
    asked = keys.select("key").distinct()
    joined = asked.join(cache.select("key", F.col("location").alias("c")), "key", "left").join(index.select("key", F.col("location").alias("i")), "key", "left")
    return joined.select("key", F.coalesce("c", "i").alias("location"), F.when(F.col("c").isNotNull(), "cache").when(F.col("i").isNotNull(), "index").otherwise("none").alias("source"))


def reuse_opportunity(chunks: DataFrame, *by: str) -> DataFrame:
    """Chunks and bytes that repeat an identity seen before."""
    once = chunks.groupBy(*by, *KEY).agg(F.count("*").alias("n"))
    return once.groupBy(*by).agg(
        F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"), (F.sum("n") - F.count("*")).alias("reusable_chunks"), F.sum((F.col("n") - 1) * F.col("length")).alias("reusable_bytes")
    )


def object_digest(chunks: DataFrame) -> DataFrame:
    """(object_id, digest): hash of an object's chunk ids in order."""
    ids = chunks.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id"))).alias("c"))
    return ids.select("object_id", F.sha2(F.array_join(F.transform("c", lambda x: x.chunk_id), ","), 256).alias("digest"))
