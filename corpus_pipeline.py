"""The corpus pipeline: five stages over the documents, each written as Parquet and read again by the next.

1. quality: documents that the quality classifier rejects go, toxic ones included.
2. near_duplicates: of each class of near duplicates the document with the smallest id stays.
3. decontamination: documents with a benchmark passage go.
4. mixing: sources are brought to their target weights; a document appears as often as the mix takes it, or not at all.
5. sharding: the final rows with their shards and slots.

All but the last return the columns of the documents, whatever these are; extra columns are carried along. Repeated rows are documents of
their own until stage 2, which keeps one of them. Null ids, texts, languages and sources and empty tables pass through as each operator
defines. Rows of an input are told apart by a number given when the input is written once to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, documents
from siltstone.llm.decontamination import decontaminate
from siltstone.llm.mixing import mix
from siltstone.llm.near_duplicates import near_duplicates
from siltstone.llm.quality_classifier import classify
from siltstone.llm.sharding import shard


def _packed(docs: DataFrame) -> DataFrame:
    """The needed columns under names of our own beside the whole row."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("source").alias("_source"), F.col("lang").alias("_lang"))


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The packed rows with a number; written, so that the numbers stay."""
    return scratch.write(_packed(docs).select("_row", F.monotonically_increasing_id().alias("_n")), "numbered")


def _narrow(rows: DataFrame) -> DataFrame:
    return rows.select("_n", F.col("_row.doc_id").alias("_id"), F.col("_row.text").alias("_text"), F.col("_row.source").alias("_source"))


def quality(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = classify(_packed(docs), labels, Scratch(spark, "quality"), "_id", "_row", text="_text", host=F.col("_source"), path=F.col("_lang"))
    return found.where("kept").select("_row.*")


def dedup(spark, docs, sf_dir):
    scratch = Scratch(spark, "dedup")
    rows = _numbered(docs, scratch)
    keyed = _narrow(rows).select(F.struct("_id", "_n").alias("_key"), "_text")
    found = near_duplicates(keyed, scratch, "_key", text="_text")
    stay = found.where(F.col("_key").eqNullSafe(F.col("class_id"))).select(F.col("_key._n").alias("_n"))
    return rows.join(stay, "_n", "left_semi").select("_row.*")


def decontamination(spark, docs, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(_packed(docs), benchmark, "_row", text="_text").where("NOT contaminated").select("_row.*")


def mixing(spark, docs, sf_dir):
    scratch = Scratch(spark, "mixing")
    rows = _numbered(docs, scratch)
    found = mix(_narrow(rows), scratch, "_id", "_n", text="_text", source="_source").where("copies > 0").select("_n", "copies")
    return rows.join(found, "_n").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


def sharding(spark, docs, sf_dir):
    packed = docs.select("doc_id", "text")
    return shard(packed, Scratch(spark, "sharding"), "doc_id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot")


STAGES = [
    ("quality", quality),
    ("near_duplicates", dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark, sf_dir) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before = list(Scratch.open)
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        for used in [x for x in Scratch.open if x not in before]:
            used.close()  # the stage's own tables; its result is written
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs


#: The classifier's fit and the pivotal draws are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
