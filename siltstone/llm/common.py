"""Shared helpers: the shared scratch folder, batches of texts, scalable ranks, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows with whole texts that go to a Python worker at once, and those that it unfolds at once.
BATCH_ROWS, SLICE = 1000, 500
#: Keys that ``join_counted`` broadcasts at most.
HOT_KEYS = 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where that is unset and the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="siltstone-shared-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def packed(docs: DataFrame, keep, *columns) -> DataFrame:
    """The kept columns as one struct ``_keep`` beside columns under names of our own, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep"), *columns)


def unpacked(rows: DataFrame, keep, *own: str) -> DataFrame:
    """The kept columns again, and the operator's own; a kept column with the name of an own one gives way to it."""
    return rows.select(*[F.col(f"_keep.`{c}`") for c in keep if c not in own], *own)


def unused(keep, name: str) -> str:
    """The name, with underscores before it until none of the kept columns has it."""
    while name in keep:
        name = f"_{name}"
    return name


class Scratch:
    """Parquet tables in the shared folder. They cut lineage and survive the loss of executors; they go on ``drop`` or ``close``, or when the session's JVM ends."""

    #: Those that are open, in the order of their making.
    open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        Scratch.open.append(self)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)

    def write(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """The table as written; ``batch_rows`` bounds the batches that go to Python workers."""
        # Nothing needs the shuffle files of a written table, so they go with the job that wrote it.
        conf, held = self.spark.conf, {_CLEANUP: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})
        before = {k: conf.get(k, None) for k in held}
        try:
            for k, v in held.items():
                conf.set(k, v)
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def close(self) -> None:
        """Removes all tables; nothing that reads them may be used any more."""
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.root), True)
        Scratch.open.remove(self)

    def drop(self, *names: str) -> None:
        for name in names:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


def slices(batches):
    """The batches in pieces of ``SLICE`` rows, each a copy, so that neither a piece nor what is made from it holds a batch. After the last one the
    worker, which lives on, gives Arrow's spare memory back."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.take(pa.array(np.arange(at, min(at + SLICE, batch.num_rows))))
        del batch
    pa.default_memory_pool().release_unused()


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join with a table of distinct keys that knows, in ``count``, how many rows of ``left`` each key has (or more).

    Keys with over a ``HOT_KEYS``-th of the rows, fewer than HOT_KEYS therefore, are broadcast, so their rows stay where they are; the others
    meet in a shuffle, in which no key has many rows.
    """
    rows = right.agg(F.sum(count)).first()[0] or 0
    bound = max(1000, rows // HOT_KEYS)
    hot = right.where(F.col(count) > bound)
    if hot.isEmpty():
        return left.join(right, keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(count) <= bound), keys)
    return left.join(F.broadcast(hot), keys).unionByName(rest)


def n_partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, group: str, first: str | None, order: list[str], rows: int, name: str, bucket_rows: int = 20000) -> DataFrame:
    """Adds a gapless rank from 0 within ``group`` (of which there are few), without holding a group in one task.

    Rows go to hashed buckets of about ``bucket_rows``; a rank is the size of the buckets before a row's own plus its place in
    that bucket. Rows with a true ``first`` column come before the others. ``rows`` is the number of rows of ``df``.
    """
    buckets = max(1, -(-rows // bucket_rows))
    at = F.pmod(F.xxhash64(*order), F.lit(buckets))
    if first:
        at = at + F.when(F.col(first), 0).otherwise(buckets)
    df = df.withColumn("_bucket", at)
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(group, "_bucket").agg(F.count("*").alias("_n")).select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1
    return df.withColumn("_place", place).join(starts, [group, "_bucket"]).withColumn(name, F.col("_start") + F.col("_place")).drop("_bucket", "_place", "_start")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for each node of the edges (a, b): the smallest node of its connected component.

    Alternates large-star and small-star steps, which need a number of rounds logarithmic in the number of nodes. Each step is an
    aggregation with map-side combine and a join that adaptive execution can split at hot nodes; neighbours are never gathered.
    """
    now = scratch.write(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before, round_no = None, 0
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(floor, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b")))
        round_no += 1
        now = scratch.write(small.where("a != b").distinct(), f"{name}-{round_no}")
        scratch.drop(f"{name}-{round_no - 1}")
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
